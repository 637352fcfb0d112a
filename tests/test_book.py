import pytest
from pyspark.sql import functions as F

from tapeflow.operators import book, replay
from tapeflow.operators.kernel import Instrument
from tapeflow.schema import TICK
from tests.records import DAY, PX, frame, random_stream, record


def test_groups_span_instruments_and_end_at_the_last_flag(spark):
    rows = [record(0, 10, "A", "B", PX, 1, 1), record(1, 10, "A", "B", PX, 1, 2, 128, 2), record(2, 10, "A", "B", PX, 1, 3), record(3, 11, "A", "B", PX, 1, 4)]
    got = book.with_groups(frame(spark, rows)).orderBy("seq").select("group_id").collect()
    assert [r[0] for r in got] == [1, 1, 2, 3]


def test_reconciliation_verdicts(spark):
    rows, ts = [], 0
    for trades, fills in ((5, 5), (5, 10), (5, 3), (5, 0), (0, 5)):
        ts += 10
        if trades:
            rows.append(record(len(rows), ts, "T", "B", PX, trades, 0))
        if fills:
            rows.append(record(len(rows), ts, "F", "A", PX, fills, 1))
    got = book.reconcile(book.with_groups(frame(spark, rows))).orderBy("group_id").select("verdict").collect()
    assert [r[0] for r in got] == ["matched", "auction", "mismatch", "trade_only", "fill_only"]


def test_sequence_regression_keeps_the_highest_accepted(spark):
    rows = [list(record(i, i, "A", "B", PX, 1, i + 1)) for i in range(4)]
    for r, s in zip(rows, (5, 9, 7, 8)):
        r[10] = s
    got = book.sequence_regressions(frame(spark, [tuple(r) for r in rows])).orderBy("seq").collect()
    assert [(r["sequence"], r["highest"]) for r in got] == [(7, 9), (8, 9)]


def queue_of(engine):
    return sorted((o.oid, s, o.price, o.size, i) for s in "BA" for level in engine.side[s].levels.values() for i, o in enumerate(level.values()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_and_kernel_agree_on_the_resting_book(spark, seed):
    rows = random_stream(600, seed)
    engines = {1: Instrument(1), 2: Instrument(2)}
    for r in rows:
        engines[r[11]].feed({"group_id": r[1], "ts_event": r[2], "action": r[3], "side": r[4], "price": r[5], "size": r[6], "order_id": r[7], "flags": r[8]})
    got = book.with_queue_positions(book.resting_orders(frame(spark, rows))).collect()
    for iid, engine in engines.items():
        assert sorted((r["order_id"], r["side"], r["price"], r["size"], r["queue_pos"]) for r in got if r["instrument_id"] == iid) == queue_of(engine)


def test_replay_twice_gives_the_same_rows_and_every_life_ends_once(spark):
    mbo = frame(spark, random_stream(800, 9))
    life = replay.lifecycle(mbo)
    one = book.digest(life, life.columns, ["session_date"]).collect()
    assert one == book.digest(replay.lifecycle(mbo), life.columns, ["session_date"]).collect()
    assert life.count() == life.dropDuplicates(["instrument_id", "order_id", "ts_added", "ts_terminated", "queue_pos_at_add", "final_state"]).count()


def feed(engine, *steps):
    for i, (ts, action, side, price, size, oid) in enumerate(steps):
        engine.feed({"group_id": ts, "ts_event": ts, "action": action, "side": side, "price": price, "size": size, "order_id": oid, "flags": 0})


def test_queue_priority_and_closest_approach():
    e = Instrument(1)
    low, high = 100 * PX, 100 * PX + TICK
    feed(e, (1, "A", "B", low, 5, 1), (2, "A", "B", low, 5, 2), (3, "A", "B", high, 1, 3), (4, "M", "B", low, 4, 1), (5, "M", "B", low, 9, 1))
    assert [o.oid for o in e.side["B"].levels[low].values()] == [2, 1]  # a smaller size keeps the place, a larger loses it
    feed(e, (6, "A", "B", low, 2, 4), (7, "C", "B", high, 1, 3), (8, "C", "B", low, 2, 4))
    rows = {r["order_id"]: r for r in e.lifecycle}
    assert rows[4]["dist_same_at_add"] == TICK and rows[4]["min_dist_same"] == 0 and rows[4]["vol_ahead_at_add"] == 14 and rows[4]["final_state"] == "cancelled"


def test_refill_chain_and_hidden_fill():
    e = Instrument(1)
    p = 100 * PX
    feed(e, (10, "A", "A", p, 5, 1), (20, "F", "A", p, 8, 1), (20, "C", "A", p, 5, 1), (1020, "A", "A", p, 5, 2))
    e.finish()
    first, second = e.lifecycle
    assert first["final_state"] == "filled" and first["chain_id"] == second["chain_id"] == 1 and second["chain_index"] == 1  # the root's id
    assert second["link_confidence"] == pytest.approx(1 - 0.5 * 1000 / 2_000_000)
    flow = {r["ts"]: r for r in e.flow}
    assert flow[20]["hidden_a"] == 3 and flow[20]["term_filled"] == 1 and flow[1020]["refill_a"] == 1


def test_a_group_of_modifies_alone_gives_no_row_and_clears_discard():
    e = Instrument(1)
    feed(e, (1, "A", "B", PX, 5, 1), (2, "M", "B", PX, 7, 1), (3, "A", "B", PX, 1, 2), (4, "R", "N", 0, 0, 0))
    e.finish()
    assert [r["ts"] for r in e.flow] == [1, 3]
    assert e.flow[1]["flow_b_1"] == 3  # the modify's depth shows up in the next row
    assert {r["final_state"] for r in e.lifecycle} == {"cleared"}


def test_refills_larger_than_the_clip_are_none_and_every_fill_roots_a_chain():
    e, p = Instrument(1), 100 * PX
    feed(e, (10, "A", "A", p, 5, 7), (20, "F", "A", p, 5, 7), (20, "C", "A", p, 5, 7), (30, "A", "A", p, 8, 9), (40, "A", "A", p, 5, 11), (50, "C", "A", p, 5, 11), (60, "C", "A", p, 8, 9))
    rows = {r["order_id"]: r for r in e.lifecycle}
    assert rows[7]["chain_id"] == 7 and rows[9]["chain_id"] == 0 and rows[11]["chain_id"] == 7 and rows[11]["chain_index"] == 1
    assert sum(r["refill_a"] for r in e.flow) == 1


def test_rows_after_a_clear_in_its_group_and_sides_that_were_empty():
    e = Instrument(1)
    feed(e, (1, "A", "B", PX, 5, 1), (2, "R", "N", 0, 0, 0), (2, "A", "B", PX, 4, 2), (3, "A", "B", PX, 3, 3), (4, "A", "A", 2 * PX, 7, 4))
    e.finish()
    assert [r["ts"] for r in e.flow] == [1, 2, 3, 4]
    assert [r["flow_b_1"] for r in e.flow] == [0, 0, 3, 0] and e.flow[3]["flow_a_1"] == 0 and e.flow[1]["add_best_b"] == 4


def test_prices_below_zero_and_mid_distances():
    e = Instrument(1)
    feed(e, (1, "T", "B", -50, 1, 0), (1, "T", "A", -70, 1, 0), (2, "A", "B", -3 * TICK, 1, 1), (3, "A", "A", TICK, 1, 2), (4, "C", "B", -3 * TICK, 1, 1))
    e.finish()
    assert (e.flow[0]["t_px_high"], e.flow[0]["t_px_low"]) == (-50, -70)
    rows = {r["order_id"]: r for r in e.lifecycle}
    assert rows[1]["dist_mid2_at_add"] is None and rows[1]["dist_mid2_at_term"] == 4 * TICK and rows[2]["dist_mid2_at_add"] == 4 * TICK and rows[2]["dist_mid2_at_term"] is None


def test_level_view_and_order_view_agree(spark):
    resting = book.resting_orders(frame(spark, random_stream(300, 4)))
    assert book.audit_levels(resting, book.top_levels(resting, 1000)).count() == 0
    worse = book.top_levels(resting, 1000).withColumn("size", F.col("size") + 1)
    assert book.audit_levels(resting, worse).count() > 0
    assert DAY == resting.first()["session_date"]
