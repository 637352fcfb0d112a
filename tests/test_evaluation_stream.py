import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeflow import config
from tapeflow.operators import evaluation as V
from tapeflow.operators import features, folds, inputs, replay, samples, scales
from tapeflow.plans import input_queries
from tapeflow.streaming.book_stream import stream
from tests.records import DAY, PX, frame, random_stream, record


def test_auc_ties_and_brier(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False), (0.5, True)], "s double, y boolean")
    assert V.rank_auc(df, "s", "y").first()["auc"] == 0.5
    assert V.rank_auc(df.where("y"), "s", "y").first()["auc"] is None
    wrong = spark.createDataFrame([(1.0, 0.0, 0.0, 1)], "a double, b double, c double, label int")
    assert V.brier(wrong, ["a", "b", "c"], "label").first()["brier"] == 2.0


def gate_rows(spark, good):
    out = []
    for s in range(30):
        for i in range(20):
            label = i % 3
            p = [0.1, 0.1, 0.1]
            p[label if good else (label + 1) % 3] = 0.8
            out.append((s, label, *p, {0: 0.0, 1: 2.0, 2: -2.0}[label], s == 3, 1 / 3, 1 / 3, 1 / 3))
    return spark.createDataFrame(out, "session int, label int, p0 double, p1 double, p2 double, ret double, tagged boolean, train_p0 double, train_p1 double, train_p2 double")


def test_gate_passes_an_oracle_and_stops_an_uninformed_model(spark):
    assert V.gate(gate_rows(spark, True)).first()["passed"]
    assert not V.gate(gate_rows(spark, False)).first()["passed"]


def test_top_share_leaves_out_what_is_no_number(spark):
    nan = float("nan")
    rows = [(i / 10, nan, float(i)) for i in range(10)] + [(None, 1.0, -20.0), (nan, None, 5.0), (None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, m double")
    best = [i / 10 for i in range(10)] + [1.0]
    cut = float(pd.Series(best).quantile(0.9))
    got = V.top_share(df, ["a", "b"], "m").first()
    assert (got["top_rows"], got["move_top"], got["move_all"]) == (sum(x >= cut for x in best), 14.5, 5.0) and not got["calm"]
    got = V.top_share(df.limit(0), ["a"], "m").first()
    assert tuple(got) == (0, None, None, None)


def test_purge_keeps_no_label_across_the_border(spark):
    ns = 10**9
    df = spark.createDataFrame([(i, i * 100 * ns, (i * 100 + 600) * ns) for i in range(50)], "i int, ts long, label_end_ts long")
    kept = V.purge(df, 3000 * ns)
    assert kept.agg(F.max("label_end_ts")).first()[0] < 3000 * ns and kept.count() == 24


def test_standardizer_round_trip_and_clip(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (1, 2, 3, 4, 1000)], "a double, b double")
    fitted = V.robust_fit(df, ["a", "b"])
    text = V.frame_to_json(fitted)
    assert V.frame_to_json(V.frame_from_json(spark, text)) == text
    out = V.standardize(df, V.frame_from_json(spark, text), ["a", "b"]).orderBy("a").collect()
    assert out[-1]["a"] == 8.0 and out[-1]["clipped"] == 1 and out[0]["b"] == 0.0


def test_labels_need_the_whole_window(spark):
    path = spark.createDataFrame([(1, u, p, p, p + 1, p + 1, p, p + 1, p + 0.5) for u, p in enumerate((10.0, 12.0, 9.0, 11.0))], "k int, u long, bid_high double, bid_low double, ask_high double, ask_low double, bid_last double, ask_last double, mid_last double")
    got = scales.labels(path, ["k"], 2, 0.2, 2.0, 1.0).orderBy("u").collect()
    assert [r["window_complete"] for r in got] == [1, 1, 0, 0]
    assert (got[0]["up"], got[0]["up_adverse"], got[0]["t_up"], got[0]["t_down"], got[0]["final_return"]) == (1.0, 2.0, 1, 2, -1.0)


def test_uniqueness_of_disjoint_and_equal_windows(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 0, True), (1, 100, True), (1, 200, False)], "k int, ts long, trainable boolean")
    got = sorted(r["uniqueness"] for r in samples.uniqueness(df, ["k"], 10, 1).collect())
    assert got == pytest.approx([0.0, 0.5, 0.5, 1.0])


def test_bars_close_by_count_or_time(spark):
    rows = spark.createDataFrame([(1, t, i) for i, t in enumerate((0, 1, 2, 3, 50, 51))], "k int, ts long, row_seq long")
    got = inputs.with_bars(rows, ["k"], 3, 20).orderBy("row_seq").collect()
    assert [(r["bar"], r["closes"]) for r in got] == [(0, False), (0, False), (0, True), (1, False), (1, True), (2, False)]


def test_ranks_and_folds_of_streams(spark):
    ranks, past = folds.Ranks(5), []
    for u, v in ((1, 3.0), (2, 1.0), (4, 3.0), (5, None), (8, 2.0), (9, 9.0), (20, 1.0)):
        live = [b for a, b in past if a >= u - 5]
        want = None if v is None or not live else sum((b < v) + (b <= v) for b in live) / 2 / len(live)
        assert ranks.rank(u, v) == want
        ranks.push(u, v)
        past += [(u, v)] if v is not None else []
    rows = spark.createDataFrame([(k, t, i, "clock" if i % 3 else "sweep", True) for k in (1, 2) for i, t in enumerate((0, 1, 5, 6, 7, 20, 21, 40))], "k int, ts long, row_seq long, trigger string, active boolean")
    got = samples.greedy_pick(rows, ["k"], 5, 1).orderBy("k", "ts").collect()
    assert [(r["k"], r["ts"]) for r in got] == [(k, t) for k in (1, 2) for t in (0, 5, 20, 40)]
    kept = features.sampled(rows, ["k"], 6).orderBy("k", "ts").collect()
    assert [r["ts"] for r in kept if r["k"] == 1] == [0, 6, 20, 40]


def test_assembled_inputs_end_with_the_sampled_row(spark):
    got = input_queries.assembled_inputs(spark, "/root/testdata/sf0.001").collect()
    events = {(r["session_date"], r["instrument_id"], r["row_seq"]): r for r in input_queries.I.event_stream(input_queries.rows(spark, "/root/testdata/sf0.001"), input_queries.STREAM).collect()}
    assert len(got) > 100
    for r in got:
        own = events[r["session_date"], r["instrument_id"], r["row_seq"]]
        assert [len(r[n]) for n in ("events", "bars", "tactical", "slow")] == [16, 4, 8, 2] and [len(r[n][0]) for n in ("events", "bars", "tactical", "slow")] == [22, 30, 23, 15]
        assert r["events"][-1] == pytest.approx([own[c] or 0.0 for c in input_queries.I.EVENT], rel=1e-5, abs=1e-6)
        assert all(not any(x) for x in r["events"][: 16 - r["events_len"]]) and all(not any(x) for x in r["bars"][: 4 - r["bars_len"]])
    with pytest.raises(ValueError):
        replay.flow(None, lifecycle=False)


def test_state_of_a_session_goes_with_its_end_mark():
    from tapeflow.streaming import book_stream

    class State:
        exists, hasTimedOut, get, removed = False, False, (), False

        def update(self, x):
            self.exists, self.get = True, x

        def remove(self):
            self.exists, self.removed = False, True

    names = ["session_date", "seq", "ts_event", "action", "side", "price", "size", "order_id", "flags", "channel_id", "sequence", "instrument_id"]
    fields = ["session_date", "instrument_id", "ts"]
    run, state = book_stream._streamed("flow", fields, book_stream.Settings(), None), State()
    frames = [pd.DataFrame([record(i, 10 + i, "A", "B", PX, 1, i)], columns=names) for i in range(2)] + [pd.DataFrame([record(9, 20, "E", "N", 0, 0, 0)], columns=names)]
    rows = [len(next(run((DAY,), iter([f]), state))) for f in frames]
    assert rows == [0, 1, 1] and state.removed and not state.exists


def test_stream_equals_batch(spark, tmp_path):
    rows = random_stream(400, 5)
    mbo = frame(spark, rows)
    for i in range(4):
        frame(spark, rows[i * 100 : (i + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame(spark, [record(400, rows[-1][2], "E", "N", 0, 0, 0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(mbo.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = stream(source).writeStream.format("memory").queryName("flow_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = replay.flow(mbo)
    got = spark.table("flow_out").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.first()["session_date"] == DAY


def test_config_file(tmp_path):
    (tmp_path / "c.toml").write_text("[scales]\nwindow = 10\nhorizons = [1, 2]\n[paths]\nraw = 'data'\n")
    c = config.load(tmp_path / "c.toml")
    assert c.scales.window == 10 and c.paths["raw"] == str(tmp_path / "data") and c.fingerprint()["horizons"] == [1, 2]
    assert datetime.date(2024, 1, 16) == DAY
