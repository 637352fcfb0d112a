"""Batch replay: the kernel as a grouped map over (session, instrument), fed in order from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.operators.book import reconcile, sequence_regressions, with_groups
from tapeflow.operators.kernel import FLOW, LIFECYCLE, Instrument, Settings

INPUT = ("session_date", "instrument_id", "group_id", "ts_event", "action", "side", "price", "size", "order_id", "flags", "seq")


def _replayed(batches: Iterator[pa.RecordBatch], what: str, fields: list[str], settings: Settings) -> Iterator[pa.RecordBatch]:
    """A partition sorted by (session, instrument, seq): one instrument's state at a time, rows out as they come."""
    at, engine = None, None
    rows: list[dict] = []

    def take(done: bool) -> None:
        """Moves what is ready out of the engine; rows of other kinds than the wanted one are let go."""
        found: list[dict] = []
        if what in ("flow", "lifecycle"):
            found = list(getattr(engine, what))
        elif done and what == "counters":
            found = [{"instrument_id": engine.iid, "counter": k, "n": n} for k, n in sorted(engine.counts.items())]
        elif done:
            found = [{"instrument_id": engine.iid, "kind": k, "order_id": oid, "seq": seq, "nth": i} for i, (k, oid, seq) in enumerate(engine.incidents)]
        for x in found:
            x["session_date"] = at[0]
        rows.extend(found)
        engine.flow.clear(), engine.lifecycle.clear()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x.get(f) for x in rows], type=TYPES[f]) for f in fields], names=fields)
        rows.clear()
        return out

    for b in batches:
        columns = [b.column(c).to_pylist() for c in INPUT]
        for session, iid, *record in zip(*columns):
            if at != (session, iid):
                if engine is not None:
                    engine.finish()
                    take(True)
                at, engine = (session, iid), Instrument(iid, settings)
            engine.step(*record)
            if len(engine.flow) + len(engine.lifecycle) > 2000:
                take(False)
                if len(rows) > 5000:
                    yield batch()
    if engine is not None:
        engine.finish()
        take(True)
    yield batch()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
COUNTERS = "instrument_id long, counter string, n long"
INCIDENTS = "instrument_id long, kind string, order_id long, seq long, nth long"
TYPES = {"session_date": pa.date32()} | {n: _ARROW[t] for s in (FLOW, LIFECYCLE, COUNTERS, INCIDENTS) for n, t in (x.split() for x in s.split(", "))}


def _run(mbo: DataFrame, what: str, schema: str, settings: Settings) -> DataFrame:
    grouped = with_groups(mbo).select(*INPUT)
    keyed = grouped.repartition("session_date", "instrument_id").sortWithinPartitions("session_date", "instrument_id", "seq")
    schema = f"session_date date, {schema}"
    fields = [x.split()[0] for x in schema.split(", ")]
    return keyed.mapInArrow(lambda b: _replayed(b, what, fields, settings), schema)


def lifecycle(mbo: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each termination of an order."""
    return _run(mbo, "lifecycle", LIFECYCLE, settings)


def flow(mbo: DataFrame, settings: Settings = Settings(), lifecycle: bool = True) -> DataFrame:
    """One row for each group that touched an instrument. Terminations and refills come from the lifecycles, so a flow
    without them is refused."""
    if not lifecycle:
        raise ValueError("flow rows need the lifecycles of orders")
    return _run(mbo, "flow", FLOW, settings)


def kernel_counters(mbo: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Exact counts of records, removals and incidents of each instrument, a row for each counter."""
    return _run(mbo, "counters", COUNTERS, settings)


def incidents(mbo: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The first incidents of each instrument, at most ``settings.incidents``: a log, beside the exact counters."""
    return _run(mbo, "incidents", INCIDENTS, settings)


def incident_log(mbo: DataFrame, most: int = 1000) -> DataFrame:
    """All kinds of incident in one log: the kernel's, trades and fills that don't match, sequence regressions; of each
    session the first ``most`` in order of seq. Groups count at their last record."""
    columns = ["session_date", "instrument_id", "kind", "order_id", "seq"]
    own = incidents(mbo, Settings(incidents=most)).select(columns)
    grouped = with_groups(mbo)
    wrong = reconcile(grouped).where(F.col("verdict").isin("mismatch", "fill_only"))
    last = grouped.where(F.col("action").isin("T", "F")).groupBy("session_date", "group_id", "instrument_id").agg(F.max("seq").alias("seq"))
    wrong = wrong.join(last, ["session_date", "group_id", "instrument_id"]).withColumns({"kind": F.concat(F.lit("tf_"), "verdict"), "order_id": F.lit(0).cast("bigint")}).select(columns)
    back = mbo.join(sequence_regressions(mbo).select("session_date", "seq"), ["session_date", "seq"]).withColumn("kind", F.lit("sequence_regression")).select(columns)
    # The log is a limit by design; its rows meet per session, cut at ``most`` before they do.
    every = own.unionByName(wrong).unionByName(back)
    nth = F.row_number().over(Window.partitionBy("session_date").orderBy("seq", "instrument_id", "kind", "order_id"))
    return every.withColumn("nth", nth).where(F.col("nth") <= most)


def tracker_stats(mbo: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows emitted, refill slots and links, and filled volume of each instrument, as the kernel counts them."""
    names = ("terminations", "refill_slots", "refill_links", "filled_volume")
    found = kernel_counters(mbo, settings).where(F.col("counter").isin(*names))
    return found.groupBy("session_date", "instrument_id").agg(*(F.coalesce(F.max(F.when(F.col("counter") == n, F.col("n"))), F.lit(0)).alias(n) for n in names))


def conservation(life: DataFrame, stats: DataFrame) -> DataFrame:
    """For each instrument whether its lifecycle rows are as many, and hold as much filled volume, as the kernel counted."""
    keys = ["session_date", "instrument_id"]
    got = life.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("filled_size").alias("filled"))
    joined = got.join(stats, keys, "full")
    return joined.select(*keys, "rows", "filled", F.coalesce((F.col("rows") == F.col("terminations")) & (F.col("filled") == F.col("filled_volume")), F.lit(False)).alias("conserved"))


def top_chains(chains: DataFrame, n: int = 5) -> DataFrame:
    """The longest refill chains of each session, by members, then size and root."""
    w = Window.partitionBy("session_date").orderBy(F.desc("members"), F.desc("initial_size"), "chain_id")
    return chains.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def orders_frame(life: DataFrame, tick: int = 100_000_000) -> DataFrame:
    """Typed lifecycle rows: lifetime, ticks, and the predicates of touch, cancel before touch and refill."""
    touched = F.coalesce(F.col("min_dist_same") <= 0, F.lit(False)) | (F.col("filled_size") > 0)
    out = life.withColumns({"lifetime_ns": F.col("ts_terminated") - F.col("ts_added"), "touched_best": touched, "is_refill_link": F.col("chain_index") > 0} | {f"{c}_ticks": F.col(c) / tick for c in ("dist_same_at_add", "dist_same_at_term", "min_dist_same")} | {f"dist_mid_{c}_ticks": F.col(f"dist_mid2_{c}") / (2 * tick) for c in ("at_add", "at_term")})
    return out.withColumn("cancel_before_touch", (F.col("final_state") == "cancelled") & ~F.col("touched_best"))


def chains_frame(orders: DataFrame) -> DataFrame:
    """Refill chains of two or more members: members, sizes, span and the weakest link."""
    keys = ["session_date", "instrument_id", "chain_id"]
    linked = F.col("chain_index") > 0
    out = orders.where("chain_id > 0").groupBy(*keys).agg(
        F.min_by("side", "chain_index").alias("side"), F.count(F.lit(1)).alias("members"), F.max("chain_index").alias("max_index"), F.sum("initial_size").alias("initial_size"), F.sum("filled_size").alias("filled_size"),
        F.min("ts_added").alias("ts_first"), F.max("ts_terminated").alias("ts_last"), F.min(F.when(linked, F.col("link_confidence"))).alias("min_confidence"), F.max("link_dt_ns").alias("max_dt_ns"),
    )
    return out.where("members >= 2").withColumns({"duration_ns": F.col("ts_last") - F.col("ts_first"), "fill_ratio": F.col("filled_size") / F.col("initial_size")})


def diagnostics(orders: DataFrame, tick: int = 100_000_000) -> DataFrame:
    """Rates and medians of each session over orders that weren't in the snapshot."""
    o = orders.where(~F.col("from_snapshot"))
    large = o.groupBy("session_date").agg(F.percentile("initial_size", F.lit(0.9)).alias("_p90"))
    o = o.join(large, "session_date")
    rate = lambda cond, base=None: F.avg(F.when(base, cond.cast("double")) if base is not None else cond.cast("double"))
    near = F.coalesce(F.col("min_dist_same") <= tick, F.lit(False))
    done = F.col("final_state")
    return o.groupBy("session_date").agg(
        F.count(F.lit(1)).alias("orders"), rate(done == "filled").alias("fill_rate"), rate(F.col("cancel_before_touch")).alias("cancel_before_touch_rate"), rate(done == "filled", near).alias("survival_within_tick"),
        rate((F.col("initial_size") >= F.col("_p90")) & (F.col("lifetime_ns") < 10**9)).alias("short_lived_large"), F.percentile("lifetime_ns", F.lit(0.5)).alias("median_lifetime_ns"),
        F.percentile(F.when(~F.col("is_refill_link"), F.col("lifetime_ns")), F.lit(0.5)).alias("median_lifetime_chain_adj_ns"), rate(F.col("is_refill_link")).alias("refill_share"),
    )


def terminal_states(orders: DataFrame) -> DataFrame:
    """Orders by final state with the quartiles of their lifetimes."""
    return orders.groupBy("final_state").agg(F.count(F.lit(1)).alias("orders"), *(F.percentile("lifetime_ns", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75, 0.95)))
