"""Matching events, reconciliation and the end-of-stream book in plain DataFrame operations.

Grouping is feed-wide, so its windows are keyed by session. All order is explicit: ``seq`` breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.schema import F_LAST, F_SNAPSHOT


def with_groups(mbo: DataFrame) -> DataFrame:
    """Adds group_id (from 1 in each session): a new group where the time changes or after a record with F_LAST."""
    w = Window.partitionBy("session_date").orderBy("seq")
    opens = F.lag("ts_event").over(w).isNull() | (F.lag("ts_event").over(w) != F.col("ts_event")) | (F.lag("flags").over(w).bitwiseAND(F.lit(F_LAST)) != 0)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mbo.withColumn("_opens", F.when(opens, 1).otherwise(0)).withColumn("group_id", F.sum("_opens").over(run)).drop("_opens")


def _sum_if(cond, value):
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def reconcile(grouped: DataFrame) -> DataFrame:
    """Traded and filled volume of each group and instrument with its verdict."""
    t, f = _sum_if(F.col("action") == "T", F.col("size")), _sum_if(F.col("action") == "F", F.col("size"))
    sums = grouped.where(F.col("action").isin("T", "F")).groupBy("session_date", "group_id", "instrument_id").agg(t.alias("t_volume"), f.alias("f_volume"))
    verdict = (
        F.when(F.col("t_volume") == F.col("f_volume"), "matched")
        .when((F.col("t_volume") > 0) & (F.col("f_volume") == 2 * F.col("t_volume")), "auction")
        .when((F.col("t_volume") > 0) & (F.col("f_volume") > 0), "mismatch")
        .when(F.col("f_volume") == 0, "trade_only")
        .otherwise("fill_only")
    )
    return sums.withColumn("verdict", verdict)


def counters(grouped: DataFrame) -> DataFrame:
    """Exact counts by session; the kinds of record, their volumes, groups and sides of trades."""
    a = F.col("action")
    by_kind = [F.count(F.when(a == k, 1)).alias(n) for k, n in (("A", "adds"), ("C", "cancels"), ("M", "modifies"), ("T", "trades"), ("F", "fills"), ("R", "clears"))]
    return grouped.groupBy("session_date").agg(
        F.count(F.lit(1)).alias("records"),
        F.max("group_id").alias("groups"),
        *by_kind,
        F.count(F.when(~a.isin("A", "C", "M", "T", "F", "R"), 1)).alias("others"),
        _sum_if(a == "T", F.col("size")).alias("t_volume"),
        _sum_if((a == "T") & (F.col("side") == "B"), F.col("size")).alias("t_buy"),
        _sum_if((a == "T") & (F.col("side") == "A"), F.col("size")).alias("t_sell"),
        _sum_if(a == "F", F.col("size")).alias("f_volume"),
    )


def sequence_regressions(mbo: DataFrame) -> DataFrame:
    """Records whose sequence lies under the highest accepted before on their channel; zero and snapshot records don't count."""
    w = Window.partitionBy("session_date", "channel_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = mbo.where((F.col("sequence") != 0) & (F.col("flags").bitwiseAND(F.lit(F_SNAPSHOT)) == 0))
    return counted.withColumn("highest", F.max("sequence").over(w)).where(F.col("sequence") < F.col("highest")).select("session_date", "channel_id", "seq", "sequence", "highest")


def instrument_volumes(mbo: DataFrame, keys: tuple[str, ...] = ("instrument_id",)) -> DataFrame:
    """Records and traded volume of each instrument: a pruned scan and one aggregation."""
    return mbo.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), _sum_if(F.col("action") == "T", F.col("size")).alias("t_volume"))


def front_instrument(mbo: DataFrame) -> DataFrame:
    """The instrument with the most traded volume of each session; ties go to the lowest id."""
    v = instrument_volumes(mbo, ("session_date", "instrument_id"))
    best = v.groupBy("session_date").agg(F.max(F.struct("t_volume", (-F.col("instrument_id")).alias("low"))).alias("s"))
    return best.select("session_date", (-F.col("s.low")).alias("instrument_id"), F.col("s.t_volume").alias("t_volume"))


def resting_orders(mbo: DataFrame, keys: tuple[str, ...] = ("session_date", "instrument_id")) -> DataFrame:
    """Orders that rest at the end of the stream, by windows alone.

    A clear starts an epoch. Within it an order starts a life at every add, and at the first record after a cancel; the
    side of a life is its first record's, price and size its last's; it rests if that is no cancel. Its priority is the
    last record at which it was new, changed its price or grew.
    """
    keys = list(keys)
    stream = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    rows = mbo.withColumn("_rep", F.sum(F.when(F.col("action") == "R", 1).otherwise(0)).over(stream))
    rows = rows.withColumn("_last", F.max("_rep").over(whole)).where((F.col("_rep") == F.col("_last")) & F.col("action").isin("A", "M", "C"))
    order = Window.partitionBy(*keys, "order_id").orderBy("seq")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("action").over(order)
    fresh = (F.col("action") == "A") | before.isNull() | (before == "C")
    rows = rows.withColumn("_fresh", fresh).withColumn("_life", F.sum(F.when(F.col("_fresh"), 1).otherwise(0)).over(run))
    life = Window.partitionBy(*keys, "order_id", "_life").orderBy("seq")
    moved = F.lag("price").over(life).isNull() | (F.col("price") != F.lag("price").over(life)) | (F.col("size") > F.lag("size").over(life))
    to_now = life.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "_side": F.first("side").over(to_now),
            "_priority": F.max(F.when(moved, F.col("seq"))).over(to_now),
            "_next": F.lead("seq").over(order),
        }
    )
    last = rows.where(F.col("_next").isNull() & (F.col("action") != "C"))
    return last.select(*keys, "order_id", F.col("_side").alias("side"), "price", "size", F.col("_priority").alias("priority"))


def with_queue_positions(resting: DataFrame, keys: tuple[str, ...] = ("session_date", "instrument_id")) -> DataFrame:
    """Adds queue_pos and volume_ahead within the level."""
    w = Window.partitionBy(*keys, "side", "price").orderBy("priority")
    ahead = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return resting.withColumns({"queue_pos": (F.row_number().over(w) - 1).cast("bigint"), "volume_ahead": ahead})


def top_levels(resting: DataFrame, n: int = 10, keys: tuple[str, ...] = ("session_date", "instrument_id")) -> DataFrame:
    """The best ``n`` levels of each side: level (from 1), price, size, orders."""
    levels = resting.groupBy(*keys, "side", "price").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("orders"))
    best = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy(best)
    return levels.withColumn("level", F.row_number().over(w)).where(F.col("level") <= n)


def best_bid_ask(resting: DataFrame, keys: tuple[str, ...] = ("session_date", "instrument_id")) -> DataFrame:
    """Best quotes and the spread in points; spread null unless both sides exist."""
    out = resting.groupBy(*keys).agg(F.max(F.when(F.col("side") == "B", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "A", F.col("price"))).alias("ask"))
    return out.withColumn("spread", (F.col("ask") - F.col("bid")) / F.lit(1e9))


def audit_levels(resting: DataFrame, levels: DataFrame, keys: tuple[str, ...] = ("session_date", "instrument_id")) -> DataFrame:
    """Rows in which an order view and a level view of a book differ; empty if they agree."""
    mine = resting.groupBy(*keys, "side", "price").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("orders"))
    cols = [*keys, "side", "price", "size", "orders"]
    a, b = mine.select(cols), levels.select(cols)
    return a.exceptAll(b).withColumn("view", F.lit("orders")).unionByName(b.exceptAll(a).withColumn("view", F.lit("levels")))


def digest(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """An order-independent digest of rows for replay comparisons."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("digest"))


def plain_digest(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """As ``digest`` for whole-number columns, folded column by column without a hash of one engine."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *(F.bit_xor(c).alias(c) for c in columns))


def trade_flow(grouped: DataFrame) -> DataFrame:
    """Trades of each group and instrument: volumes, counts, price extremes. Trades that aren't buys count as sells."""
    t = grouped.where(F.col("action") == "T")
    buy = F.col("side") == "B"
    return t.groupBy("session_date", "group_id", "instrument_id").agg(
        _sum_if(buy, F.col("size")).alias("t_buy"),
        _sum_if(~buy, F.col("size")).alias("t_sell"),
        F.count(F.when(buy, 1)).alias("t_buy_n"),
        F.count(F.when(~buy, 1)).alias("t_sell_n"),
        F.max("price").alias("t_px_high"),
        F.min("price").alias("t_px_low"),
    )


def fill_removals(grouped: DataFrame) -> DataFrame:
    """Cancels split into pulls and removals after a fill of the same order at the same time: a semi-join by key."""
    c = grouped.where(F.col("action") == "C")
    fills = grouped.where(F.col("action") == "F").select("session_date", "instrument_id", "order_id", "ts_event", F.col("seq").alias("f_seq"))
    hit = c.join(fills, ["session_date", "instrument_id", "order_id", "ts_event"]).where(F.col("f_seq") < F.col("seq")).select("session_date", "seq").distinct().withColumn("fill_removal", F.lit(True))
    return c.join(hit, ["session_date", "seq"], "left").select("session_date", "seq", "instrument_id", "order_id", F.coalesce("fill_removal", F.lit(False)).alias("fill_removal"))
