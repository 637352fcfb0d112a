"""Queries over the record stream and the end-of-stream book."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import book
from tapeflow.plans.catalog import query
from tapeflow.sources.events import MBO_SQL, read_mbo

GROUPS = f"""WITH {MBO_SQL}, g0 AS (
  SELECT *, CASE WHEN lag(ts_event) OVER w IS NULL OR lag(ts_event) OVER w <> ts_event OR (lag(flags) OVER w & 128) <> 0 THEN 1 ELSE 0 END AS opens
  FROM mbo WINDOW w AS (PARTITION BY session_date ORDER BY seq)
), grouped AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY session_date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS group_id FROM g0
)"""

RESTING = f"""WITH {MBO_SQL}, a0 AS (
  SELECT *, lag(action) OVER (PARTITION BY session_date, instrument_id, order_id ORDER BY seq) AS before FROM mbo WHERE action IN ('A', 'M', 'C')
), a1 AS (
  SELECT *, sum(CASE WHEN action = 'A' OR before IS NULL OR before = 'C' THEN 1 ELSE 0 END) OVER (PARTITION BY session_date, instrument_id, order_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM a0
), a2 AS (
  SELECT *, lag(price) OVER l AS p0, lag(size) OVER l AS s0, lead(seq) OVER (PARTITION BY session_date, instrument_id, order_id ORDER BY seq) AS nxt
  FROM a1 WINDOW l AS (PARTITION BY session_date, instrument_id, order_id, life ORDER BY seq)
), a3 AS (
  SELECT *, first_value(side) OVER l AS side0, max(CASE WHEN p0 IS NULL OR price <> p0 OR size > s0 THEN seq END) OVER l AS priority
  FROM a2 WINDOW l AS (PARTITION BY session_date, instrument_id, order_id, life ORDER BY seq ROWS UNBOUNDED PRECEDING)
), resting AS (
  SELECT session_date, instrument_id, order_id, side0 AS side, price, size, priority FROM a3 WHERE nxt IS NULL AND action <> 'C'
)"""


@query("mbo_group_counts", GROUPS + " SELECT session_date, group_id, count(*) AS records, min(seq) AS first_seq, count(DISTINCT instrument_id) AS instruments FROM grouped GROUP BY ALL")
def mbo_group_counts(spark, sf_dir):
    g = book.with_groups(read_mbo(spark, sf_dir))
    return g.groupBy("session_date", "group_id").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"), F.countDistinct("instrument_id").alias("instruments"))


@query(
    "tf_reconcile",
    GROUPS
    + """, s AS (SELECT session_date, group_id, instrument_id, CAST(coalesce(sum(size) FILTER (action = 'T'), 0) AS BIGINT) AS t_volume, CAST(coalesce(sum(size) FILTER (action = 'F'), 0) AS BIGINT) AS f_volume
  FROM grouped WHERE action IN ('T', 'F') GROUP BY ALL)
SELECT *, CASE WHEN t_volume = f_volume THEN 'matched' WHEN t_volume > 0 AND f_volume = 2 * t_volume THEN 'auction' WHEN t_volume > 0 AND f_volume > 0 THEN 'mismatch' WHEN f_volume = 0 THEN 'trade_only' ELSE 'fill_only' END AS verdict FROM s""",
)
def tf_reconcile(spark, sf_dir):
    return book.reconcile(book.with_groups(read_mbo(spark, sf_dir)))


@query(
    "engine_counters",
    GROUPS
    + """ SELECT session_date, count(*) AS records, max(group_id) AS groups, count(*) FILTER (action = 'A') AS adds, count(*) FILTER (action = 'C') AS cancels, count(*) FILTER (action = 'M') AS modifies,
  count(*) FILTER (action = 'T') AS trades, count(*) FILTER (action = 'F') AS fills, count(*) FILTER (action = 'R') AS clears, count(*) FILTER (action NOT IN ('A','C','M','T','F','R')) AS others,
  CAST(coalesce(sum(size) FILTER (action = 'T'), 0) AS BIGINT) AS t_volume, CAST(coalesce(sum(size) FILTER (action = 'T' AND side = 'B'), 0) AS BIGINT) AS t_buy,
  CAST(coalesce(sum(size) FILTER (action = 'T' AND side = 'A'), 0) AS BIGINT) AS t_sell, CAST(coalesce(sum(size) FILTER (action = 'F'), 0) AS BIGINT) AS f_volume FROM grouped GROUP BY session_date""",
)
def engine_counters(spark, sf_dir):
    return book.counters(book.with_groups(read_mbo(spark, sf_dir)))


@query("sequence_regressions", f"WITH {MBO_SQL}, s AS (SELECT *, max(sequence) OVER (PARTITION BY session_date, channel_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM mbo WHERE sequence <> 0 AND flags & 32 = 0) SELECT session_date, channel_id, seq, sequence, highest FROM s WHERE sequence < highest")
def sequence_regressions(spark, sf_dir):
    return book.sequence_regressions(read_mbo(spark, sf_dir))


@query("instrument_volumes", f"WITH {MBO_SQL} SELECT instrument_id, count(*) AS records, CAST(coalesce(sum(size) FILTER (action = 'T'), 0) AS BIGINT) AS t_volume FROM mbo GROUP BY instrument_id")
def instrument_volumes(spark, sf_dir):
    return book.instrument_volumes(read_mbo(spark, sf_dir))


@query(
    "front_instrument",
    f"""WITH {MBO_SQL}, v AS (SELECT session_date, instrument_id, CAST(coalesce(sum(size) FILTER (action = 'T'), 0) AS BIGINT) AS t_volume FROM mbo GROUP BY ALL)
SELECT session_date, instrument_id, t_volume FROM v QUALIFY row_number() OVER (PARTITION BY session_date ORDER BY t_volume DESC, instrument_id) = 1""",
)
def front_instrument(spark, sf_dir):
    return book.front_instrument(read_mbo(spark, sf_dir))


@query("resting_orders", RESTING + " SELECT * FROM resting")
def resting_orders(spark, sf_dir):
    return book.resting_orders(read_mbo(spark, sf_dir))


@query("queue_positions", RESTING + " SELECT *, row_number() OVER w - 1 AS queue_pos, CAST(sum(size) OVER w - size AS BIGINT) AS volume_ahead FROM resting WINDOW w AS (PARTITION BY session_date, instrument_id, side, price ORDER BY priority ROWS UNBOUNDED PRECEDING)")
def queue_positions(spark, sf_dir):
    return book.with_queue_positions(book.resting_orders(read_mbo(spark, sf_dir)))


@query(
    "final_book_top_levels",
    RESTING
    + """, l AS (SELECT session_date, instrument_id, side, price, CAST(sum(size) AS BIGINT) AS size, count(*) AS orders FROM resting GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY session_date, instrument_id, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS INTEGER) AS level FROM l QUALIFY level <= 10""",
)
def final_book_top_levels(spark, sf_dir):
    return book.top_levels(book.resting_orders(read_mbo(spark, sf_dir)))


@query("best_bid_ask", RESTING + ", q AS (SELECT session_date, instrument_id, max(price) FILTER (side = 'B') AS bid, min(price) FILTER (side = 'A') AS ask FROM resting GROUP BY ALL) SELECT *, (ask - bid) / 1e9 AS spread FROM q")
def best_bid_ask(spark, sf_dir):
    return book.best_bid_ask(book.resting_orders(read_mbo(spark, sf_dir)))


# The level view is told one more at the best price of one instrument: both views of those levels come out, and no others.
@query(
    "book_audit",
    RESTING
    + """, l AS (SELECT session_date, instrument_id, side, price, CAST(sum(size) AS BIGINT) AS size, count(*) AS orders FROM resting GROUP BY ALL),
b AS (SELECT * FROM l WHERE instrument_id = 2 QUALIFY row_number() OVER (PARTITION BY session_date, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) = 1)
SELECT *, 'orders' AS view FROM b UNION ALL SELECT session_date, instrument_id, side, price, size + 1, orders, 'levels' FROM b""",
)
def book_audit(spark, sf_dir):
    resting = book.resting_orders(read_mbo(spark, sf_dir))
    levels = book.top_levels(resting, 1_000_000)
    planted = levels.withColumn("size", F.col("size") + F.when((F.col("instrument_id") == 2) & (F.col("level") == 1), 1).otherwise(0))
    return book.audit_levels(resting, planted)


@query("book_digest", RESTING + " SELECT session_date, instrument_id, count(*) AS rows, bit_xor(order_id) AS order_id, bit_xor(price) AS price, bit_xor(size) AS size, bit_xor(priority) AS priority FROM resting GROUP BY session_date, instrument_id")
def book_digest(spark, sf_dir):
    """The digest's columns one by one, as another engine can fold them too."""
    return book.plain_digest(book.resting_orders(read_mbo(spark, sf_dir)), ["order_id", "price", "size", "priority"], ["session_date", "instrument_id"])


@query(
    "trade_flow",
    GROUPS
    + """ SELECT session_date, group_id, instrument_id, CAST(coalesce(sum(size) FILTER (side = 'B'), 0) AS BIGINT) AS t_buy, CAST(coalesce(sum(size) FILTER (side <> 'B'), 0) AS BIGINT) AS t_sell,
  count(*) FILTER (side = 'B') AS t_buy_n, count(*) FILTER (side <> 'B') AS t_sell_n, max(price) AS t_px_high, min(price) AS t_px_low FROM grouped WHERE action = 'T' GROUP BY ALL""",
)
def trade_flow(spark, sf_dir):
    return book.trade_flow(book.with_groups(read_mbo(spark, sf_dir)))


@query("fill_removals", f"WITH {MBO_SQL} SELECT session_date, seq, instrument_id, order_id, EXISTS (SELECT 1 FROM mbo f WHERE f.action = 'F' AND f.session_date = c.session_date AND f.instrument_id = c.instrument_id AND f.order_id = c.order_id AND f.ts_event = c.ts_event AND f.seq < c.seq) AS fill_removal FROM mbo c WHERE action = 'C'")
def fill_removals(spark, sf_dir):
    return book.fill_removals(read_mbo(spark, sf_dir))
