"""The generic ``events`` table read as order-by-order records, as if it were an exchange feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.schema import TICK


def micros(ts: str, df: DataFrame) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a zone, in any session zone.

    ``timestampdiff`` goes through the session's zone, which moves wall times of the hour that is skipped in spring.
    """
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(19, 6)) * 1000000 as bigint)")
    return F.unix_micros(ts)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, user_id, event_type, value, k."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", micros("ts", df).alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def read_mbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per event, and a fill beside most trades; schema ``tapeflow.schema.MBO``."""
    e = read_events(spark, sf_dir)
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "signup"), "A").when(kind == "click", "M").when(kind == "error", "C").otherwise("T")
    bid = F.floor(F.col("event_id") / 5) % 2 == 0
    rows = e.select(
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int")).alias("session_date"),
        (F.col("event_id") * 2).alias("seq"),
        (F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000_000).alias("ts_event"),
        action.alias("action"),
        F.when(bid, "B").otherwise("A").alias("side"),
        F.when(bid, (10000 - F.col("k")) * TICK).otherwise((10001 + F.col("k")) * TICK).alias("price"),
        (1 + F.floor("value") % 20).alias("size"),
        F.when(action == "A", F.col("event_id")).otherwise(F.col("event_id") - 5 * (1 + F.col("k") % 8)).alias("order_id"),
        F.when(F.col("event_id") % 3 == 2, 128).otherwise(0).alias("flags"),
        F.lit(0).alias("channel_id"),
        (F.col("event_id") - F.when(F.col("k") % 50 == 7, 3).otherwise(0)).alias("sequence"),
        (F.col("event_id") % 5).alias("instrument_id"),
        "k",
    )
    fill = F.when((F.col("action") == "T") & (F.col("k") % 10 != 9), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_copy", F.explode(fill))
    twin = F.col("_copy") == 1
    return rows.select(
        "session_date",
        (F.col("seq") + F.col("_copy")).alias("seq"),
        "ts_event",
        F.when(twin, "F").otherwise(F.col("action")).alias("action"),
        "side",
        "price",
        F.when(twin & (F.col("k") % 4 == 0), F.col("size") * 2).otherwise(F.col("size")).alias("size"),
        "order_id",
        F.when(twin | (F.col("action") != "T") | (F.col("k") % 10 == 9), F.col("flags")).otherwise(0).alias("flags"),
        "channel_id",
        "sequence",
        "instrument_id",
    )


#: The same mapping for DuckDB.
MBO_SQL = """
ev AS (
  SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), m0 AS (
  SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 'A' WHEN event_type = 'click' THEN 'M' WHEN event_type = 'error' THEN 'C' ELSE 'T' END AS action0,
    (event_id // 5) % 2 = 0 AS bid FROM ev
), m1 AS (
  SELECT *, unnest(CASE WHEN action0 = 'T' AND k % 10 <> 9 THEN [0, 1] ELSE [0] END) AS twin FROM m0
), mbo AS (
  SELECT CAST(make_date(CAST(us // 86400000000 AS INTEGER)) AS DATE) AS session_date, CAST(event_id * 2 + twin AS BIGINT) AS seq, CAST((us // 3600000000) * 3600000000000 AS BIGINT) AS ts_event,
    CASE WHEN twin = 1 THEN 'F' ELSE action0 END AS action, CASE WHEN bid THEN 'B' ELSE 'A' END AS side,
    CAST(CASE WHEN bid THEN (10000 - k) * 100000000 ELSE (10001 + k) * 100000000 END AS BIGINT) AS price,
    CAST((1 + CAST(floor(value) AS BIGINT) % 20) * CASE WHEN twin = 1 AND k % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS size,
    CAST(CASE WHEN action0 = 'A' THEN event_id ELSE event_id - 5 * (1 + k % 8) END AS BIGINT) AS order_id,
    CASE WHEN (twin = 1 OR action0 <> 'T' OR k % 10 = 9) AND event_id % 3 = 2 THEN 128 ELSE 0 END AS flags,
    0 AS channel_id, event_id - CASE WHEN k % 50 = 7 THEN 3 ELSE 0 END AS sequence, event_id % 5 AS instrument_id
  FROM m1
)"""


def read_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record stream of small scenes, one for each event, whose outcome follows from the event by arithmetic.

    A bid and an ask arrive; the bid trades, partly hidden, and is removed; an order follows at its place after a short
    while, grows and is pulled; then the ask is pulled, or a clear comes with a snapshot order behind it. Prices may be
    negative and, for some, the book is crossed. An instrument's book is empty between its scenes.
    """
    e = read_events(spark, sf_dir).withColumn("v", F.floor("value").cast("bigint"))
    e = e.selectExpr("event_id AS e", "us", "k", "v", "event_id * 1000000000 AS t", "CASE WHEN k % 3 = 0 THEN -(50 + k) ELSE 10000 - k END * 100000000 AS p", "CASE WHEN k % 11 = 0 THEN 0 ELSE 1 + k % 4 END * 100000000 AS g",
                     "1 + v % 20 AS a", "1 + k % 7 AS b", "1 + (v + k) % 20 AS c", "(1 + k % 5) * 500000 AS dt")
    step = "named_struct('n', {n}, 'ts', t + {ts}, 'action', '{action}', 'side', '{side}', 'price', cast({price} as bigint), 'size', cast({size} as bigint), 'oid', cast({oid} as bigint), 'flags', {flags})"
    scene = [
        (0, "0", "A", "B", "p", "a", "10 * e + 1", 128), (1, "1000000", "A", "A", "p + g", "b", "10 * e + 2", 128), (2, "2000000", "T", "A", "p", "a + k % 3", "0", 0), (3, "2000000", "F", "B", "p", "a + k % 3", "10 * e + 1", 0),
        (4, "2000000", "C", "B", "p", "a", "10 * e + 1", 128), (5, "2000000 + dt", "A", "B", "p", "c", "10 * e + 3", 128), (6, "6000000", "M", "B", "p", "c + 1", "10 * e + 3", 128), (7, "7000000", "C", "B", "p", "c + 1", "10 * e + 3", 128),
    ]
    pulled = [(8, "8000000", "C", "A", "p + g", "b", "10 * e + 2", 128)]
    cleared = [(8, "8000000", "R", "N", "0", "0", "0", 0), (9, "8000000", "A", "B", "p", "2", "10 * e + 4", 160), (10, "9000000", "C", "B", "p", "2", "10 * e + 4", 128)]
    listed = lambda steps: "array(" + ", ".join(step.format(n=n, ts=ts, action=action, side=side, price=price, size=size, oid=oid, flags=flags) for n, ts, action, side, price, size, oid, flags in steps) + ")"
    rows = e.withColumn("s", F.explode(F.expr(f"concat({listed(scene)}, if(k % 2 = 0, {listed(cleared)}, {listed(pulled)}))")))
    return rows.select(
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int")).alias("session_date"), (F.col("e") * 20 + F.col("s.n")).alias("seq"), F.col("s.ts").alias("ts_event"), F.col("s.action").alias("action"), F.col("s.side").alias("side"),
        F.col("s.price").alias("price"), F.col("s.size").alias("size"), F.col("s.oid").alias("order_id"), F.col("s.flags").alias("flags"), F.lit(0).alias("channel_id"), (F.col("e") * 20 + F.col("s.n")).alias("sequence"), (F.col("e") % 5).alias("instrument_id"),
    )


#: The numbers of a scene for DuckDB; what comes of it is written down by the queries' own SQL, not replayed.
SCENE_SQL = """
scene AS (
  SELECT event_id AS e, CAST(make_date(CAST(epoch_us(ts) // 86400000000 AS INTEGER)) AS DATE) AS session_date, event_id % 5 AS instrument_id, event_id * 1000000000 AS t,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events
), act AS (
  SELECT *, CAST(CASE WHEN k % 3 = 0 THEN -(50 + k) ELSE 10000 - k END AS BIGINT) * 100000000 AS p, CAST(CASE WHEN k % 11 = 0 THEN 0 ELSE 1 + k % 4 END AS BIGINT) * 100000000 AS g,
    1 + v % 20 AS a, 1 + k % 7 AS b, 1 + (v + k) % 20 AS c, (1 + k % 5) * 500000 AS dt FROM scene
), play AS (
  SELECT *, a + k % 3 AS f, dt <= 2000000 AND c <= a AS linked, (1 - 0.5 * dt / 2000000) * CASE WHEN c = a THEN 1.0 ELSE 0.75 END AS conf, k % 2 = 0 AS cleared FROM act
)"""
