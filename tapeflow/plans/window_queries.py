"""Queries over the rolling primitives: events by user, hour by hour, with many rows to a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import windows as W
from tapeflow.plans.catalog import query
from tapeflow.sources.events import read_events

HOUR = 3_600_000_000_000
H = 6 * HOUR
ROWS = """WITH e AS (SELECT event_id % 5 AS grp, CAST((epoch_us(ts) // 3600000000) * 3600000000000 AS BIGINT) AS ts, event_id AS seq, CAST(1 + CAST(floor(value) AS BIGINT) % 20 AS BIGINT) AS v FROM events)"""
PEERS = "OVER (PARTITION BY grp, ts ORDER BY seq ROWS UNBOUNDED PRECEDING)"
C = W.Clock(["grp"])


def rows(spark, sf_dir):
    e = read_events(spark, sf_dir)
    return e.select((F.col("event_id") % 5).alias("grp"), (F.floor(F.col("us") / 3_600_000_000) * HOUR).alias("ts"), F.col("event_id").alias("seq"), (1 + F.floor("value") % 20).alias("v"))


def before(f: str, h: int = H) -> str:
    return f"{f} OVER (PARTITION BY grp ORDER BY ts RANGE BETWEEN {h - 1} PRECEDING AND 1 PRECEDING)"


@query("rolling_sums_peer_rule", f"{ROWS} SELECT a.grp, a.seq, CAST(sum(b.v) AS BIGINT) AS rolling FROM e a JOIN e b ON a.grp = b.grp AND b.ts > a.ts - {H} AND b.ts <= a.ts AND b.seq <= a.seq GROUP BY a.grp, a.seq")
def rolling_sums_peer_rule(spark, sf_dir):
    return rows(spark, sf_dir).select("grp", "seq", W.rolling_sum(C, F.col("v"), H).alias("rolling"))


@query("rolling_counts", f"{ROWS} SELECT a.grp, a.seq, count(*) AS rolling FROM e a JOIN e b ON a.grp = b.grp AND b.ts > a.ts - {H} AND b.ts <= a.ts AND b.seq <= a.seq GROUP BY a.grp, a.seq")
def rolling_counts(spark, sf_dir):
    return rows(spark, sf_dir).select("grp", "seq", W.rolling_count(C, F.col("v"), H).alias("rolling"))


@query("window_past_asof", f"{ROWS}, s AS (SELECT grp, ts, arg_max(v, seq) AS v FROM e GROUP BY ALL) SELECT e.grp, e.seq, s.v AS past FROM e ASOF LEFT JOIN s ON e.grp = s.grp AND s.ts <= e.ts - {H}")
def window_past_asof(spark, sf_dir):
    return rows(spark, sf_dir).select("grp", "seq", W.past_value(C, F.col("v"), H).alias("past"))


@query(
    "rolling_min_mean",
    f"{ROWS} SELECT a.grp, a.seq, min(b.v) AS low, max(b.v) AS high, round(avg(b.v), 6) AS mean FROM e a JOIN e b ON a.grp = b.grp AND b.ts > a.ts - {H} AND b.ts <= a.ts AND b.seq <= a.seq GROUP BY a.grp, a.seq",
)
def rolling_min_mean(spark, sf_dir):
    v = F.col("v")
    return rows(spark, sf_dir).select("grp", "seq", W.rolling_min(C, v, H).alias("low"), W.rolling_max(C, v, H).alias("high"), F.round(W.rolling_mean(C, v, H), 6).alias("mean"))


@query("rolling_median", f"{ROWS} SELECT grp, seq, CAST(median(v) OVER (PARTITION BY grp ORDER BY ts, seq ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS DOUBLE) AS mid FROM e")
def rolling_median(spark, sf_dir):
    return rows(spark, sf_dir).select("grp", "seq", W.rolling_median(C, F.col("v"), 21).alias("mid"))


RANKED = f"{ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, seq) AS n FROM e)"


@query(
    "rolling_percentile",
    f"""{RANKED} SELECT a.grp, a.seq, round(sum(CASE WHEN b.v < a.v THEN 2.0 WHEN b.v = a.v THEN 1.0 WHEN b.v IS NOT NULL THEN 0.0 END) / 2 / nullif(count(b.v), 0), 6) AS rank
  FROM r a LEFT JOIN r b ON a.grp = b.grp AND b.n BETWEEN a.n - 50 AND a.n - 1 GROUP BY a.grp, a.seq""",
)
def rolling_percentile(spark, sf_dir):
    return rows(spark, sf_dir).select("grp", "seq", F.round(W.mid_rank(C, F.col("v"), 50), 6).alias("rank"))


@query(
    "robust_z",
    f"""{ROWS}, m AS (SELECT *, median(v) OVER w AS mid FROM e WINDOW w AS (PARTITION BY grp ORDER BY ts, seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, abs(v - mid) AS dev FROM m), s AS (SELECT *, median(dev) OVER (PARTITION BY grp ORDER BY ts, seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS mad FROM d)
SELECT grp, seq, CASE WHEN mad IS NOT NULL THEN round((v - mid) / greatest(mad, 1e-9), 3) END AS z FROM s""",
)
def robust_z(spark, sf_dir):
    past = C.rows().rowsBetween(-50, -1)
    df = rows(spark, sf_dir).withColumn("mid", F.percentile("v", F.lit(0.5)).over(past)).withColumn("dev", F.abs(F.col("v") - F.col("mid")))
    df = df.withColumn("mad", F.percentile("dev", F.lit(0.5)).over(past))
    z = (F.col("v") - F.col("mid")) / F.greatest("mad", F.lit(1e-9))
    return df.select("grp", "seq", F.when(F.col("mad").isNotNull(), F.round(z, 3)).alias("z"))


@query("suffix_extreme", f"{ROWS}, s AS (SELECT *, sum(CASE WHEN v >= 18 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS seg FROM e) SELECT grp, seq, max(v) OVER w AS high, min(v) OVER w AS low FROM s WINDOW w AS (PARTITION BY grp, seg ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)")
def suffix_extreme(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("seg", F.sum(F.when(F.col("v") >= 18, 1).otherwise(0)).over(C.so_far()))
    return df.select("grp", "seq", W.running_extreme(C, F.col("v"), F.col("seg")).alias("high"), W.running_extreme(C, F.col("v"), F.col("seg"), False).alias("low"))


@query(
    "ring_buffer",
    f"""{RANKED} SELECT a.grp, a.seq, array_to_string(list_concat(list_transform(range(greatest(0, 4 - a.n)), lambda x: 0), (SELECT list(b.v ORDER BY b.n) FROM r b WHERE b.grp = a.grp AND b.n BETWEEN a.n - 3 AND a.n)), ',') AS held FROM r a""",
)
def ring_buffer(spark, sf_dir):
    return rows(spark, sf_dir).select("grp", "seq", F.array_join(W.ring(C, F.col("v"), 4, F.lit(0).cast("bigint")), ",").alias("held"))
