"""Queries over splits, metrics, the gate and standardization."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import evaluation as V
from tapeflow.plans.catalog import query
from tapeflow.sources.events import read_events, read_mbo

DAYS = "d AS (SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events)"
EV = "e AS (SELECT event_id, epoch_us(ts) * 1000 AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS session, value FROM events)"
START = 1_705_276_800_000_000_000  # 2024-01-15


def events(spark, sf_dir):
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int"))
    return read_events(spark, sf_dir).select("event_id", (F.col("us") * 1000).alias("ts"), "k", day.alias("session"), "value")


@query("frozen_segment", f"WITH {DAYS} SELECT session_date, CASE WHEN session_date <= DATE '2024-01-15' THEN 'train' WHEN session_date <= DATE '2024-01-20' THEN 'validate' WHEN session_date <= DATE '2024-01-25' THEN 'test' ELSE 'holdout' END AS segment FROM d")
def frozen_segment(spark, sf_dir):
    days = read_mbo(spark, sf_dir).select("session_date").distinct()
    return days.select("session_date", V.segment(F.col("session_date"), "2024-01-15", "2024-01-20", "2024-01-25").alias("segment"))


@query(
    "walk_forward_folds",
    f"""WITH {DAYS}, n AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS n, count(*) OVER () AS c FROM d), f AS (SELECT unnest(range(0, 20)) AS fold)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN n - fold * 3 < 10 THEN 'train' WHEN n - fold * 3 < 11 THEN 'embargo' ELSE 'eval' END AS role, session_date FROM n, f WHERE n - fold * 3 BETWEEN 0 AND 13 AND fold * 3 + 14 <= c""",
)
def walk_forward_folds(spark, sf_dir):
    return V.walk_forward(read_mbo(spark, sf_dir).select("session_date"), 10, 3, 1)


def samples(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "ts", (F.col("ts") + 600 * 10**9 * (1 + F.col("k") % 20)).alias("label_end_ts"), F.when(F.col("k") % 3 == 0, 0).otherwise(1).alias("trainable"), (F.col("k") / 100).alias("uniqueness"))


SAMPLES = f"WITH {EV}, s AS (SELECT event_id, ts, ts + 600000000000 * (1 + k % 20) AS label_end_ts, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS trainable, k / 100 AS uniqueness FROM e)"


@query("purge", f"{SAMPLES} SELECT event_id, ts FROM s WHERE label_end_ts < {START} AND ts < {START} - 600000000000")
def purge(spark, sf_dir):
    return V.purge(samples(spark, sf_dir), START).select("event_id", "ts")


@query("purge_audit", f"{SAMPLES}, k AS (SELECT *, label_end_ts < {START} AND ts < {START} - 600000000000 AS kept FROM s) SELECT count(*) AS input_rows, count(*) FILTER (NOT kept) AS purged, count(*) FILTER (kept) AS kept, round(coalesce(sum(uniqueness) FILTER (kept AND trainable = 1), 0), 6) AS effective_n FROM k")
def purge_audit(spark, sf_dir):
    return V.purge_audit(samples(spark, sf_dir), START).withColumn("effective_n", F.round("effective_n", 6))


@query("rank_auc", f"WITH {EV}, s AS (SELECT session, k, event_id % 3 = 0 AS y FROM e) SELECT a.session, round(avg(CASE WHEN a.k > b.k THEN 1.0 WHEN a.k = b.k THEN 0.5 ELSE 0.0 END), 6) AS auc FROM s a JOIN s b ON a.session = b.session AND a.y AND NOT b.y GROUP BY a.session")
def rank_auc(spark, sf_dir):
    s = events(spark, sf_dir).select("session", "k", (F.col("event_id") % 3 == 0).alias("y"))
    return V.rank_auc(s, "k", "y", ["session"]).select("session", F.round("auc", 6).alias("auc"))


P3 = "p AS (SELECT *, (1 + k % 7) / (18.0 + k % 7 + event_id % 5) AS p0, (7 + event_id % 5) / (18.0 + k % 7 + event_id % 5) AS p1, 10 / (18.0 + k % 7 + event_id % 5) AS p2, event_id % 3 AS label FROM e)"


def scored(spark, sf_dir):
    e = events(spark, sf_dir)
    total = 18.0 + F.col("k") % 7 + F.col("event_id") % 5
    return e.select("*", ((1 + F.col("k") % 7) / total).alias("p0"), ((7 + F.col("event_id") % 5) / total).alias("p1"), (10 / total).alias("p2"), (F.col("event_id") % 3).alias("label"))


@query("brier", f"WITH {EV}, {P3} SELECT session, round(avg(power(p0 - CASE WHEN label = 0 THEN 1 ELSE 0 END, 2) + power(p1 - CASE WHEN label = 1 THEN 1 ELSE 0 END, 2) + power(p2 - CASE WHEN label = 2 THEN 1 ELSE 0 END, 2)), 6) AS brier FROM p GROUP BY session")
def brier(spark, sf_dir):
    return V.brier(scored(spark, sf_dir), ["p0", "p1", "p2"], "label", ["session"]).select("session", F.round("brier", 6).alias("brier"))


@query("model_gate")
def model_gate(spark, sf_dir):
    rows = scored(spark, sf_dir).select("session", "label", "p0", "p1", "p2", ((F.col("k") - 50) / 25).alias("ret"), (F.col("k") == 7).alias("tagged"), *(F.lit(1 / 3).alias(f"train_p{i}") for i in range(3)))
    return V.gate(rows)


@query("clock_thinning", f"WITH {EV}, s AS (SELECT event_id, session, ts, CASE WHEN k % 4 = 0 THEN 'sweep' ELSE 'clock' END AS trigger FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY session, trigger ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY session, trigger) AS c FROM s) SELECT event_id, session, trigger FROM n WHERE trigger <> 'clock' OR i % CAST(ceil(c / 50) AS BIGINT) = 0")
def clock_thinning(spark, sf_dir):
    s = events(spark, sf_dir).select("event_id", "session", "ts", F.when(F.col("k") % 4 == 0, "sweep").otherwise("clock").alias("trigger"))
    return V.thin_clock(s, 50, order=("ts", "event_id")).drop("ts")


@query("directional_filter", f"WITH {EV} SELECT event_id, CAST(k % 3 AS TINYINT) AS direction FROM e WHERE k % 2 = 1 AND k % 3 <> 0")
def directional_filter(spark, sf_dir):
    s = events(spark, sf_dir).select("event_id", (F.col("k") % 3).alias("direction"), (F.col("k") % 2).alias("trainable"))
    return V.directional(s, "direction", "trainable").drop("trainable")


@query("signed_log", f"WITH {EV} SELECT event_id, round(sign(value - 20) * ln(1 + abs(value - 20)), 6) AS x FROM e")
def signed_log(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(V.signed_log(F.col("value") - 20), 6).alias("x"))


@query(
    "standardize_winsorize",
    f"""WITH {EV}, m AS (SELECT median(value) AS a, median(CAST(k AS DOUBLE)) AS b FROM e), d AS (SELECT median(abs(value - a)) AS sa, median(abs(k - b)) AS sb FROM e, m),
z AS (SELECT event_id, (value - a) / sa AS x, (k - b) / sb AS y FROM e, m, d)
SELECT event_id, round(least(greatest(x, -2), 2), 6) AS value, round(least(greatest(y, -2), 2), 6) AS k, CAST((abs(x) > 2)::INTEGER + (abs(y) > 2)::INTEGER AS INTEGER) AS clipped FROM z""",
)
def standardize_winsorize(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "value", F.col("k").cast("double").alias("k"))
    out = V.standardize(e, V.robust_fit(e, ["value", "k"]), ["value", "k"], 2.0)
    return out.select("event_id", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"), "clipped")


FOLD, TRAIN, GAP, EVAL = 2, 10, 1, 3


# Sessions of the fold by their number, then the evaluation's first sample and what ends before it.
@query(
    "fold_frames",
    f"""{SAMPLES.replace("SELECT event_id, ts,", "SELECT event_id, session, ts,", 1)}, n AS (SELECT session, row_number() OVER (ORDER BY session) - 1 - {FOLD} * {EVAL} AS n FROM (SELECT DISTINCT session FROM e)),
t AS (SELECT s.* FROM s JOIN n USING (session) WHERE trainable = 1 AND n.n BETWEEN 0 AND {TRAIN - 1}), v AS (SELECT s.* FROM s JOIN n USING (session) WHERE trainable = 1 AND n.n BETWEEN {TRAIN + GAP} AND {TRAIN + GAP + EVAL - 1})
SELECT 'train' AS role, event_id FROM t WHERE label_end_ts < (SELECT min(ts) FROM v) AND ts < (SELECT min(ts) FROM v) - 600000000000 UNION ALL SELECT 'eval', event_id FROM v""",
)
def fold_frames(spark, sf_dir):
    s = samples(spark, sf_dir).join(events(spark, sf_dir).select("event_id", F.col("session").alias("session_date")), "event_id")
    s = s.withColumnsRenamed({"trainable": "h600_trainable", "uniqueness": "h600_uniqueness"})
    train, held, _ = V.load_fold(s, V.walk_forward(s.select("session_date"), TRAIN, EVAL, GAP), FOLD, 600)
    return train.select(F.lit("train").alias("role"), "event_id").unionByName(held.select(F.lit("eval").alias("role"), "event_id"))
