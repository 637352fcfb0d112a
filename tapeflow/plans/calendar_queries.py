"""Queries over calendars, phases, contracts and rolls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import calendar as K
from tapeflow.operators import rolls as R
from tapeflow.plans.catalog import query
from tapeflow.sources.events import micros, read_events, read_mbo

#: A test calendar over the days of the table: (UTC time, tier, name).
EVENTS = [(f"2024-01-{d:02d} {h}", t, n) for d, h, t, n in ((2, "13:30:00", "high", "jobs"), (5, "18:00:00", "medium", "auction"), (5, "19:00:00", "high", "decision"), (9, "14:00:00", "low", "survey"), (12, "13:30:00", "high", "prices"), (17, "18:00:00", "medium", "auction"), (19, "15:00:00", "low", "homes"), (25, "13:30:00", "high", "growth"))]
CAL_SQL = "cal AS (SELECT epoch_us(CAST(t AS TIMESTAMP)) * 1000 AS ts, CASE tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS tier, name FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EVENTS) + ") AS v(t, tier, name))"
ROWS_SQL = "r AS (SELECT event_id, epoch_us(ts) * 1000 AS ts FROM events)"
HOUR = 3_600_000_000_000


def calendar(spark):
    df = spark.createDataFrame(EVENTS, "t string, tier string, name string").withColumn("t", F.to_timestamp_ntz("t"))
    return df.select((micros("t", df) * 1000).alias("ts"), "name", "tier")


def rows(spark, sf_dir):
    return read_events(spark, sf_dir).select("event_id", (F.col("us") * 1000).alias("ts"))


def dated(spark, sf_dir):
    return K.attach(rows(spark, sf_dir), calendar(spark))


@query(
    "calendar_next_last",
    f"""WITH {CAL_SQL}, {ROWS_SQL} SELECT r.event_id, coalesce((n.ts - r.ts) / 1e9, 'Infinity'::DOUBLE) AS seconds_to_next, coalesce(n.tier, 0) AS next_tier, coalesce((r.ts - l.ts) / 1e9, 'Infinity'::DOUBLE) AS seconds_since_last, coalesce(l.tier, 0) AS last_tier
  FROM r ASOF LEFT JOIN cal n ON r.ts < n.ts ASOF LEFT JOIN cal l ON r.ts >= l.ts""",
)
def calendar_next_last(spark, sf_dir):
    return K.with_next_last(dated(spark, sf_dir)).drop("ts", K.EVENTS)


@query("blackout_semi_join", f"WITH {CAL_SQL}, {ROWS_SQL} SELECT event_id FROM r WHERE EXISTS (SELECT 1 FROM cal WHERE tier = 3 AND r.ts BETWEEN cal.ts - {HOUR} AND cal.ts + {2 * HOUR})")
def blackout_semi_join(spark, sf_dir):
    return dated(spark, sf_dir).where(K.in_blackout(F.col(K.EVENTS), F.col("ts"), HOUR, 2 * HOUR)).select("event_id")


@query(
    "label_policy_range_join",
    f"""WITH {CAL_SQL}, {ROWS_SQL}, m AS (SELECT r.event_id, max(CASE WHEN c.tier >= 2 THEN c.tier END) AS t FROM r LEFT JOIN cal c ON c.ts BETWEEN r.ts AND r.ts + {6 * HOUR} GROUP BY r.event_id)
SELECT event_id, CASE WHEN t = 3 THEN 'exclude' WHEN t = 2 THEN 'tag' ELSE 'ok' END AS policy FROM m""",
)
def label_policy_range_join(spark, sf_dir):
    return dated(spark, sf_dir).select("event_id", K.label_policy(F.col(K.EVENTS), F.col("ts"), F.col("ts") + 6 * HOUR).alias("policy"))


@query("calendar_coverage", f"WITH {CAL_SQL}, {ROWS_SQL} SELECT event_id, EXISTS (SELECT 1 FROM cal c WHERE c.ts >= r.ts - CAST(2 AS BIGINT) * 86400000000000 AND c.ts <= r.ts + CAST(2 AS BIGINT) * 86400000000000) AS covered FROM r")
def calendar_coverage(spark, sf_dir):
    return dated(spark, sf_dir).select("event_id", K.covered(F.col(K.EVENTS), F.col("ts"), F.col("ts"), 2).alias("covered"))


# In January the table's days are all five hours behind UTC in New York.
@query("session_id_et", "SELECT event_id, CAST(ts - INTERVAL 23 HOUR AS DATE) AS session_id FROM events")
def session_id_et(spark, sf_dir):
    return rows(spark, sf_dir).select("event_id", K.session_id(F.col("ts")).alias("session_id"))


@query(
    "session_phase",
    """WITH l AS (SELECT event_id, date_part('hour', ts - INTERVAL 5 HOUR) * 60 + date_part('minute', ts - INTERVAL 5 HOUR) AS m FROM events)
SELECT event_id, CASE WHEN m >= 180 AND m < 500 THEN 'london' WHEN m >= 500 AND m < 810 THEN 'ny' WHEN m >= 810 AND m < 1020 THEN 'post' WHEN m >= 1020 AND m < 1080 THEN 'maintenance' ELSE 'asia' END AS phase, m = 809 AS settlement FROM l""",
)
def session_phase(spark, sf_dir):
    return rows(spark, sf_dir).select("event_id", K.phase(F.col("ts")).alias("phase"), K.is_settlement(F.col("ts")).alias("settlement"))


@query("decision_calendar", "SELECT strftime(CAST(d AS TIMESTAMP) + CASE WHEN month(CAST(d AS DATE)) BETWEEN 4 AND 10 THEN INTERVAL 18 HOUR ELSE INTERVAL 19 HOUR END, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, 'FOMC' AS name, 'high' AS tier, 'federalreserve.gov' AS source FROM (VALUES ('2024-01-31'), ('2024-05-01'), ('2024-07-31'), ('2024-12-18')) v(d)")
def decision_calendar(spark, sf_dir):
    return K.decisions(spark, ["2024-01-31", "2024-05-01", "2024-07-31", "2024-12-18"])


SYMBOLS = ("GCG4", "GCJ4", "GCM4", "GCQ4", "GCZ4")


@query(
    "contract_decode",
    """WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS session_date, 'GC' || substr('FGHJKMNQUVXZ', CAST(1 + event_id % 12 AS INTEGER), 1) || CAST(event_id % 10 AS VARCHAR) AS symbol FROM events),
y AS (SELECT *, strpos('FGHJKMNQUVXZ', substr(symbol, 3, 1)) AS m, year(session_date) - 1 + ((CAST(substr(symbol, 4, 1) AS BIGINT) - (year(session_date) - 1)) % 10 + 10) % 10 AS y0 FROM s),
z AS (SELECT session_date, symbol, make_date(CASE WHEN session_date - make_date(y0, m, 28) > 60 THEN y0 + 10 ELSE y0 END, m, 1) AS delivery FROM y),
w AS (SELECT z.session_date, z.symbol, z.delivery, list(CAST(d AS DATE) ORDER BY d DESC) FILTER (isodow(d) <= 5) AS days FROM z, generate_series(CAST(z.delivery AS TIMESTAMP), CAST(last_day(z.delivery) AS TIMESTAMP), INTERVAL 1 DAY) AS g(d) GROUP BY ALL)
SELECT session_date, symbol, delivery, days[3] AS expiry FROM w""",
)
def contract_decode(spark, sf_dir):
    e = read_events(spark, sf_dir)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int"))
    symbol = F.concat(F.lit("GC"), F.substring(F.lit(R.MONTHS), (1 + F.col("event_id") % 12).cast("int"), F.lit(1)), (F.col("event_id") % 10).cast("string"))
    return R.with_contract(e.select(day.alias("session_date"), symbol.alias("symbol")).distinct())


def contracts(spark, sf_dir):
    """Traded volume by session of five contracts, the instruments of the feed, shifted so that leadership moves on."""
    v = read_mbo(spark, sf_dir).where("action = 'T'").groupBy("session_date", "instrument_id").agg(F.sum("size").alias("volume"))
    lead = F.abs(F.floor(F.dayofmonth("session_date") / 6) - F.col("instrument_id"))
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("instrument_id") + 1).cast("int"))
    return R.with_contract(v.select("session_date", symbol.alias("symbol"), (F.col("volume") * F.greatest(F.lit(1), 10 - 4 * lead)).cast("bigint").alias("volume")))


@query("roll_ledger")
def roll_ledger(spark, sf_dir):
    return R.roll_ledger(contracts(spark, sf_dir))


@query("roll_ledger_checks")
def roll_ledger_checks(spark, sf_dir):
    return R.ledger_checks(R.roll_ledger(contracts(spark, sf_dir)))


@query("calendar_gaps_anti_join", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events WHERE day(ts) % 7 <> 3), s AS (SELECT CAST(unnest(generate_series(CAST(min(session_date) AS TIMESTAMP), CAST(max(session_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS session_date FROM d) SELECT session_date FROM s WHERE isodow(session_date) <> 6 AND session_date NOT IN (SELECT session_date FROM d)")
def calendar_gaps_anti_join(spark, sf_dir):
    days = read_mbo(spark, sf_dir).select("session_date").distinct().where(F.dayofmonth("session_date") % 7 != 3)
    return R.calendar_gaps(days)


REPORTS_SQL = "rep AS (SELECT CAST(ts AS DATE) AS day, CASE event_id % 7 WHEN 0 THEN 'degraded' ELSE 'available' END AS condition, event_id AS n FROM events WHERE event_id % 97 < 5)"


def reports(spark, sf_dir):
    e = read_events(spark, sf_dir).where("event_id % 97 < 5")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int"))
    return e.select(day.alias("day"), F.when(F.col("event_id") % 7 == 0, "degraded").otherwise("available").alias("condition"), F.col("event_id").alias("n"))


@query("worst_condition", f"WITH {REPORTS_SQL} SELECT day, arg_max(condition, CASE condition WHEN 'degraded' THEN 1000000000000 ELSE 0 END + n) AS condition FROM rep GROUP BY day")
def worst_condition(spark, sf_dir):
    return R.worst_condition(reports(spark, sf_dir))


@query(
    "quality_mask",
    f"""WITH {REPORTS_SQL}, c AS (SELECT day, arg_max(condition, CASE condition WHEN 'degraded' THEN 1000000000000 ELSE 0 END + n) AS condition FROM rep GROUP BY day), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), p AS (SELECT day FROM d WHERE day(day) % 9 <> 4)
SELECT d.day, CASE WHEN p.day IS NULL THEN 'missing' WHEN c.condition = 'degraded' THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN p.day IS NULL THEN 'no file' WHEN c.condition = 'degraded' THEN 'reported degraded' ELSE '' END AS reason FROM d LEFT JOIN p USING (day) LEFT JOIN c USING (day)""",
)
def quality_mask(spark, sf_dir):
    days = read_mbo(spark, sf_dir).select(F.col("session_date").alias("day")).distinct()
    return R.quality_mask(days, days.where(F.dayofmonth("day") % 9 != 4), R.worst_condition(reports(spark, sf_dir)))


@query("symbology", f"WITH n AS (SELECT event_id % 7 AS instrument_id FROM events) SELECT instrument_id, CASE WHEN instrument_id < 5 THEN list_extract(['GCG4','GCJ4','GCM4','GCQ4','GCZ4'], CAST(instrument_id + 1 AS INTEGER)) ELSE 'iid:' || instrument_id END AS symbol, count(*) AS n FROM n GROUP BY ALL")
def symbology(spark, sf_dir):
    from tapeflow.sources.archive import with_symbols

    e = read_events(spark, sf_dir).select((F.col("event_id") % 7).alias("instrument_id"))
    names = spark.createDataFrame([(str(i), s) for i, s in enumerate(SYMBOLS)] + [("x", "SPREAD")], "id string, symbol string")
    return with_symbols(e, names).groupBy("instrument_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_hygiene",
    f"""WITH {CAL_SQL}, x AS (SELECT event_id, epoch_us(ts) * 1000 AS ts, ts AS moment, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), m AS (SELECT x.event_id, max(CASE WHEN c.tier >= 2 THEN c.tier END) AS t FROM x LEFT JOIN cal c ON c.ts BETWEEN x.ts AND x.ts + {6 * HOUR} GROUP BY x.event_id),
p AS (SELECT x.event_id, x.ts + {6 * HOUR} AS label_end_ts, CASE WHEN t = 3 THEN 'exclude' WHEN t = 2 THEN 'tag' ELSE 'ok' END AS release_policy, CASE WHEN EXISTS (SELECT 1 FROM cal c WHERE abs(c.ts - x.ts) <= CAST(45 AS BIGINT) * 86400000000000 + {6 * HOUR}) THEN 0.0 ELSE 1.0 END AS calendar_uncovered,
  CASE WHEN CAST(moment - INTERVAL 23 HOUR AS DATE) <> CAST(moment + INTERVAL 6 HOUR - INTERVAL 23 HOUR AS DATE) THEN 1.0 ELSE 0.0 END AS crosses_session, k FROM x JOIN m USING (event_id))
SELECT event_id, label_end_ts, release_policy, CAST(calendar_uncovered AS DOUBLE) AS calendar_uncovered, CAST(crosses_session AS DOUBLE) AS crosses_session, k AS f_k, k % 5 > 0 AND crosses_session = 0 AND release_policy <> 'exclude' AND k % 4 > 0 AS h6_trainable FROM p""",
)
def sample_hygiene(spark, sf_dir):
    from tapeflow.operators import samples

    e = read_events(spark, sf_dir).select("event_id", (F.col("us") * 1000).alias("ts"), "k")
    e = e.withColumns({"h6_window_complete": F.when(F.col("k") % 5 > 0, 1).otherwise(0), "h6_sigma_pts": (F.col("k") % 4) / 10, "stream": F.lit(1)})
    s = samples.with_horizon(samples.with_hygiene(e, calendar(spark), 6 * HOUR), ["stream"], 6, HOUR)
    return samples.capture(s, ["k"]).select("event_id", "label_end_ts", "release_policy", "calendar_uncovered", "crosses_session", "f_k", "h6_trainable")
