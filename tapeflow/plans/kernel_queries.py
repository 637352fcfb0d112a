"""Queries over the kernel's lifecycles and flow rows, scales, labels and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import evaluation as V
from tapeflow.operators import features as X
from tapeflow.operators import replay, samples, scales
from tapeflow.plans.catalog import query
from tapeflow.plans.feature_queries import FLOW, KEYS, SPEC, flow_rows
from tapeflow.sources.events import MBO_SQL, read_mbo

HOUR = 3_600_000_000_000


@query("lifecycle_records")
def lifecycle_records(spark, sf_dir):
    return replay.lifecycle(read_mbo(spark, sf_dir))


# Every order's life ends once: lives as runs of an order's records, ended by a cancel, a second add, or the day's end.
@query(
    "lifecycle_terminations",
    f"""WITH {MBO_SQL}, a AS (SELECT *, lag(action) OVER w AS before, lead(action) OVER w AS nxt FROM mbo WHERE action IN ('A', 'M', 'C') WINDOW w AS (PARTITION BY session_date, instrument_id, order_id ORDER BY seq)),
t AS (SELECT session_date, instrument_id, CASE WHEN action = 'C' AND before IS NOT NULL AND before <> 'C' THEN 'cancel' WHEN action <> 'C' AND nxt = 'A' THEN 'replaced' WHEN action <> 'C' AND nxt IS NULL THEN 'end_of_data' END AS how FROM a)
SELECT session_date, instrument_id, how, count(*) AS n FROM t WHERE how IS NOT NULL GROUP BY ALL""",
)
def lifecycle_terminations(spark, sf_dir):
    how = F.when(F.col("final_state").isin("filled", "partial_cancelled", "cancelled"), "cancel").otherwise(F.col("final_state"))
    return replay.lifecycle(read_mbo(spark, sf_dir)).groupBy("session_date", "instrument_id", how.alias("how")).agg(F.count(F.lit(1)).alias("n"))


@query("flow_primitives")
def flow_primitives(spark, sf_dir):
    return replay.flow(read_mbo(spark, sf_dir))


# The trades of every flow row, against a plain aggregation of the records by group.
@query(
    "flow_trades",
    f"""WITH {MBO_SQL}, g0 AS (SELECT *, CASE WHEN lag(ts_event) OVER w IS NULL OR lag(ts_event) OVER w <> ts_event OR (lag(flags) OVER w & 128) <> 0 THEN 1 ELSE 0 END AS o FROM mbo WINDOW w AS (PARTITION BY session_date ORDER BY seq)),
g AS (SELECT *, CAST(sum(o) OVER (PARTITION BY session_date ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_id FROM g0)
SELECT session_date, instrument_id, group_id, CAST(coalesce(sum(size) FILTER (side = 'B'), 0) AS BIGINT) AS t_buy, CAST(coalesce(sum(size) FILTER (side <> 'B'), 0) AS BIGINT) AS t_sell, max(price) AS t_px_high, min(price) AS t_px_low FROM g WHERE action = 'T' GROUP BY ALL""",
)
def flow_trades(spark, sf_dir):
    return replay.flow(read_mbo(spark, sf_dir)).where("t_buy + t_sell > 0").select("session_date", "instrument_id", "group_id", "t_buy", "t_sell", "t_px_high", "t_px_low")


QUOTES = """e AS (SELECT event_id, CAST((epoch_us(ts) // 3600000000) * 3600000000000 AS BIGINT) AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 20 AS v FROM events),
f AS (SELECT event_id % 5 AS instrument_id, event_id AS row_seq, ts, ts // 3600000000000 AS u, {cols} FROM e)""".format(cols=", ".join(f"{FLOW[c]} AS {c}" for c in ("valid", "bid_px", "ask_px", "t_buy", "t_sell", "depth_b_near", "depth_b_mid", "depth_a_near", "depth_a_mid")))
GRID = f"""WITH {QUOTES}, p AS (SELECT instrument_id, u, CAST(sum(t_buy + t_sell) AS BIGINT) AS volume, arg_max((bid_px + ask_px) / 2.0 / 100000000.0, row_seq) FILTER (valid = 1) AS mid, arg_max(depth_b_near + depth_b_mid + depth_a_near + depth_a_mid, row_seq) FILTER (valid = 1) AS depth FROM f GROUP BY ALL),
b AS (SELECT instrument_id, min(u) AS a, max(u) AS z FROM p GROUP BY ALL), s AS (SELECT instrument_id, unnest(range(a, z + 1)) AS u FROM b),
d AS (SELECT s.instrument_id, s.u, coalesce(p.volume, 0) AS volume, CAST(last_value(p.mid IGNORE NULLS) OVER w AS DOUBLE) AS mid, last_value(p.depth IGNORE NULLS) OVER w AS depth FROM s LEFT JOIN p USING (instrument_id, u) WINDOW w AS (PARTITION BY s.instrument_id ORDER BY s.u ROWS UNBOUNDED PRECEDING))"""


def grid_rows(spark, sf_dir):
    ok = F.col("valid") == 1
    rows = flow_rows(spark, sf_dir).select("instrument_id", "row_seq", "ts", (F.col("t_buy") + F.col("t_sell")).alias("volume"), F.when(ok, (F.col("bid_px") + F.col("ask_px")) / 2.0 / 1e8).alias("mid"), F.when(ok, F.col("depth_b_near") + F.col("depth_b_mid") + F.col("depth_a_near") + F.col("depth_a_mid")).alias("depth"))
    return scales.grid(rows, KEYS, HOUR)


@query("one_second_grid", f"{GRID} SELECT * FROM d")
def one_second_grid(spark, sf_dir):
    return grid_rows(spark, sf_dir)


H = (5, 12)


def scaled(spark, sf_dir):
    return scales.scales(grid_rows(spark, sf_dir), KEYS, H, 100, 10)


@query(
    "v_scale",
    f"{GRID} SELECT instrument_id, u, CASE WHEN count(volume) OVER w >= 10 THEN CAST(median(volume) OVER w AS DOUBLE) END AS v_scale FROM d WINDOW w AS (PARTITION BY instrument_id ORDER BY u ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)",
)
def v_scale(spark, sf_dir):
    return scaled(spark, sf_dir).select("instrument_id", "u", "v_scale")


@query(
    "sigma_scale",
    f"""{GRID}, m AS (SELECT instrument_id, u, abs(mid - lag(mid, 5) OVER w) * 0.1 AS a, abs(mid - lag(mid, 12) OVER w) * 0.1 AS b FROM d WHERE mid IS NOT NULL WINDOW w AS (PARTITION BY instrument_id ORDER BY u)),
x AS (SELECT instrument_id, u, round(CASE WHEN count(a) OVER w >= 10 THEN median(a) OVER w END, 6) AS sigma_5s FROM m WHERE a IS NOT NULL WINDOW w AS (PARTITION BY instrument_id ORDER BY u ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
y AS (SELECT instrument_id, u, round(CASE WHEN count(b) OVER w >= 10 THEN median(b) OVER w END, 6) AS sigma_12s FROM m WHERE b IS NOT NULL WINDOW w AS (PARTITION BY instrument_id ORDER BY u ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT d.instrument_id, d.u, sigma_5s, sigma_12s FROM d LEFT JOIN x USING (instrument_id, u) LEFT JOIN y USING (instrument_id, u)""",
)
def sigma_scale(spark, sf_dir):
    return scaled(spark, sf_dir).select("instrument_id", "u", F.round("sigma_5s", 6).alias("sigma_5s"), F.round("sigma_12s", 6).alias("sigma_12s"))


@query("norm_twins")
def norm_twins(spark, sf_dir):
    rows = X.features(flow_rows(spark, sf_dir), KEYS, SPEC)
    return scales.normalize(scales.attach(rows, scaled(spark, sf_dir), KEYS, HOUR), {"s": 2, "m": 6, "l": 24}, "sigma_12s")


@query("percentile_tracker")
def percentile_tracker(spark, sf_dir):
    rows = X.features(flow_rows(spark, sf_dir), KEYS, SPEC).select("instrument_id", "row_seq", "ts", "trade_burst_intensity_s")
    return scales.tracked(rows, KEYS, "trade_burst_intensity_s", HOUR, 100)


PATH = f"""WITH {QUOTES}, p AS (SELECT instrument_id, u, max(bid_px) AS bid_high, min(bid_px) AS bid_low, max(ask_px) AS ask_high, min(ask_px) AS ask_low, arg_max(bid_px, row_seq) AS bl, arg_max(ask_px, row_seq) AS al FROM f WHERE valid = 1 GROUP BY ALL),
b AS (SELECT instrument_id, min(u) AS a, max(u) AS z FROM f GROUP BY ALL), s AS (SELECT instrument_id, unnest(range(a, z + 1)) AS u FROM b),
d0 AS (SELECT s.instrument_id, s.u, bid_high, bid_low, ask_high, ask_low, last_value(bl IGNORE NULLS) OVER w AS bid_last, last_value(al IGNORE NULLS) OVER w AS ask_last FROM s LEFT JOIN p USING (instrument_id, u) WINDOW w AS (PARTITION BY s.instrument_id ORDER BY s.u ROWS UNBOUNDED PRECEDING)),
path AS (SELECT instrument_id, u, coalesce(bid_high, bid_last) AS bid_high, coalesce(bid_low, bid_last) AS bid_low, coalesce(ask_high, ask_last) AS ask_high, coalesce(ask_low, ask_last) AS ask_low, bid_last, ask_last, (bid_last + ask_last) / 2 AS mid_last FROM d0)"""


def path(spark, sf_dir):
    return scales.second_path(flow_rows(spark, sf_dir), KEYS, HOUR)


@query("second_path", f"{PATH} SELECT * FROM path")
def second_path(spark, sf_dir):
    return path(spark, sf_dir)


LABELS = f"""{PATH}, w AS (SELECT a.instrument_id, a.u, a.ask_high AS ask0, a.bid_low AS bid0, a.mid_last AS mid0, max(b.bid_high) AS bh, min(b.bid_low) AS bl, min(b.ask_low) AS al, max(b.ask_high) AS ah, count(b.u) AS n, arg_max(b.mid_last, b.u) AS m1,
  min(b.u) FILTER (b.bid_high = t.bh) AS ub, min(b.u) FILTER (b.ask_low = t.al) AS ua
  FROM path a JOIN (SELECT a.instrument_id, a.u, max(b.bid_high) AS bh, min(b.ask_low) AS al FROM path a LEFT JOIN path b ON a.instrument_id = b.instrument_id AND b.u BETWEEN a.u + 1 AND a.u + 6 GROUP BY ALL) t ON a.instrument_id = t.instrument_id AND a.u = t.u
  LEFT JOIN path b ON a.instrument_id = b.instrument_id AND b.u BETWEEN a.u + 1 AND a.u + 6 GROUP BY ALL),
l AS (SELECT instrument_id, u, n = 6 AND ask0 IS NOT NULL AND bid0 IS NOT NULL AS done, (bh - ask0) / 1e9 AS up, (ask0 - bl) / 1e9 AS up_adverse, (bid0 - al) / 1e9 AS down, (ah - bid0) / 1e9 AS down_adverse, ub - u AS t_up, ua - u AS t_down, (m1 - mid0) / 1e9 AS final_return FROM w)"""
MOVES = ("up", "up_adverse", "down", "down_adverse", "final_return")


@query("forward_labels", f"{LABELS} SELECT instrument_id, u, " + ", ".join(f"round(CASE WHEN done THEN {m} END, 9) AS {m}" for m in MOVES) + ", CASE WHEN done THEN t_up END AS t_up, CASE WHEN done THEN t_down END AS t_down, CASE WHEN done THEN 1 ELSE 0 END AS window_complete FROM l")
def forward_labels(spark, sf_dir):
    out = scales.labels(path(spark, sf_dir), KEYS, 6, 0.02, 2.0)
    return out.select("instrument_id", "u", *(F.round(m, 9).alias(m) for m in MOVES), "t_up", "t_down", "window_complete")


@query(
    "direction_class",
    f"""{LABELS}, g AS (SELECT *, up - 0.02 AS gu, down - 0.02 AS gd FROM l), c AS (SELECT *, gu > 0 AND gu >= 2 * (greatest(up_adverse, 0) + 0.02) AS bull, gd > 0 AND gd >= 2 * (greatest(down_adverse, 0) + 0.02) AS bear FROM g)
SELECT instrument_id, u, CAST(CASE WHEN NOT done THEN NULL WHEN bull AND bear THEN CASE WHEN gu >= gd THEN 1 ELSE 2 END WHEN bull THEN 1 WHEN bear THEN 2 ELSE 0 END AS INTEGER) AS direction FROM c""",
)
def direction_class(spark, sf_dir):
    return scales.labels(path(spark, sf_dir), KEYS, 6, 0.02, 2.0).select("instrument_id", "u", "direction")


SIGMA = "CASE WHEN u % 5 > 0 THEN (1 + u % 7) / 10.0 END"


@query("label_twins", f"{LABELS}, scaled AS (SELECT *, {SIGMA} AS sigma FROM l) SELECT instrument_id, u, " + ", ".join(f"round(CASE WHEN done THEN {m} / sigma END, 6) AS {m}_norm" for m in MOVES) + ", round(CASE WHEN done THEN t_up / 6.0 END, 6) AS t_up_frac, round(CASE WHEN done THEN t_down / 6.0 END, 6) AS t_down_frac, round(0.02 / sigma, 6) AS cost_norm FROM scaled")
def label_twins(spark, sf_dir):
    labelled = scales.labels(path(spark, sf_dir), KEYS, 6, 0.02, 2.0)
    sigma = F.when(F.col("u") % 5 > 0, (1 + F.col("u") % 7) / 10.0).otherwise(0.0)
    names = (*(f"{m}_norm" for m in MOVES), "t_up_frac", "t_down_frac", "cost_norm")
    return scales.label_twins(labelled, sigma, 6, 0.02).select("instrument_id", "u", *(F.round(n, 6).alias(n) for n in names))


# Greedy picks by recursion over a stream's candidates: an event kind twice at most, then an hour after the last pick.
@query(
    "greedy_pick",
    f"""WITH RECURSIVE {QUOTES}, c AS (SELECT instrument_id, row_seq, ts + (row_seq % 2) * 1800000000000 AS t, (row_seq * 7) % 4 AS kind FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY t, row_seq) AS i FROM c WHERE kind < 3),
w AS (SELECT instrument_id, i, row_seq, true AS take, t AS last, CASE WHEN kind = 1 THEN 1 ELSE 0 END AS a, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS b FROM o WHERE i = 1
  UNION ALL SELECT z.instrument_id, z.i, z.row_seq, z.take, CASE WHEN z.take THEN z.t ELSE z.last END, z.a + CASE WHEN z.take AND z.kind = 1 THEN 1 ELSE 0 END, z.b + CASE WHEN z.take AND z.kind = 2 THEN 1 ELSE 0 END
  FROM (SELECT o.*, w.last, w.a, w.b, (o.kind = 0 OR (o.kind = 1 AND w.a < 2) OR (o.kind = 2 AND w.b < 2)) AND o.t - w.last >= {HOUR} AS take FROM w JOIN o ON o.instrument_id = w.instrument_id AND o.i = w.i + 1) z)
SELECT instrument_id, row_seq FROM w WHERE take""",
)
def greedy_pick(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("clock", "sweep", "vacuum"))), (F.least(F.col("row_seq") * 7 % 4, F.lit(2)) + 1).cast("int"))
    c = flow_rows(spark, sf_dir).select("instrument_id", "row_seq", (F.col("ts") + (F.col("row_seq") % 2) * (HOUR // 2)).alias("ts"), F.when(F.col("row_seq") * 7 % 4 < 3, kind).alias("trigger"), F.lit(True).alias("active"))
    return samples.greedy_pick(c, KEYS, HOUR, 2).select("instrument_id", "row_seq")


@query("half_second_slots", f"WITH {QUOTES}, s AS (SELECT instrument_id, row_seq, ts // 1800000000000 AS slot0, (ts + (row_seq % 2) * 1800000000000) AS t FROM f), r AS (SELECT *, t // 1800000000000 AS slot FROM s) SELECT instrument_id, row_seq, slot, slot % 2 = 0 AS clock FROM r QUALIFY row_number() OVER (PARTITION BY instrument_id, slot ORDER BY t, row_seq) = 1")
def half_second_slots(spark, sf_dir):
    rows = flow_rows(spark, sf_dir).select("instrument_id", "row_seq", (F.col("ts") + (F.col("row_seq") % 2) * (HOUR // 2)).alias("ts"))
    return samples.half_slots(rows, KEYS, HOUR // 2).drop("ts")


def picked(spark, sf_dir):
    rows = scales.normalize(scales.attach(X.features(flow_rows(spark, sf_dir), KEYS, SPEC), scaled(spark, sf_dir), KEYS, HOUR), {"s": 2, "m": 6, "l": 24}, "sigma_12s")
    rows = rows.withColumn("ts", F.col("ts") + (F.col("row_seq") % 2) * (HOUR // 2))
    slots = samples.with_triggers(samples.half_slots(rows, KEYS, HOUR // 2), KEYS).withColumn("active", F.col("norm_ready") == 1)
    return samples.greedy_pick(slots.select("instrument_id", "row_seq", "ts", "trigger", "active"), KEYS, HOUR, 300)


@query("greedy_samples")
def greedy_samples(spark, sf_dir):
    return picked(spark, sf_dir)


def flagged(spark, sf_dir):
    return flow_rows(spark, sf_dir).select("instrument_id", "row_seq", "ts", (F.col("row_seq") % 3 != 0).alias("trainable"))


UNIQUE = f"""WITH {QUOTES}, t AS (SELECT instrument_id, row_seq, u, row_seq % 3 <> 0 AS trainable FROM f), x AS (SELECT instrument_id, row_seq, unnest(range(u + 1, u + 9)) AS s FROM t WHERE trainable),
c AS (SELECT instrument_id, s, count(*) AS n FROM x GROUP BY ALL), w AS (SELECT instrument_id, row_seq, sum(CAST(1 AS DOUBLE) / n) / 8 AS w FROM x JOIN c USING (instrument_id, s) GROUP BY ALL)"""


@query("uniqueness_weights", f"{UNIQUE} SELECT t.instrument_id, t.row_seq, round(coalesce(w, 0), 9) AS uniqueness FROM t LEFT JOIN w USING (instrument_id, row_seq)")
def uniqueness_weights(spark, sf_dir):
    return samples.uniqueness(flagged(spark, sf_dir), KEYS, 8, HOUR).select("instrument_id", "row_seq", F.round("uniqueness", 9).alias("uniqueness"))


@query("effective_n_summary", f"{UNIQUE} SELECT t.instrument_id, count(*) AS rows, count(*) FILTER (trainable) AS trainable, round(coalesce(sum(w), 0), 4) AS effective_n FROM t LEFT JOIN w USING (instrument_id, row_seq) GROUP BY t.instrument_id")
def effective_n_summary(spark, sf_dir):
    s = samples.uniqueness(flagged(spark, sf_dir), KEYS, 8, HOUR)
    return s.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("trainable"), 1)).alias("trainable"), F.round(F.sum("uniqueness"), 4).alias("effective_n"))


@query("model_inputs")
def model_inputs(spark, sf_dir):
    rows = flow_rows(spark, sf_dir).withColumns({c: V.signed_log(F.col(c)) for c in ("t_buy", "t_sell", "flow_b_1", "flow_a_1")})
    return samples.padded_inputs(rows.select("instrument_id", "row_seq", "ts", "t_buy", "t_sell", "flow_b_1", "flow_a_1"), KEYS, ["t_buy", "t_sell", "flow_b_1", "flow_a_1"], 32).drop("t_buy", "t_sell", "flow_b_1", "flow_a_1")


# Records that meet no resting order, or one too many, from the order's record before.
@query(
    "book_incidents",
    f"""WITH {MBO_SQL}, a AS (SELECT *, lag(action) OVER (PARTITION BY session_date, instrument_id, order_id ORDER BY seq) AS before FROM mbo WHERE action IN ('A', 'M', 'C')),
k AS (SELECT session_date, instrument_id, CASE WHEN action = 'A' AND before IN ('A', 'M') THEN 'incident_duplicate_add' WHEN action = 'M' AND (before IS NULL OR before = 'C') THEN 'incident_unknown_modify' WHEN action = 'C' AND (before IS NULL OR before = 'C') THEN 'incident_unknown_cancel' END AS counter FROM a)
SELECT session_date, instrument_id, counter, count(*) AS n FROM k WHERE counter IS NOT NULL GROUP BY ALL""",
)
def book_incidents(spark, sf_dir):
    return replay.kernel_counters(read_mbo(spark, sf_dir)).where(F.col("counter").isin("incident_duplicate_add", "incident_unknown_modify", "incident_unknown_cancel"))


@query("incident_log")
def incident_log(spark, sf_dir):
    """Every kind in one log; a limit of records for each session is the feature."""
    return replay.incident_log(read_mbo(spark, sf_dir))


@query("kernel_counters")
def kernel_counters(spark, sf_dir):
    return replay.kernel_counters(read_mbo(spark, sf_dir))


REGIME = ", ".join(f"""round((SELECT sum(CASE WHEN b.volume < d.volume THEN 2.0 WHEN b.volume = d.volume THEN 1.0 ELSE 0.0 END) / 2 / nullif(count(*), 0) FROM d b WHERE b.instrument_id = d.instrument_id AND b.u BETWEEN d.u - {n} AND d.u - 1), 6) AS volume_pct_{n}""" for n in (6, 24, 72))


@query("regime_percentiles", f"{GRID} SELECT instrument_id, u, {REGIME} FROM d")
def regime_percentiles(spark, sf_dir):
    out = samples.regime_percentiles(grid_rows(spark, sf_dir), KEYS, ["volume"], [6, 24, 72])
    return out.select("instrument_id", "u", *(F.round(f"volume_pct_{n}", 6).alias(f"volume_pct_{n}") for n in (6, 24, 72)))


def model_rows(spark, sf_dir):
    """Features of every row with the direction of the bid over the next hours as label."""
    rows = X.features(flow_rows(spark, sf_dir), KEYS, SPEC)
    labelled = scales.labels(path(spark, sf_dir), KEYS, 6, 0.02, 2.0).where("window_complete = 1").select("instrument_id", "u", "direction", "final_return")
    joined = rows.withColumn("u", F.floor(F.col("ts") / HOUR).cast("bigint")).join(labelled, ["instrument_id", "u"])
    return joined.withColumn("session", F.floor(F.col("ts") / (24 * HOUR)).cast("int"))


#: All features but the absolute price; the last twenty carry a sign (the reference's signed_v2).
COLUMNS = [n for n, _ in X.formulas(SPEC) if n != "mid_ticks"]
SIGNED = COLUMNS[COLUMNS.index("liquidity_age_imbalance") :]
FEATURE_SETS = {"v1": [c for c in COLUMNS if c not in SIGNED], "v1 + signed_v2": COLUMNS, "signed_v2 only": SIGNED}
#: Training windows of the gate as shares of the training sessions, the latest ones (a year, three years and all of about six and a half).
WINDOWS = {"12m": 0.15, "3y": 0.45, "full": 1.0}


def held_out_sessions(rows):
    """(training rows, held-out rows): the last two fifths of the sessions are held out, rows whose label reaches into them are purged."""
    border = rows.agg(F.percentile("session", F.lit(0.6))).first()[0]
    train, test = rows.where(F.col("session") <= border), rows.where(F.col("session") > border)
    start = test.agg(F.min("ts")).first()[0]
    return (train if start is None else V.purge(train, start)), test


def split_rows(spark, sf_dir):
    """model_rows with the label's end, kept for many fits; unpersist when done."""
    rows = model_rows(spark, sf_dir).withColumn("label_end_ts", (F.col("u") + 7) * HOUR)
    return rows.select("instrument_id", "row_seq", "ts", "label_end_ts", "session", "direction", "final_return", *COLUMNS).persist()


@query("model_a_gate")
def model_a_gate(spark, sf_dir):
    """A verdict row for each training window, without and with uniqueness weights, on the same held-out sessions."""
    from tapeflow.operators import model

    rows = split_rows(spark, sf_dir)
    train, test = held_out_sessions(rows)
    ends = train.agg(F.min("session").alias("a"), F.max("session").alias("z")).first()
    out = []
    for name, share in WINDOWS.items():
        if ends["z"] is None or not test.limit(1).count():
            break
        part = train.where(F.col("session") > ends["z"] - (ends["z"] - ends["a"] + 1) * share)
        part = samples.uniqueness(part.withColumn("trainable", F.col("direction").isNotNull()), KEYS, 6, HOUR).persist()
        for weight in (None, "uniqueness"):
            fitted = model.fit(part, COLUMNS, "direction", weight=weight)
            scored = model.predict(test, fitted).select("session", F.col("direction").alias("label"), "p0", "p1", "p2", F.col("final_return").alias("ret"), F.lit(False).alias("tagged"), *(F.lit(x).alias(f"train_p{i}") for i, x in enumerate(fitted.frequencies)))
            out.append({"train_window": name, "weighted": weight is not None, **V.gate(scored).first().asDict()})
        part.unpersist()
    rows.unpersist()
    money = "sessions long, trades long, expectancy double, without_best double, without_tagged double"
    schema = f"train_window string, weighted boolean, {money}, auc_1 double, auc_2 double, brier double, base_brier double, auc double, passed boolean"
    return spark.createDataFrame(out, schema)


@query("sign_diagnostic")
def sign_diagnostic(spark, sf_dir):
    """The area for up against down, given a move, on held-out sessions: a row for each feature set."""
    from tapeflow.operators import model

    rows = split_rows(spark, sf_dir)
    train, test = (x.where("direction > 0").withColumn("up", F.when(F.col("direction") == 1, 1).otherwise(0)) for x in held_out_sessions(rows))
    out = []
    for name, columns in FEATURE_SETS.items():
        auc = None
        if train.limit(1).count() and test.limit(1).count():
            scored = model.predict(test, model.fit(train, columns, "up", classes=2))
            auc = V.rank_auc(scored.select(F.col("p1").alias("s"), (F.col("up") == 1).alias("y")), "s", "y").first()["auc"]
        out.append((name, len(columns), auc))
    rows.unpersist()
    return spark.createDataFrame(out, "feature_set string, features int, auc double")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Importance of every feature in the model of the training sessions."""
    from tapeflow.operators import model

    rows = split_rows(spark, sf_dir)
    out = model.importance(model.fit(held_out_sessions(rows)[0], COLUMNS, "direction"))
    rows.unpersist()
    return out
