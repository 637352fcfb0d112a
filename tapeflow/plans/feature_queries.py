"""Queries over the feature set, on flow rows derived from ``events`` by arithmetic, with the same text for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import features as X
from tapeflow.plans.catalog import query
from tapeflow.sources.events import read_events

HOUR = 3_600_000_000_000
SPEC = X.Spec(s=2 * HOUR, m=6 * HOUR, l=24 * HOUR, reclaim=6 * HOUR)
KEYS = ["instrument_id"]
#: A session's stream of an instrument: windows of features never cross it, and it is the unit of parallelism.
STREAM = ["session_date", "instrument_id"]

#: Portable expressions over event_id, k, v (value as a whole number): a stand-in for every column of a flow row.
FLOW: dict[str, str] = {
    "valid": "CASE WHEN k % 20 = 3 THEN 0 ELSE 1 END",
    "bid_px": "(10000 - k % 7) * 100000000",
    "ask_px": "(10001 + k % 5) * 100000000",
    "bid_sz": "1 + k % 13",
    "ask_sz": "1 + (k * 7) % 11",
    "bid_ct": "1 + k % 3",
    "ask_ct": "1 + k % 4",
    **{f"depth_{s}_{n}": f"{a} + (k * {b}) % {m}" for s, n, a, b, m in (("b", "near", 5, 3, 17), ("b", "mid", 7, 5, 19), ("b", "deep", 9, 7, 23), ("a", "near", 5, 11, 17), ("a", "mid", 7, 13, 19), ("a", "deep", 9, 17, 23))},
    **{f"flow_{s}_{i}": f"(k * {i + o} + v) % 11 - 5" for s, o in (("b", 1), ("a", 3)) for i in range(1, 11)},
    "t_buy": "CASE WHEN event_id % 3 = 0 THEN v ELSE 0 END",
    "t_sell": "CASE WHEN event_id % 4 = 1 THEN v ELSE 0 END",
    "t_buy_n": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END",
    "t_sell_n": "CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END",
    "t_px_high": "CASE WHEN event_id % 3 = 0 OR event_id % 4 = 1 THEN (10002 + k % 6) * 100000000 ELSE 0 END",
    "t_px_low": "CASE WHEN event_id % 3 = 0 OR event_id % 4 = 1 THEN (10002 + k % 6 - v % 3) * 100000000 ELSE 0 END",
    **{f"{n}_{s}": f"(v * {a} + k) % {m}" for n, a, m in (("add_best", 3, 7), ("add_near", 5, 9), ("pull_best", 7, 5), ("pull_near", 11, 8), ("fill", 13, 4), ("hidden", 17, 3), ("refill", 19, 2)) for s in "ba"},
    "term_filled": "v % 3",
    "term_pulled_touched": "k % 3",
    "term_pulled_untouched": "(v + k) % 2",
    "life_filled_sum": "v * 1000000",
    "life_pulled_sum": "k * 2000000",
    "term_filled_unchained": "v % 2",
    "life_filled_unchained_sum": "v * 500000",
    "term_pulled_unchained": "k % 2",
    "life_pulled_unchained_sum": "k * 1000000",
    "refill_conf_sum": "(v % 2) * 0.5",
    "age_best_b": "v * 1000000000",
    "age_best_a": "k * 1000000000",
    "stall_scale": "CASE WHEN k % 4 > 0 THEN CAST(0.1 AS DOUBLE) / (CAST(0.05 AS DOUBLE) + k % 3) END",
}


def flow_rows(spark, sf_dir):
    e = read_events(spark, sf_dir).withColumn("v", F.floor("value") % 20)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int"))
    return e.select(day.alias("session_date"), (F.col("event_id") % 5).alias("instrument_id"), F.col("event_id").alias("row_seq"), (F.floor(F.col("us") / 3_600_000_000) * HOUR).alias("ts"), *(F.expr(x).alias(n) for n, x in FLOW.items()))


PART = "PARTITION BY session_date, instrument_id"
H = {"s": SPEC.s, "m": SPEC.m, "l": SPEC.l}


def _two(f: str, e: str, k: int) -> tuple[str, str]:
    """An aggregate over the rows of strictly earlier times within the horizon, and over the row's own time so far."""
    return f"{f}({e}) OVER ({PART} ORDER BY ts RANGE BETWEEN {k - 1} PRECEDING AND 1 PRECEDING)", f"{f}({e}) OVER ({PART}, ts ORDER BY row_seq ROWS UNBOUNDED PRECEDING)"


def _total(e: str, h: str) -> str:
    a, b = _two("sum", e, H[h])
    return f"(coalesce({a}, 0) + coalesce({b}, 0))"


def _number(e: str, h: str) -> str:
    a, b = _two("count", e, H[h])
    return f"({a} + {b})"


def _least(e: str, h: str) -> str:
    a, b = _two("min", e, H[h])
    return f"least({a}, {b})"


def _sql() -> str:
    """Rows with what the formulas need besides sums: mids, past mids, sweeps and their ends."""
    order = f"({PART} ORDER BY ts, row_seq)"
    so_far = f"({PART} ORDER BY ts, row_seq ROWS UNBOUNDED PRECEDING)"
    same = "p.session_date = c.session_date AND p.instrument_id = c.instrument_id"
    past = lambda k: f"(SELECT arg_max(p.mid, p.row_seq) FROM b p WHERE {same} AND p.ts = (SELECT max(q.ts) FROM b q WHERE {same.replace('p.', 'q.')} AND q.ts <= c.ts - {H[k]} AND q.mid IS NOT NULL) AND p.mid IS NOT NULL)"
    return f"""WITH e AS (
  SELECT event_id, CAST(make_date(CAST(epoch_us(ts) // 86400000000 AS INTEGER)) AS DATE) AS session_date, CAST((epoch_us(ts) // 3600000000) * 3600000000000 AS BIGINT) AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 20 AS v FROM events
), f AS (
  SELECT session_date, event_id % 5 AS instrument_id, event_id AS row_seq, ts, {", ".join(f"{x} AS {n}" for n, x in FLOW.items())} FROM e
), a AS (
  SELECT *, last_value(CASE WHEN valid = 1 THEN (bid_px + ask_px) / 2.0 / 1e8 END IGNORE NULLS) OVER {so_far} AS mid0 FROM f
), a1 AS (
  SELECT *, CAST(mid0 AS DOUBLE) AS mid, CAST(lag(mid0) OVER {order} AS DOUBLE) AS pre_mid FROM a
), b AS (
  SELECT *, CASE WHEN valid = 1 THEN abs(mid - pre_mid) END AS moved, t_buy + t_sell > 0 AND (t_buy > 0) <> (t_sell > 0) AND (t_px_high - t_px_low) / 1e8 + 1 >= {SPEC.sweep_levels} AND mid IS NOT NULL AS sweeps,
    CAST((t_px_high - t_px_low) / 1e8 AS DOUBLE) AS swept, t_buy > 0 AS up FROM a1
), c0 AS (
  SELECT *, sum(CASE WHEN sweeps THEN 1 ELSE 0 END) OVER {so_far} AS sweep_n FROM b
), c AS (
  SELECT *, max(CASE WHEN sweeps THEN ts END) OVER g AS sweep_ts, max(CASE WHEN sweeps THEN CASE WHEN up THEN 1.0 ELSE -1.0 END END) OVER g AS sweep_dir0,
    max(CASE WHEN sweeps THEN coalesce(pre_mid, mid) END) OVER g AS sweep_from, max(CASE WHEN sweeps THEN CAST(CASE WHEN up THEN t_px_high ELSE t_px_low END / 1e8 AS DOUBLE) END) OVER g AS sweep_to
  FROM c0 WINDOW g AS ({PART}, sweep_n)
), d0 AS (
  SELECT *, {_total("moved", "m")} AS path_now, {past("s")} AS past_s, {past("m")} AS past_m, coalesce(ts - sweep_ts <= {SPEC.reclaim}, false) AS live, coalesce(CAST(sweep_dir0 AS DOUBLE), 0) AS sweep_dir FROM c
), d AS (
  SELECT *, CASE WHEN live AND abs(sweep_to - sweep_from) > 0 THEN least(greatest((CASE WHEN sweep_dir > 0 THEN sweep_to - mid ELSE mid - sweep_to END) / abs(sweep_to - sweep_from), 0), 1) ELSE 0.0 END AS retraced FROM d0
), e1 AS (
  SELECT *, coalesce(last_value(CASE WHEN valid = 1 THEN path_now END IGNORE NULLS) OVER {so_far}, 0) AS path, max(retraced) OVER ({PART}, sweep_n ORDER BY ts, row_seq ROWS UNBOUNDED PRECEDING) AS most FROM d
), e2 AS (
  SELECT *, CASE WHEN lag(live) OVER w AND (sweeps OR NOT live) AND lag(most) OVER w >= {SPEC.failed_retrace} THEN lag(sweep_dir) OVER w END AS failed FROM e1 WINDOW w AS {order}
)"""


def _ratio(a: str, b: str, neutral: str = "0.0") -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {neutral} END"


def _stated() -> dict[str, str]:
    """Every feature as its definition states it, over the columns of a flow row; nothing of the engine's own formulas."""
    T, N, R = _total, _number, _ratio  # noqa: N806
    share = f"{SPEC.s}.0 / {SPEC.l}"
    out = {"mid_ticks": "mid", "spread_ticks": "CASE WHEN valid = 1 THEN (ask_px - bid_px) / 1e8 END"}
    for h in "sml":
        buy, sell = T("t_buy", h), T("t_sell", h)
        out[f"aggr_delta_{h}"], out[f"aggr_delta_ratio_{h}"] = f"{buy} - {sell}", R(f"{buy} - {sell}", f"{buy} + {sell}")
    progress = {h: f"coalesce(mid - past_{h}, 0)" for h in "sm"}
    out |= {f"price_progress_ticks_{h}": x for h, x in progress.items()}
    out["directional_efficiency_m"] = R(f"abs({progress['m']})", "path")
    out["price_impact_m"] = R(f"abs({progress['m']})", T("t_buy + t_sell", "m"))
    stall = f"1.0 / (1.0 + abs({progress['s']}) * coalesce(stall_scale, 1.0))"
    burst = lambda e: R(T(e, "s"), f"{T(e, 's')} + {T(e, 'l')} * {share}")
    restored = lambda x, h: R(T(f"add_best_{x}", h), T(f"add_best_{x} + fill_{x} + pull_best_{x}", h), "0.5")
    out["absorption_bid_s"] = f"({burst('t_sell')}) * ({stall}) * ({restored('b', 's')})"
    out["absorption_ask_s"] = f"({burst('t_buy')}) * ({stall}) * ({restored('a', 's')})"
    out["trade_burst_intensity_s"] = burst("t_buy_n + t_sell_n")
    freed = R(T("refill_conf_sum", "l"), T("refill_b + refill_a", "l"))
    for side, x in (("bid", "b"), ("ask", "a")):
        out[f"replenish_{side}_m"] = restored(x, "m")
        out[f"stacking_{side}_m"] = R(T(f"add_near_{x} - pull_near_{x}", "m"), T(f"add_near_{x} + pull_near_{x}", "m"))
        out[f"queue_depletion_{side}_s"] = R(T(f"fill_{x}", "s"), f"{T(f'fill_{x}', 's')} + {side}_sz")
        out[f"queue_turnover_{side}_m"] = R(T(f"add_best_{x} + pull_best_{x}", "m"), f"{T(f'add_best_{x} + pull_best_{x}', 'm')} + {side}_sz")
        often = R(T(f"refill_{x}", "l"), f"{T(f'refill_{x}', 'l')} + {SPEC.iceberg_k}")
        hidden = R(T(f"hidden_{x}", "l"), T(f"hidden_{x} + fill_{x}", "l"))
        out[f"iceberg_score_{side}_l"] = f"1.0 - (1.0 - ({often}) * ({freed})) * (1.0 - ({hidden}))"
        mean, low = f"({T(f'depth_{x}_near', 'l')} * 1.0 / {N(f'depth_{x}_near', 'l')})", _least(f"depth_{x}_near", "m")
        out[f"liquidity_vacuum_{'down' if x == 'b' else 'up'}"] = f"CASE WHEN {mean} <> 0 THEN 1.0 - ({R(f'depth_{x}_near', f'depth_{x}_near + {mean}', '0.5')}) ELSE 0.5 END"
        out[f"book_resiliency_{side}"] = f"CASE WHEN {mean} <= {low} THEN 1.0 ELSE least(greatest((depth_{x}_near - {low}) / ({mean} - {low}), 0.0), 1.0) END"
        out[f"liquidity_age_{side}_s"] = f"age_best_{x} / 1e9"
    bands = {"1": "flow_b_1 - flow_a_1", "near": "flow_b_1 + flow_b_2 + flow_b_3 - flow_a_1 - flow_a_2 - flow_a_3", "middle": "flow_b_4 + flow_b_5 + flow_b_6 - flow_a_4 - flow_a_5 - flow_a_6", "deep": "flow_b_7 + flow_b_8 + flow_b_9 + flow_b_10 - flow_a_7 - flow_a_8 - flow_a_9 - flow_a_10"}
    out |= {f"mlofi_{n}_{h}": T(bands[n], h) for n, h in (("1", "s"), ("near", "s"), ("middle", "s"), ("deep", "s"), ("near", "m"), ("middle", "m"), ("deep", "m"))}
    gross = {"1": "abs(flow_b_1) + abs(flow_a_1)", "near": "abs(flow_b_1) + abs(flow_b_2) + abs(flow_b_3) + abs(flow_a_1) + abs(flow_a_2) + abs(flow_a_3)"}
    out |= {f"flow_imbalance_{n}_{h}": R(T(bands[n], h), T(gross[n], h)) for n, h in (("1", "s"), ("near", "s"), ("near", "m"))}
    out["book_imbalance_l1"] = f"CASE WHEN valid = 1 THEN {R('bid_sz - ask_sz', 'bid_sz + ask_sz')} ELSE 0.0 END"
    out["book_imbalance_near"] = R("depth_b_near - depth_a_near", "depth_b_near + depth_a_near")
    whole_b, whole_a = "(depth_b_near + depth_b_mid + depth_b_deep)", "(depth_a_near + depth_a_mid + depth_a_deep)"
    out["book_imbalance_total"] = R(f"{whole_b} - {whole_a}", f"{whole_b} + {whole_a}")
    outer_b, outer_a = "(depth_b_mid + depth_b_deep)", "(depth_a_mid + depth_a_deep)"
    out["book_imbalance_outer"] = R(f"{outer_b} - {outer_a}", f"{outer_b} + {outer_a}")
    out["depth_concentration_tilt"] = f"({R('depth_b_near', whole_b, '0.5')}) - ({R('depth_a_near', whole_a, '0.5')})"
    out["microprice_disp_ticks"] = "CASE WHEN valid = 1 AND bid_sz + ask_sz > 0 THEN (CAST(bid_px AS DOUBLE) * ask_sz + CAST(ask_px AS DOUBLE) * bid_sz) / (bid_sz + ask_sz) / 1e8 - mid ELSE 0.0 END"
    out["sweep_buy_ticks_m"], out["sweep_sell_ticks_m"] = T("CASE WHEN sweeps AND up THEN swept ELSE 0 END", "m"), T("CASE WHEN sweeps AND NOT up THEN swept ELSE 0 END", "m")
    out["sweep_failure_score"], out["sweep_failure_signed"] = "retraced", "-sweep_dir * retraced + 0.0"
    out["failed_sweeps_l"] = N("failed", "l")
    out["failed_sweep_net_ratio_l"] = f"-({R(T('failed', 'l'), N('failed', 'l'))}) + 0.0"
    out["liquidity_survival_ratio_l"] = R(T("term_filled", "l"), T("term_filled + term_pulled_touched", "l"), "0.5")
    out["cancel_before_touch_rate_l"] = R(T("term_pulled_untouched", "l"), T("term_pulled_touched + term_pulled_untouched", "l"), "0.5")
    out["order_lifetime_ms_l"] = f"({R(T('life_filled_sum + life_pulled_sum', 'l'), T('term_filled + term_pulled_touched + term_pulled_untouched', 'l'))}) / 1e6"
    out["order_lifetime_chain_adj_ms_l"] = f"({R(T('life_filled_unchained_sum + life_pulled_unchained_sum', 'l'), T('term_filled_unchained + term_pulled_unchained', 'l'))}) / 1e6"
    out["liquidity_age_imbalance"] = R("age_best_b - age_best_a", "age_best_b + age_best_a")
    out |= {f"fill_imbalance_{h}": R(T("fill_a - fill_b", h), T("fill_a + fill_b", h)) for h in "sm"}
    out["hidden_fill_imbalance_l"] = R(T("hidden_b - hidden_a", "l"), T("hidden_b + hidden_a", "l"))
    out["pull_imbalance_m"] = R(T("pull_best_a + pull_near_a - pull_best_b - pull_near_b", "m"), T("pull_best_a + pull_near_a + pull_best_b + pull_near_b", "m"))
    minus = {
        "absorption_net_s": ("absorption_bid_s", "absorption_ask_s"), "stacking_net_m": ("stacking_bid_m", "stacking_ask_m"), "iceberg_asym_l": ("iceberg_score_bid_l", "iceberg_score_ask_l"), "vacuum_tilt": ("liquidity_vacuum_up", "liquidity_vacuum_down"),
        "resiliency_tilt": ("book_resiliency_bid", "book_resiliency_ask"), "depletion_tilt_s": ("queue_depletion_ask_s", "queue_depletion_bid_s"), "replenish_tilt_m": ("replenish_bid_m", "replenish_ask_m"), "turnover_tilt_m": ("queue_turnover_bid_m", "queue_turnover_ask_m"),
        "imbalance_tilt": ("book_imbalance_near", "book_imbalance_outer"), "sweep_net_ticks_m": ("sweep_buy_ticks_m", "sweep_sell_ticks_m"),
    }
    return out | {n: f"({out[a]}) - ({out[b]})" for n, (a, b) in minus.items()}


STATED = _stated()
#: Values are compared in millionths. Features are ratios of small numbers, so halves of a millionth occur, where the last
#: bit of a sum would decide; cuts at this odd place meet none.
OFFSET = 0.318


def _family(name: str, members: list[str]) -> None:
    columns = ", ".join(f"floor(CAST({STATED[m]} AS DOUBLE) * 1e6 + {OFFSET}) / 1e6 AS {m}" for m in members)

    @query(name, f"{_sql()} SELECT session_date, instrument_id, row_seq, {columns} FROM e2")
    def run(spark, sf_dir):
        out = X.features(flow_rows(spark, sf_dir), STREAM, SPEC)
        return out.select(*STREAM, "row_seq", *((F.floor(F.col(m) * 1e6 + OFFSET) / 1e6).alias(m) for m in members))


FAMILIES = {
    "feature_reference": ["mid_ticks", "spread_ticks"],
    "aggr_delta": [f"aggr_delta_{h}" for h in "sml"] + [f"aggr_delta_ratio_{h}" for h in "sml"],
    "replenishment": ["replenish_bid_m", "replenish_ask_m", "replenish_tilt_m"],
    "price_progress": ["price_progress_ticks_s", "price_progress_ticks_m", "directional_efficiency_m", "price_impact_m"],
    "absorption": ["absorption_bid_s", "absorption_ask_s", "absorption_net_s"],
    "stacking": ["stacking_bid_m", "stacking_ask_m", "stacking_net_m", "pull_imbalance_m"],
    "mlofi": ["mlofi_1_s", "mlofi_near_s", "mlofi_middle_s", "mlofi_deep_s", "mlofi_near_m", "mlofi_middle_m", "mlofi_deep_m", "flow_imbalance_1_s", "flow_imbalance_near_s", "flow_imbalance_near_m"],
    "book_imbalance": ["book_imbalance_l1", "book_imbalance_near", "book_imbalance_total", "microprice_disp_ticks", "book_imbalance_outer", "imbalance_tilt", "depth_concentration_tilt"],
    "sweeps": ["sweep_buy_ticks_m", "sweep_sell_ticks_m", "sweep_failure_score", "failed_sweeps_l", "sweep_net_ticks_m", "sweep_failure_signed", "failed_sweep_net_ratio_l"],
    "queue_depletion": ["queue_depletion_bid_s", "queue_depletion_ask_s", "depletion_tilt_s", "queue_turnover_bid_m", "queue_turnover_ask_m", "turnover_tilt_m"],
    "survival": ["liquidity_survival_ratio_l", "cancel_before_touch_rate_l", "order_lifetime_ms_l", "order_lifetime_chain_adj_ms_l", "liquidity_age_bid_s", "liquidity_age_ask_s", "liquidity_age_imbalance"],
    "iceberg": ["iceberg_score_bid_l", "iceberg_score_ask_l", "iceberg_asym_l", "hidden_fill_imbalance_l", "fill_imbalance_s", "fill_imbalance_m"],
    "vacuum_resiliency": ["liquidity_vacuum_up", "liquidity_vacuum_down", "vacuum_tilt", "book_resiliency_bid", "book_resiliency_ask", "resiliency_tilt"],
    "burst_intensity": ["trade_burst_intensity_s"],
}
for _name, _members in FAMILIES.items():
    _family(_name, _members)


@query(
    "top_absorption",
    f"""{_sql()}, s AS (SELECT greatest({STATED["absorption_bid_s"]}, {STATED["absorption_ask_s"]}) AS best, abs({STATED["price_progress_ticks_s"]}) AS move FROM e2), q AS (SELECT quantile_cont(best, 0.9) - 1e-9 AS cut FROM s)
SELECT count(*) FILTER (best >= cut) AS top_rows, round(median(move) FILTER (best >= cut), 6) AS move_top, round(median(move), 6) AS move_all, median(move) FILTER (best >= cut) <= greatest(median(move), 1) AS calm FROM s, q""",
)
def top_absorption(spark, sf_dir):
    """Rows of the top tenth of absorption and how far prices move there and everywhere; the cut is a billionth lower, so
    that the last bit of a sum decides about no row."""
    from tapeflow.operators import evaluation

    rows = X.features(flow_rows(spark, sf_dir), STREAM, SPEC)
    out = evaluation.top_share(rows, ["absorption_bid_s", "absorption_ask_s"], "price_progress_ticks_s", slack=1e-9)
    return out.withColumns({c: F.round(c, 6) for c in ("move_top", "move_all")})


@query("order_flow_features")
def order_flow_features(spark, sf_dir):
    """All features of every row at once."""
    return X.features(flow_rows(spark, sf_dir), STREAM, SPEC)
