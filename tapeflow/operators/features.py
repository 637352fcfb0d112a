"""The 73 order-flow features of a flow table: window sums, then arithmetic.

The window pass and the arithmetic are separate projections, so sampled rows can be filtered between them. Ratios have
a neutral value where their denominator is not positive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.operators.folds import fold
from tapeflow.operators.windows import Clock, carried, past_value, rolling_count, rolling_min, rolling_sum
from tapeflow.schema import NANOS, TICK


@dataclass(frozen=True)
class Spec:
    """Horizons in the units of ts; sweeps: least levels, reclaim horizon, retraced share that fails; iceberg constant."""

    s: int = 2 * NANOS
    m: int = 10 * NANOS
    l: int = 60 * NANOS  # noqa: E741
    sweep_levels: int = 2
    reclaim: int = 10 * NANOS
    failed_retrace: float = 0.8
    iceberg_k: float = 4.0
    tick: int = TICK


def net(side_levels: range) -> str:
    return " + ".join(f"(flow_b_{i} - flow_a_{i})" for i in side_levels)


#: Summed column -> (expression of a row, horizons), in portable SQL.
SUMS: dict[str, tuple[str, str]] = {
    "t_buy": ("t_buy", "sml"),
    "t_sell": ("t_sell", "sml"),
    "t_n": ("t_buy_n + t_sell_n", "sl"),
    **{f"{k}_{x}": (f"{k}_{x}", h) for x in "ba" for k, h in (("add_best", "sm"), ("pull_best", "sm"), ("fill", "sml"), ("add_near", "m"), ("pull_near", "m"), ("hidden", "l"), ("refill", "l"))},
    "refill_conf": ("refill_conf_sum", "l"),
    "lvl1": ("flow_b_1 - flow_a_1", "s"),
    "near": (net(range(1, 4)), "sm"),
    "middle": (net(range(4, 7)), "sm"),
    "deep": (net(range(7, 11)), "sm"),
    "abs1": ("abs(flow_b_1) + abs(flow_a_1)", "s"),
    "absnear": (" + ".join(f"abs(flow_b_{i}) + abs(flow_a_{i})" for i in range(1, 4)), "sm"),
    "filled": ("term_filled", "l"),
    "touched": ("term_pulled_touched", "l"),
    "untouched": ("term_pulled_untouched", "l"),
    "life": ("life_filled_sum + life_pulled_sum", "l"),
    "life_unchained": ("life_filled_unchained_sum + life_pulled_unchained_sum", "l"),
    "unchained": ("term_filled_unchained + term_pulled_unchained", "l"),
    "near_b": ("depth_b_near", "l"),
    "near_a": ("depth_a_near", "l"),
    "sweep_buy": ("sweep_up", "m"),
    "sweep_sell": ("sweep_down", "m"),
}


def ratio(a: str, b: str, neutral: float = 0.0) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {neutral} END)"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


def formulas(spec: Spec) -> list[tuple[str, str]]:
    """(name, SQL) of every output in order; an output may use those before it (one projection for each layer)."""
    share = spec.s / spec.l
    side = {"bid": "b", "ask": "a"}
    out: list[tuple[str, str]] = [("mid_ticks", "mid"), ("spread_ticks", "spread")]
    for h in "sml":
        out.append((f"aggr_delta_{h}", f"CAST(t_buy_{h} - t_sell_{h} AS DOUBLE)"))
    out += [(f"aggr_delta_ratio_{h}", ratio(f"t_buy_{h} - t_sell_{h}", f"t_buy_{h} + t_sell_{h}")) for h in "sml"]
    hold = lambda x, h: ratio(f"add_best_{x}_{h}", f"add_best_{x}_{h} + fill_{x}_{h} + pull_best_{x}_{h}", 0.5)
    out += [(f"replenish_{n}_m", hold(x, "m")) for n, x in side.items()]
    out += [(f"price_progress_ticks_{h}", f"coalesce(mid - past_{h}, CAST(0 AS DOUBLE))") for h in "sm"]
    progress = lambda h: f"abs(coalesce(mid - past_{h}, CAST(0 AS DOUBLE)))"
    out.append(("directional_efficiency_m", ratio(progress("m"), "path_held")))
    stall = f"(1.0 / (1.0 + {progress('s')} * coalesce(stall_scale, CAST(1 AS DOUBLE))))"
    burst = lambda t: ratio(f"{t}_s", f"{t}_s + {t}_l * CAST({share!r} AS DOUBLE)")
    bid, ask = f"({burst('t_sell')} * {stall} * {hold('b', 's')})", f"({burst('t_buy')} * {stall} * {hold('a', 's')})"
    out += [("absorption_bid_s", bid), ("absorption_ask_s", ask), ("absorption_net_s", f"{bid} - {ask}")]
    stack = {n: ratio(f"add_near_{x}_m - pull_near_{x}_m", f"add_near_{x}_m + pull_near_{x}_m") for n, x in side.items()}
    out += [(f"stacking_{n}_m", e) for n, e in stack.items()] + [("stacking_net_m", f"{stack['bid']} - {stack['ask']}")]
    out.append(("price_impact_m", ratio(progress("m"), "t_buy_m + t_sell_m")))
    out += [(f"mlofi_{n}_{h}", f"CAST({c}_{h} AS DOUBLE)") for n, c, h in (("1", "lvl1", "s"), ("near", "near", "s"), ("middle", "middle", "s"), ("deep", "deep", "s"), ("near", "near", "m"), ("middle", "middle", "m"), ("deep", "deep", "m"))]
    two = lambda b, a: ratio(f"{b} - {a}", f"{b} + {a}")
    out += [("book_imbalance_l1", f"CASE WHEN valid = 1 THEN {two('bid_sz', 'ask_sz')} ELSE 0.0 END"), ("book_imbalance_near", two("depth_b_near", "depth_a_near")), ("book_imbalance_total", two("total_b", "total_a"))]
    out.append(("microprice_disp_ticks", f"CASE WHEN valid = 1 AND bid_sz + ask_sz > 0 THEN (CAST(bid_px AS DOUBLE) * ask_sz + CAST(ask_px AS DOUBLE) * bid_sz) / (bid_sz + ask_sz) / {float(spec.tick)!r} - mid ELSE 0.0 END"))
    out += [("sweep_buy_ticks_m", "CAST(sweep_buy_m AS DOUBLE)"), ("sweep_sell_ticks_m", "CAST(sweep_sell_m AS DOUBLE)"), ("sweep_failure_score", "score"), ("failed_sweeps_l", "CAST(failed_n AS DOUBLE)")]
    deplete = {n: ratio(f"fill_{x}_s", f"fill_{x}_s + {n}_sz") for n, x in side.items()}
    out += [(f"queue_depletion_{n}_s", e) for n, e in deplete.items()]
    out += [("liquidity_survival_ratio_l", ratio("filled_l", "filled_l + touched_l", 0.5)), ("cancel_before_touch_rate_l", ratio("untouched_l", "touched_l + untouched_l", 0.5))]
    conf = ratio("refill_conf_l", "refill_b_l + refill_a_l")
    ice = {n: f"(1.0 - (1.0 - {ratio(f'refill_{x}_l', f'refill_{x}_l + {spec.iceberg_k!r}')} * {conf}) * (1.0 - {ratio(f'hidden_{x}_l', f'hidden_{x}_l + fill_{x}_l')}))" for n, x in side.items()}
    out += [(f"iceberg_score_{n}_l", e) for n, e in ice.items()]
    thin = {d: f"(CASE WHEN near_{x}_l > 0 THEN 1.0 - {ratio(f'depth_{x}_near', f'depth_{x}_near + near_{x}_l / near_n')} ELSE 0.5 END)" for d, x in (("up", "a"), ("down", "b"))}
    out += [(f"liquidity_vacuum_{d}", e) for d, e in thin.items()]
    mean = lambda x: f"(CAST(near_{x}_l AS DOUBLE) / near_n)"
    firm = {n: f"(CASE WHEN {mean(x)} <= low_{x} THEN 1.0 ELSE {_clamp(f'(depth_{x}_near - low_{x}) / ({mean(x)} - low_{x})')} END)" for n, x in side.items()}
    out += [(f"book_resiliency_{n}", e) for n, e in firm.items()]
    out.append(("trade_burst_intensity_s", burst("t_n")))
    turn = {n: ratio(f"add_best_{x}_m + pull_best_{x}_m", f"add_best_{x}_m + pull_best_{x}_m + {n}_sz") for n, x in side.items()}
    out += [(f"queue_turnover_{n}_m", e) for n, e in turn.items()]
    out += [("order_lifetime_ms_l", f"{ratio('life_l', 'filled_l + touched_l + untouched_l')} / 1e6"), ("order_lifetime_chain_adj_ms_l", f"{ratio('life_unchained_l', 'unchained_l')} / 1e6")]
    out += [("liquidity_age_bid_s", "age_best_b / 1e9"), ("liquidity_age_ask_s", "age_best_a / 1e9"), ("liquidity_age_imbalance", two("age_best_b", "age_best_a"))]
    out += [("flow_imbalance_1_s", ratio("lvl1_s", "abs1_s")), ("flow_imbalance_near_s", ratio("near_s", "absnear_s")), ("flow_imbalance_near_m", ratio("near_m", "absnear_m"))]
    out += [(f"fill_imbalance_{h}", two(f"fill_a_{h}", f"fill_b_{h}")) for h in "sm"] + [("hidden_fill_imbalance_l", two("hidden_b_l", "hidden_a_l"))]
    # Pulls near the touch include those at the best: they count twice.
    pull = lambda x: f"(pull_best_{x}_m + pull_near_{x}_m)"
    out += [("iceberg_asym_l", f"{ice['bid']} - {ice['ask']}"), ("pull_imbalance_m", two(pull("a"), pull("b")))]
    out += [("vacuum_tilt", f"{thin['up']} - {thin['down']}"), ("resiliency_tilt", f"{firm['bid']} - {firm['ask']}"), ("depletion_tilt_s", f"{deplete['ask']} - {deplete['bid']}"), ("replenish_tilt_m", f"{hold('b', 'm')} - {hold('a', 'm')}"), ("turnover_tilt_m", f"{turn['bid']} - {turn['ask']}")]
    outer = two("(total_b - depth_b_near)", "(total_a - depth_a_near)")
    out += [("book_imbalance_outer", outer), ("imbalance_tilt", f"{two('depth_b_near', 'depth_a_near')} - {outer}"), ("depth_concentration_tilt", f"{ratio('depth_b_near', 'total_b', 0.5)} - {ratio('depth_a_near', 'total_a', 0.5)}")]
    out += [("sweep_net_ticks_m", "CAST(sweep_buy_m - sweep_sell_m AS DOUBLE)"), ("sweep_failure_signed", "CASE WHEN score > 0 THEN -sweep_dir * score ELSE 0.0 END"), ("failed_sweep_net_ratio_l", ratio("-failed_sum", "failed_n"))]
    return out


def with_windows(flow: DataFrame, keys: list[str], spec: Spec = Spec(), seq: str = "row_seq") -> DataFrame:
    """Adds everything that needs other rows: mids, window sums, sweeps. ``stall_scale`` (tick size in units of the
    distance scale) may be a column of the input; else a move counts in ticks."""
    c = Clock(keys, "ts", seq)
    h = {"s": spec.s, "m": spec.m, "l": spec.l}
    quote = (F.col("bid_px") + F.col("ask_px")) / F.lit(2.0) / F.lit(float(spec.tick))
    if "stall_scale" not in flow.columns:
        flow = flow.withColumn("stall_scale", F.lit(None).cast("double"))
    df = flow.withColumn("mid_now", F.when(F.col("valid") == 1, quote))
    df = df.withColumn("mid", carried(c, F.col("mid_now")))
    df = df.withColumn("pre_mid", F.lag("mid").over(c.rows()))
    moved = F.when(F.col("valid") == 1, F.abs(F.col("mid") - F.col("pre_mid")))
    spread = F.when(F.col("valid") == 1, (F.col("ask_px") - F.col("bid_px")) / F.lit(float(spec.tick)))
    traded = (F.col("t_buy") > 0) | (F.col("t_sell") > 0)
    swept = (F.col("t_px_high") - F.col("t_px_low")) / F.lit(float(spec.tick))
    sweeps = traded & ((F.col("t_buy") > 0) != (F.col("t_sell") > 0)) & (swept + 1 >= spec.sweep_levels) & F.col("mid").isNotNull()
    up = F.col("t_buy") > 0
    df = df.withColumns(
        {
            "moved": moved,
            "spread": spread,
            "total_b": F.col("depth_b_near") + F.col("depth_b_mid") + F.col("depth_b_deep"),
            "total_a": F.col("depth_a_near") + F.col("depth_a_mid") + F.col("depth_a_deep"),
            "sweeps": F.coalesce(sweeps, F.lit(False)),
            "sweep_up": F.when(sweeps & up, swept).otherwise(0.0),
            "sweep_down": F.when(sweeps & ~up, swept).otherwise(0.0),
        }
    )
    extreme = F.when(up, F.col("t_px_high")).otherwise(F.col("t_px_low")) / F.lit(float(spec.tick))
    start = F.when(F.col("sweeps"), F.struct(F.col("ts").alias("ts"), F.when(up, 1.0).otherwise(-1.0).alias("dir"), F.coalesce("pre_mid", "mid").alias("from"), extreme.alias("to")))
    df = df.withColumns({"_sweep": F.last(start, ignorenulls=True).over(c.so_far()), "_sweep_n": F.sum(F.when(F.col("sweeps"), 1).otherwise(0)).over(c.so_far())})
    sums = {f"{name}_{k}": rolling_sum(c, F.expr(e), h[k]) for name, (e, ks) in SUMS.items() for k in ks}
    live = F.coalesce(F.col("ts") - F.col("_sweep.ts") <= spec.reclaim, F.lit(False))
    move = F.abs(F.col("_sweep.to") - F.col("_sweep.from"))
    back = F.when(F.col("_sweep.dir") > 0, F.col("_sweep.to") - F.col("mid")).otherwise(F.col("mid") - F.col("_sweep.to"))
    score = F.when(live & (move > 0), F.least(F.greatest(back / move, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    df = df.withColumns(
        sums
        | {
            "path_now": rolling_sum(c, F.col("moved"), spec.m),
            "past_s": past_value(c, F.col("mid"), spec.s),
            "past_m": past_value(c, F.col("mid"), spec.m),
            "low_b": rolling_min(c, F.col("depth_b_near"), spec.m),
            "low_a": rolling_min(c, F.col("depth_a_near"), spec.m),
            "near_n": rolling_count(c, F.col("depth_b_near"), spec.l),
            "live": live,
            "score": score,
            "sweep_dir": F.coalesce(F.col("_sweep.dir"), F.lit(0.0)),
        }
    )
    # The path window moves on valid rows only; between them its last sum stands.
    in_sweep = Window.partitionBy(*keys, "_sweep_n").orderBy("ts", seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"path_held": F.coalesce(carried(c, F.when(F.col("valid") == 1, F.col("path_now"))), F.lit(0.0)), "_top": F.max("score").over(in_sweep)})
    before = c.rows()
    ended = F.lag("live").over(before) & (F.col("sweeps") | ~F.col("live")) & (F.lag("_top").over(before) >= spec.failed_retrace)
    df = df.withColumn("failed_dir", F.when(ended, F.lag("sweep_dir").over(before)))
    return df.withColumns({"failed_n": rolling_count(c, F.col("failed_dir"), spec.l), "failed_sum": rolling_sum(c, F.col("failed_dir"), spec.l)})


def compose(windowed: DataFrame, keys: list[str], spec: Spec = Spec(), seq: str = "row_seq") -> DataFrame:
    """The features of rows that went through ``with_windows``: keys, seq, ts and 72 more columns."""
    return windowed.select(*keys, seq, "ts", *(F.expr(e).alias(n) for n, e in formulas(spec)))


def features(flow: DataFrame, keys: list[str], spec: Spec = Spec(), seq: str = "row_seq") -> DataFrame:
    return compose(with_windows(flow, keys, spec, seq), keys, spec, seq)


def sampled(rows: DataFrame, keys: list[str], every: int, seq: str = "row_seq") -> DataFrame:
    """Rows with ts at or after the next due time (which then moves to ts + every), and the last row of a stream; all for 0.

    The due time depends on the rows kept before, so this is a fold over a stream.
    """
    if every <= 0:
        return rows

    def step(due, ts, last):
        if due is None or ts >= due:
            return ts + every, (True,)
        return due, (last,)

    ended = F.lead(seq).over(Window.partitionBy(*keys).orderBy("ts", seq)).isNull()
    return fold(rows.withColumn("_last", ended), keys, ["ts", seq], ["ts", "_last"], lambda: None, step, [("_kept", "boolean")]).where("_kept").drop("_kept", "_last")
