"""The five inputs of a model: event stream, adaptive bars, tactical and slow context, regime; and their assembly.

Rows come with their features, normalized twins and scales (``v_scale``, ``d_scale``, ``sigma_dist``, ``sigma_30s``;
null in warm-up) and ``mid_ticks``, the carried mid. A volume is normalized by the volume scale times a duration, a move
in ticks by the distance scale; what a missing scale would divide is null. ``unit`` is the length of a second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.operators.folds import fold
from tapeflow.operators.scales import EPS, TICK_POINTS
from tapeflow.operators.windows import Clock, carried, ring
from tapeflow.schema import NANOS, TICK

# The columns of each input, in order.
EVENT = ("dt_s", "t_buy_norm", "t_sell_norm", "trade_n", "trade_px_dist_mid_norm", "add_near_b_norm", "add_near_a_norm", "pull_near_b_norm", "pull_near_a_norm", "fill_b_norm", "fill_a_norm", "hidden_norm", "mid_change_norm", "spread_ticks", "book_imbalance_l1", "microprice_disp_norm", "mlofi_1_norm", "age_best_b_s", "age_best_a_s", "term_filled", "term_pulled", "refill_n")
BAR = ("duration_s", "n_events", "n_trades", "buy_vol_norm", "sell_vol_norm", "delta_norm", "add_near_b_norm", "add_near_a_norm", "pull_near_b_norm", "pull_near_a_norm", "fill_b_norm", "fill_a_norm", "hidden_norm", "replenish_bar_bid", "replenish_bar_ask", "mid_change_norm", "range_norm", "mlofi_1_norm", "mlofi_near_norm", "sweep_ticks_norm", "term_filled", "term_pulled", "refill_n", "events_per_s", "absorption_net_s", "book_imbalance_near", "spread_ticks", "queue_turnover_bid_m", "queue_turnover_ask_m", "microprice_disp_norm")
TACTICAL = ("delta_inc_norm", "vol_inc_norm", "events_inc", "aggr_delta_s_norm", "absorption_bid_s", "absorption_ask_s", "mlofi_near_s_norm", "price_impact_m_norm", "sweep_buy_ticks_m_norm", "sweep_sell_ticks_m_norm", "sweep_failure_score", "queue_depletion_bid_s", "queue_depletion_ask_s", "liquidity_survival_ratio_l", "replenish_bid_m", "replenish_ask_m", "book_resiliency_bid", "book_resiliency_ask", "liquidity_vacuum_up", "liquidity_vacuum_down", "trade_burst_intensity_s", "mid_change_1s_norm", "spread_ticks")
SLOW = ("return_norm", "range_norm", "delta_inc_norm", "vol_inc_norm", "events_inc", "cvd_slope_norm", "absorption_net_mean", "failed_sweeps_l", "mlofi_near_m_norm", "depth_norm", "spread_ticks", "trade_burst_intensity_s", "book_resiliency_bid", "book_resiliency_ask", "directional_efficiency_m")
REGIME = ("event_rate", "buy_vol", "sell_vol", "delta", "volatility", "spread", "absorption", "depth", "queue_turnover", "replenishment", "sweep_activity")
_COPIED = tuple(c for c in TACTICAL if c not in ("delta_inc_norm", "vol_inc_norm", "events_inc", "mid_change_1s_norm"))
#: What a second keeps of its last row.
STATE = (*_COPIED, "failed_sweeps_l", "mlofi_near_m_norm", "directional_efficiency_m", "absorption_net_s", "queue_turnover_bid_m", "queue_turnover_ask_m", "sweep_buy_ticks_m", "sweep_sell_ticks_m", "v_scale", "d_scale", "sigma_dist", "sigma_30s")


def norm_volume(x: Column, seconds: Column | float = 1.0) -> Column:
    return F.when(F.col("v_scale").isNotNull(), x / F.greatest(F.col("v_scale") * seconds, F.lit(EPS)))


def norm_ticks(x: Column) -> Column:
    return F.when(F.col("sigma_dist").isNotNull(), x * TICK_POINTS / F.greatest(F.col("sigma_dist"), F.lit(EPS)))


def note_depth(c: Clock) -> Column:
    """Near depth of both sides at the newest valid row so far."""
    return carried(c, F.when(F.col("valid") == 1, F.col("depth_b_near") + F.col("depth_a_near")))


def event_stream(rows: DataFrame, keys: Sequence[str], seq: str = "row_seq") -> DataFrame:
    """keys, seq, ts and the 22 columns of EVENT for each row."""
    c = Clock(list(keys), "ts", seq)
    before = c.rows()
    traded = (F.col("t_buy") + F.col("t_sell") > 0) & F.col("mid_ticks").isNotNull()
    price = (F.col("t_px_high") + F.col("t_px_low")) / 2 / F.lit(float(TICK))
    move = F.col("mid_ticks") - F.lag("mid_ticks").over(before)
    volume = lambda x: norm_volume(F.expr(x))
    made = {
        "dt_s": F.coalesce((F.col("ts") - F.lag("ts").over(before)) / F.lit(float(NANOS)), F.lit(0.0)), "t_buy_norm": volume("t_buy"), "t_sell_norm": volume("t_sell"), "trade_n": (F.col("t_buy_n") + F.col("t_sell_n")).cast("double"),
        "trade_px_dist_mid_norm": F.when(traded, norm_ticks(price - F.col("mid_ticks"))).otherwise(0.0), **{f"{x}_norm": volume(x) for x in ("add_near_b", "add_near_a", "pull_near_b", "pull_near_a", "fill_b", "fill_a")}, "hidden_norm": volume("hidden_b + hidden_a"),
        "mid_change_norm": F.when(move.isNotNull(), norm_ticks(move)).otherwise(0.0), "spread_ticks": F.col("spread_ticks"), "book_imbalance_l1": F.col("book_imbalance_l1"), "microprice_disp_norm": F.col("microprice_disp_ticks_norm"), "mlofi_1_norm": F.col("mlofi_1_s_norm"),
        "age_best_b_s": F.col("age_best_b") / F.lit(1e9), "age_best_a_s": F.col("age_best_a") / F.lit(1e9), "term_filled": F.col("term_filled").cast("double"), "term_pulled": (F.col("term_pulled_touched") + F.col("term_pulled_untouched")).cast("double"), "refill_n": (F.col("refill_b") + F.col("refill_a")).cast("double"),
    }
    return rows.select(*keys, seq, "ts", *(made[n].alias(n) for n in EVENT))


def with_bars(rows: DataFrame, keys: Sequence[str], most: int = 64, span: int = 15 * NANOS, seq: str = "row_seq") -> DataFrame:
    """Adds bar (from 0) and closes: a bar closes with the row that makes it ``most`` rows long or ``span`` old, and the
    next one opens at that row's time and mid. Where a bar closes depends on where it opened, hence a fold."""

    def step(state, ts):
        opened, n, bar = state
        opened = ts if opened is None else opened
        if n + 1 >= most or ts - opened >= span:
            return (ts, 0, bar + 1), (bar, True)
        return (opened, n + 1, bar), (bar, False)

    return fold(rows, keys, ["ts", seq], ["ts"], lambda: (None, 0, 0), step, [("bar", "long"), ("closes", "boolean")])


def bar_frame(barred: DataFrame, keys: Sequence[str], seq: str = "row_seq", unit: int = NANOS) -> DataFrame:
    """The 30 columns of BAR for each closed bar; scales and states are those of the closing row."""
    keys = list(keys)
    one = "(t_buy > 0) <> (t_sell > 0)"
    near = " + ".join(f"flow_b_{i} - flow_a_{i}" for i in (1, 2, 3))
    sums = {"n_trades": "t_buy_n + t_sell_n", "buy": "t_buy", "sell": "t_sell", **{x: x for x in ("add_near_b", "add_near_a", "pull_near_b", "pull_near_a", "fill_b", "fill_a", "add_best_b", "add_best_a", "pull_best_b", "pull_best_a", "term_filled")}}
    sums |= {"hidden": "hidden_b + hidden_a", "mlofi1": "flow_b_1 - flow_a_1", "mlofi_near": near, "sweep": f"CASE WHEN {one} THEN (t_px_high - t_px_low) / {float(TICK)!r}D ELSE 0D END", "term_pulled": "term_pulled_touched + term_pulled_untouched", "refill_n": "refill_b + refill_a"}
    last = ("absorption_net_s", "book_imbalance_near", "spread_ticks", "queue_turnover_bid_m", "queue_turnover_ask_m", "microprice_disp_ticks_norm", "v_scale", "d_scale", "sigma_dist")
    bars = barred.groupBy(*keys, "bar").agg(
        F.max("closes").alias("closed"), F.min("ts").alias("first_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"), F.max("mid_ticks").alias("high"), F.min("mid_ticks").alias("low"), F.max_by(F.struct("mid_ticks", *last), F.struct("ts", seq)).alias("s"),
        F.min_by("mid_ticks", F.when(F.col("mid_ticks").isNotNull(), F.struct("ts", seq))).alias("first_mid"), *(F.sum(F.expr(e)).alias(f"x_{n}") for n, e in sums.items()),
    )
    w = Window.partitionBy(*keys).orderBy("bar")
    bars = bars.select(*keys, "bar", "closed", "first_ts", "end_ts", "n", "high", "low", "first_mid", *(f"x_{n}" for n in sums), F.col("s.mid_ticks").alias("mid_close"), *(F.col(f"s.{c}").alias(c) for c in last))
    bars = bars.withColumns({"open_ts": F.coalesce(F.lag("end_ts").over(w), F.col("first_ts")), "mid_open": F.coalesce(F.lag("mid_close").over(w), F.col("first_mid"))})
    bars = bars.withColumns({"duration_s": F.greatest((F.col("end_ts") - F.col("open_ts")) / F.lit(float(unit)), F.lit(EPS)), "mid_high": F.greatest("high", "mid_open"), "mid_low": F.least("low", "mid_open")})
    x = lambda n: F.col(f"x_{n}")
    volume = lambda v: norm_volume(v, F.col("duration_s"))
    restored = lambda s: F.when(x(f"add_best_{s}") + x(f"fill_{s}") + x(f"pull_best_{s}") > 0, x(f"add_best_{s}") / (x(f"add_best_{s}") + x(f"fill_{s}") + x(f"pull_best_{s}"))).otherwise(0.5)
    known = F.col("mid_open").isNotNull()
    made = {
        "n_events": F.col("n").cast("double"), "n_trades": x("n_trades").cast("double"), "buy_vol_norm": volume(x("buy")), "sell_vol_norm": volume(x("sell")), "delta_norm": volume(x("buy") - x("sell")),
        **{f"{n}_norm": volume(x(n)) for n in ("add_near_b", "add_near_a", "pull_near_b", "pull_near_a", "fill_b", "fill_a", "hidden")}, "replenish_bar_bid": restored("b"), "replenish_bar_ask": restored("a"),
        "mid_change_norm": F.when(known, norm_ticks(F.coalesce("mid_close", "mid_open") - F.col("mid_open"))).otherwise(0.0), "range_norm": F.when(known, norm_ticks(F.col("mid_high") - F.col("mid_low"))).otherwise(0.0),
        "mlofi_1_norm": x("mlofi1") / F.col("d_scale"), "mlofi_near_norm": x("mlofi_near") / F.col("d_scale"), "sweep_ticks_norm": norm_ticks(x("sweep")), "term_filled": x("term_filled").cast("double"), "term_pulled": x("term_pulled").cast("double"), "refill_n": x("refill_n").cast("double"),
        "events_per_s": F.col("n") / F.col("duration_s"), "microprice_disp_norm": F.col("microprice_disp_ticks_norm"),
    }
    return bars.where("closed").select(*keys, "bar", "end_ts", *(made.get(n, F.col(n)).alias(n) for n in BAR))


def seconds(rows: DataFrame, keys: Sequence[str], unit: int = NANOS, gap: int = 300, seq: str = "row_seq") -> DataFrame:
    """One row for each completed second ``u``: increments (0 in quiet seconds), the state of the newest row, depth.

    A second completes when a later one has a row, so a stream's last one is missing. A gap keeps its first second and
    the last ``gap`` ones. Depth is that of the newest valid row when the second completes, the completing row included.
    """
    keys = list(keys)
    c = Clock(keys, "ts", seq)
    noted = rows.withColumns({"u": F.floor(F.col("ts") / unit).cast("bigint"), "_depth": note_depth(c)})
    place = F.struct("ts", seq)
    per = noted.groupBy(*keys, "u").agg(
        F.sum(F.col("t_buy") - F.col("t_sell")).alias("delta"), F.sum(F.col("t_buy") + F.col("t_sell")).alias("volume"), F.count(F.lit(1)).alias("events"), F.max_by(F.struct("mid_ticks", *STATE), place).alias("s"), F.min_by("_depth", place).alias("_first"),
    )
    w = Window.partitionBy(*keys).orderBy("u")
    per = per.withColumns({"_next": F.lead("u").over(w), "depth": F.lead("_first").over(w)}).where(F.col("_next").isNotNull())
    first = F.greatest(F.col("u") + 1, F.col("_next") - gap)
    fill = F.when(F.col("_next") > first, F.sequence(first, F.col("_next") - 1)).otherwise(F.array().cast("array<bigint>"))
    dense = per.withColumn("_u", F.explode(F.concat(F.array("u"), fill)))
    open_ = F.col("_u") == F.col("u")
    inc = lambda x: F.when(open_, F.col(x)).otherwise(0).alias(x)
    return dense.select(*keys, F.col("_u").alias("u"), inc("delta"), inc("volume"), inc("events"), "depth", F.col("s.mid_ticks").alias("mid"), *(F.col(f"s.{n}").alias(n) for n in STATE))


def tactical(dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 23 columns of TACTICAL for each completed second, and the hidden mid."""
    move = F.col("mid") - F.lag("mid").over(Window.partitionBy(*keys).orderBy("u"))
    made = {"delta_inc_norm": norm_volume(F.col("delta")), "vol_inc_norm": norm_volume(F.col("volume")), "events_inc": F.col("events").cast("double"), "mid_change_1s_norm": F.when(move.isNotNull(), norm_ticks(move)).otherwise(0.0)}
    return dense.select(*keys, "u", *(made.get(n, F.col(n)).alias(n) for n in TACTICAL), "mid")


def slow(dense: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The 15 columns of SLOW for every ``n`` completed seconds, counted and not clock-aligned; states of the last of them."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("u")
    rows = dense.withColumns({"block": F.floor((F.row_number().over(w) - 1) / n).cast("bigint"), "_delta": norm_volume(F.col("delta")), "_volume": norm_volume(F.col("volume"))})
    with_mid = F.when(F.col("mid").isNotNull(), F.col("u"))
    b = rows.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("units"), F.max("u").alias("u"), F.count("mid").alias("mids"), (F.max_by("mid", with_mid) - F.min_by("mid", with_mid)).alias("move"), (F.max("mid") - F.min("mid")).alias("range"), F.coalesce(F.sum("_delta"), F.lit(0.0)).alias("delta"), F.coalesce(F.sum("_volume"), F.lit(0.0)).alias("volume"),
        F.sum("events").alias("events"), F.avg(F.col("absorption_bid_s") - F.col("absorption_ask_s")).alias("absorption"), F.max_by(F.struct("depth", *STATE), "u").alias("s"),
    ).where(F.col("units") == n)
    b = b.select(*keys, "block", "u", "mids", "move", "range", "delta", "volume", "events", "absorption", "s.*")
    made = {
        "return_norm": F.when(F.col("mids") >= 2, norm_ticks(F.col("move"))).otherwise(0.0), "range_norm": F.when(F.col("mids") >= 1, norm_ticks(F.col("range"))).otherwise(0.0), "delta_inc_norm": F.col("delta"), "vol_inc_norm": F.col("volume"), "events_inc": F.col("events").cast("double"),
        "cvd_slope_norm": F.col("delta"), "absorption_net_mean": F.col("absorption"), "depth_norm": F.col("depth") / F.col("d_scale"),
    }
    return b.select(*keys, "block", "u", *(made.get(c, F.col(c)).alias(c) for c in SLOW))


def regime_bases(dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 11 values of REGIME for each completed second."""
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    made = {
        "event_rate": F.col("events").cast("double"), "buy_vol": mean("volume", "delta"), "sell_vol": (F.col("volume") - F.col("delta")) / 2, "delta": F.col("delta").cast("double"), "volatility": F.col("sigma_30s"), "spread": F.col("spread_ticks"), "absorption": F.col("absorption_net_s"), "depth": F.col("depth").cast("double"),
        "queue_turnover": mean("queue_turnover_bid_m", "queue_turnover_ask_m"), "replenishment": mean("replenish_bid_m", "replenish_ask_m"), "sweep_activity": F.col("sweep_buy_ticks_m") + F.col("sweep_sell_ticks_m"),
    }
    return dense.select(*keys, "u", *(made[n].alias(n) for n in REGIME))


def sample_clock(rows: DataFrame, keys: Sequence[str], every: int = 60 * NANOS, seq: str = "row_seq") -> DataFrame:
    """Adds taken: rows at or after the next due time, which then moves to their time + ``every``; the first row only arms it."""

    def step(due, ts):
        if due is None:
            return ts + every, (False,)
        return (ts + every, (True,)) if ts >= due else (due, (False,))

    return fold(rows, keys, ["ts", seq], ["ts"], lambda: None, step, [("taken", "boolean")])


def assemble(rows: DataFrame, keys: Sequence[str], every: int = 60 * NANOS, unit: int = NANOS, most: int = 64, span: int = 15 * NANOS, lengths: tuple[int, int, int, int] = (1024, 256, 300, 120), gap: int = 300, n: int = 10, seq: str = "row_seq") -> DataFrame:
    """Samples of a stream: keys, seq, ts, and for events, bars, tactical and slow a list of float lists, padded with
    zeros on the left, and its true length. Everything is known at the sampled row: its own event, bars and seconds that
    have closed. Regime percentiles join by (keys, u) from ``samples.regime_percentiles`` over ``regime_bases``.
    """
    keys = list(keys)
    taken = sample_clock(with_bars(rows, keys, most, span, seq), keys, every, seq)
    at = taken.where("taken").select(*keys, seq, "ts", (F.col("bar") - F.when(F.col("closes"), 0).otherwise(1)).alias("_bar"), F.floor(F.col("ts") / unit).cast("bigint").alias("_u"))
    dense = seconds(rows, keys, unit, gap, seq)
    nothing = F.lit(0.0).cast("float")
    vector = lambda cols: F.array(*(F.coalesce(F.col(x).cast("float"), nothing) for x in cols))

    def held(frame: DataFrame, order: str, cols: Sequence[str], size: int, name: str) -> DataFrame:
        c = Clock(keys, order, order)
        zero = F.array(*(nothing for _ in cols))
        return frame.select(*keys, F.col(order), ring(c, vector(cols), size, zero).alias(name), F.least(F.row_number().over(c.rows()), F.lit(size)).alias(f"{name}_len"))

    events, bars, quick, blocks = event_stream(rows, keys, seq), bar_frame(taken.drop("taken"), keys, seq, unit), tactical(dense, keys), slow(dense, keys, n)
    out = at.join(held(events.drop("ts"), seq, EVENT, lengths[0], "events"), [*keys, seq])
    out = out.join(held(bars, "bar", BAR, lengths[1], "bars").withColumnRenamed("bar", "_bar"), [*keys, "_bar"], "left")
    counted = dense.select(*keys, "u", F.row_number().over(Window.partitionBy(*keys).orderBy("u")).alias("_done"))
    out = out.join(held(quick, "u", TACTICAL, lengths[2], "tactical").withColumn("_u", F.col("u") + 1).drop("u"), [*keys, "_u"], "left")
    out = out.join(counted.select(*keys, (F.col("u") + 1).alias("_u"), (F.floor(F.col("_done") / n) - 1).cast("bigint").alias("block")), [*keys, "_u"], "left")
    out = out.join(held(blocks, "block", SLOW, lengths[3], "slow"), [*keys, "block"], "left")
    padded = []
    for name, cols, size in (("events", EVENT, lengths[0]), ("bars", BAR, lengths[1]), ("tactical", TACTICAL, lengths[2]), ("slow", SLOW, lengths[3])):
        zero = F.array_repeat(F.array(*(nothing for _ in cols)), size)
        padded += [F.coalesce(F.col(name), zero).alias(name), F.coalesce(F.col(f"{name}_len"), F.lit(0)).alias(f"{name}_len")]
    return out.select(*keys, seq, "ts", *padded)
