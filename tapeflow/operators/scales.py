"""Scales on a dense time grid, normalized features, and forward labels.

The grid holds one row for each unit of time between a key's first and last row. Scales of a unit are known only from
the next unit on, so rows join the grid on an equal key: unit - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.schema import NANOS

# Which features divide by which scale.
SIGMA_TWINS = ("price_progress_ticks_s", "price_progress_ticks_m", "microprice_disp_ticks", "sweep_buy_ticks_m", "sweep_sell_ticks_m", "sweep_net_ticks_m")
V_TWINS = (("aggr_delta_s", "s"), ("aggr_delta_m", "m"), ("aggr_delta_l", "l"))
D_TWINS = ("mlofi_1_s", "mlofi_near_s", "mlofi_middle_s", "mlofi_deep_s", "mlofi_near_m", "mlofi_middle_m", "mlofi_deep_m")
PERCENTILES = ("absorption_net_s", "spread_ticks", "trade_burst_intensity_s")
ROBUST_Z = ("liquidity_age_bid_s",)
EPS, TICK_POINTS = 1e-9, 0.1


def grid(rows: DataFrame, keys: Sequence[str], unit: int, gap: int = 3600, ts: str = "ts", seq: str = "row_seq") -> DataFrame:
    """keys, unit number ``u``, volume (0 in quiet units), mid and depth (the newest so far).

    rows: ts, seq, volume, mid and depth (null where unknown). A gap of more than ``gap`` units keeps the open unit and
    the last ``gap`` units before the next row.
    """
    keys = list(keys)
    per = rows.withColumn("u", F.floor(F.col(ts) / unit).cast("bigint")).groupBy(*keys, "u").agg(
        F.sum("volume").alias("volume"), F.max_by("mid", F.when(F.col("mid").isNotNull(), F.col(seq))).alias("mid"), F.max_by("depth", F.when(F.col("depth").isNotNull(), F.col(seq))).alias("depth")
    )
    nxt = F.lead("u").over(Window.partitionBy(*keys).orderBy("u"))
    first = F.greatest(F.col("u") + 1, F.col("_next") - gap)
    fill = F.when(F.col("_next") > first, F.sequence(first, F.col("_next") - 1)).otherwise(F.array().cast("array<bigint>"))
    dense = per.withColumn("_next", nxt).withColumn("_u", F.explode(F.concat(F.array("u"), fill)))
    open_ = F.col("_u") == F.col("u")
    w = Window.partitionBy(*keys).orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = dense.select(*keys, F.col("_u").alias("u"), F.when(open_, F.col("volume")).otherwise(0).alias("volume"), F.when(open_, F.col("mid")).alias("mid"), F.when(open_, F.col("depth")).alias("depth"))
    return dense.withColumns({"mid": F.last("mid", ignorenulls=True).over(w), "depth": F.last("depth", ignorenulls=True).over(w)})


def scales(dense: DataFrame, keys: Sequence[str], horizons: Sequence[int] = (30, 120, 600), window: int = 3600, least: int = 30) -> DataFrame:
    """Adds v_scale, d_scale and sigma_<h>s: medians over the last ``window`` samples, null before ``least`` of them.

    A sigma sample is the absolute move over h units that have a mid, in points.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("u")
    with_mid = Window.partitionBy(*keys, F.col("mid").isNull()).orderBy("u")
    out = dense.withColumns({f"_move_{h}": F.when(F.col("mid").isNotNull(), F.abs(F.col("mid") - F.lag("mid", h).over(with_mid)) * TICK_POINTS) for h in horizons})

    def median(v: str) -> Column:
        """Of the last ``window`` samples that aren't null: those form a stretch of their own."""
        w = Window.partitionBy(*keys, F.col(v).isNull()).orderBy("u").rowsBetween(-(window - 1), Window.currentRow)
        m = F.when(F.col(v).isNotNull() & (F.count(v).over(w) >= least), F.percentile(v, F.lit(0.5)).over(w))
        return m

    raw = {"v_scale": median("volume"), "d_scale": median("depth")} | {f"sigma_{h}s": median(f"_move_{h}") for h in horizons}
    out = out.withColumns(raw)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in raw}).drop(*(f"_move_{h}" for h in horizons))


def attach(rows: DataFrame, scaled: DataFrame, keys: Sequence[str], unit: int, ts: str = "ts") -> DataFrame:
    """Each row with the scales of the unit before its own, by an equi-join; null at the start."""
    keys = list(keys)
    names = [c for c in scaled.columns if c.endswith("_scale") or c.startswith("sigma_")]
    side = scaled.select(*keys, (F.col("u") + 1).alias("_u"), *names)
    return rows.withColumn("_u", F.floor(F.col(ts) / unit).cast("bigint")).join(side, [*keys, "_u"], "left").drop("_u")


def normalize(rows: DataFrame, window_units: dict[str, float], distance: str = "sigma_120s") -> DataFrame:
    """Adds the 17 normalized twins and norm_ready to features with scales attached; null in warm-up."""
    sig, v, d = F.col(distance), F.col("v_scale"), F.col("d_scale")
    at_least = lambda x: F.greatest(x, F.lit(EPS))
    known = lambda s, x: F.when(s.isNotNull(), x)
    out = {f"{n}_norm": known(sig, F.col(n) * TICK_POINTS / at_least(sig)) for n in SIGMA_TWINS}
    out |= {f"{n}_norm": known(v, F.col(n) / at_least(v * window_units[w])) for n, w in V_TWINS}
    out |= {f"{n}_norm": known(d, F.col(n) / at_least(d)) for n in D_TWINS}
    out["price_impact_m_norm"] = F.when(sig.isNotNull() & v.isNotNull(), F.col("price_impact_m") * TICK_POINTS / at_least(sig) * at_least(v * window_units["m"]))
    out["norm_ready"] = F.when(sig.isNotNull() & v.isNotNull() & d.isNotNull(), 1.0).otherwise(0.0)
    return rows.withColumns(out)


def tracked(rows: DataFrame, keys: Sequence[str], value: str, unit: int, span: int, ts: str = "ts", seq: str = "row_seq") -> DataFrame:
    """Adds <value>_pctile: the mid-rank of a row's value among the last values of earlier active units within ``span`` units.

    One sample for each unit with rows, so the past is bounded by ``span`` numbers; rows join it by unit.
    """
    keys = list(keys)
    u = F.floor(F.col(ts) / unit).cast("bigint")
    per = rows.withColumn("_u", u).groupBy(*keys, "_u").agg(F.max_by(value, seq).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_u").rangeBetween(-span, -1)
    past = per.select(*keys, "_u", F.collect_list("_v").over(w).alias("_past"))
    joined = rows.withColumn("_u", u).join(past, [*keys, "_u"], "left")
    x = F.col(value)
    low = F.aggregate("_past", F.lit(0), lambda a, p: a + F.when(p < x, 2).when(p == x, 1).otherwise(0))
    return joined.withColumn(f"{value}_pctile", F.when((F.size("_past") > 0) & x.isNotNull(), low / 2 / F.size("_past"))).drop("_u", "_past")


def second_path(quotes: DataFrame, keys: Sequence[str], unit: int = NANOS, ts: str = "ts", seq: str = "row_seq") -> DataFrame:
    """quotes(keys, ts, seq, valid, bid_px, ask_px) -> dense path: bid/ask high and low of the unit and the closing quote.

    Quiet units carry the closing quote as high and low; units before the first valid row have nulls.
    """
    keys = list(keys)
    ok = F.col("valid") == 1
    u = F.floor(F.col(ts) / unit).cast("bigint")
    pick = lambda c: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col(seq)))
    per = quotes.withColumn("u", u).groupBy(*keys, "u").agg(
        *(f(F.when(ok, F.col(f"{s}_px"))).alias(f"{s}_{n}") for s in ("bid", "ask") for n, f in (("high", F.max), ("low", F.min))), pick("bid_px").alias("bid_last"), pick("ask_px").alias("ask_last")
    )
    ends = per.groupBy(*keys).agg(F.min("u").alias("a"), F.max("u").alias("b"))
    dense = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("u")).join(per, [*keys, "u"], "left")
    run = Window.partitionBy(*keys).orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = dense.withColumns({f"{s}_last": F.last(f"{s}_last", ignorenulls=True).over(run) for s in ("bid", "ask")})
    dense = dense.withColumns({f"{s}_{n}": F.coalesce(f"{s}_{n}", f"{s}_last") for s in ("bid", "ask") for n in ("high", "low")})
    return dense.withColumn("mid_last", (F.col("bid_last") + F.col("ask_last")) / 2)


def labels(path: DataFrame, keys: Sequence[str], h: int, cost: float = 0.2, ratio: float = 2.0, per_point: float = 1e9) -> DataFrame:
    """Adds the labels of horizon ``h`` to every unit of a path: entry at the unit's worst quotes, window (u, u + h].

    All null with window_complete 0 where the path ends before or the entry quotes are unknown. direction: 1 up, 2 down, 0 none.
    """
    w = Window.partitionBy(*keys).orderBy("u")
    ahead = w.rowsBetween(1, h)
    best = F.max(F.when(F.col("bid_high").isNotNull(), F.struct(F.col("bid_high").alias("p"), (-F.col("u")).alias("u")))).over(ahead)
    worst = F.min(F.when(F.col("ask_low").isNotNull(), F.struct(F.col("ask_low").alias("p"), F.col("u").alias("u")))).over(ahead)
    out = path.withColumns({"_best": best, "_worst": worst, "_low": F.min("bid_low").over(ahead), "_high": F.max("ask_high").over(ahead), "_end": F.lead("mid_last", h).over(w), "_has": F.lead("u", h).over(w).isNotNull()})
    done = F.col("_has") & F.col("ask_high").isNotNull() & F.col("bid_low").isNotNull()
    pts = lambda x: F.when(done, x / F.lit(per_point))
    out = out.withColumns(
        {
            "up": pts(F.col("_best.p") - F.col("ask_high")),
            "up_adverse": pts(F.col("ask_high") - F.col("_low")),
            "down": pts(F.col("bid_low") - F.col("_worst.p")),
            "down_adverse": pts(F.col("_high") - F.col("bid_low")),
            "t_up": F.when(done, -F.col("_best.u") - F.col("u")),
            "t_down": F.when(done, F.col("_worst.u") - F.col("u")),
            "final_return": pts(F.col("_end") - F.col("mid_last")),
            "window_complete": F.when(done, 1).otherwise(0),
        }
    )
    gain_up, gain_down = F.col("up") - cost, F.col("down") - cost
    bull = (gain_up > 0) & (gain_up >= ratio * (F.greatest(F.col("up_adverse"), F.lit(0.0)) + cost))
    bear = (gain_down > 0) & (gain_down >= ratio * (F.greatest(F.col("down_adverse"), F.lit(0.0)) + cost))
    direction = F.when(bull & bear, F.when(gain_up >= gain_down, 1).otherwise(2)).when(bull, 1).when(bear, 2).otherwise(0)
    out = out.withColumn("direction", F.when(done, direction))
    return out.drop("_best", "_worst", "_low", "_high", "_end", "_has")


def label_twins(labelled: DataFrame, sigma: Column, h: int, cost: float = 0.2) -> DataFrame:
    """Moves in units of sigma (null unless positive), times as shares of the horizon, and the normalized cost."""
    s = F.when(sigma > 0, sigma)
    moves = ("up", "up_adverse", "down", "down_adverse", "final_return")
    return labelled.withColumns({f"{m}_norm": F.col(m) / s for m in moves} | {"t_up_frac": F.col("t_up") / h, "t_down_frac": F.col("t_down") / h, "cost_norm": F.lit(cost) / s})


def label_metadata(horizons: Sequence[int], cost: float = 0.2, ratio: float = 2.0) -> dict:
    """What the labels mean, for a sidecar or a table property."""
    return {"entry": "the unit's worst quote of the side that is paid", "window": "units after the sample's own, up to the horizon", "horizons": list(horizons), "cost_points": cost, "favourable_to_adverse": ratio, "direction": {"none": 0, "up": 1, "down": 2}}
