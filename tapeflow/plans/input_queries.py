"""Queries over the model inputs, on flow rows whose features and scales are arithmetic of the event as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import inputs as I
from tapeflow.operators import samples
from tapeflow.plans.catalog import query
from tapeflow.plans.feature_queries import FLOW, HOUR, STREAM, flow_rows
from tapeflow.sources.events import read_events

#: A stand-in for every feature, twin and scale that the inputs read, in portable SQL over event_id, k and v.
NAMES = sorted({*I.STATE, "mid_ticks", "book_imbalance_l1", "book_imbalance_near", "microprice_disp_ticks_norm", "mlofi_1_s_norm"} - {"v_scale", "d_scale", "sigma_dist", "sigma_30s", "mid_ticks"})
STATES = {n: f"CAST((k * {i % 7 + 1} + v * {i % 5 + 1} + {i}) % 17 AS DOUBLE) / 4" for i, n in enumerate(NAMES)}
STATES |= {"mid_ticks": "CASE WHEN event_id > 40 THEN CAST(20000 + k % 9 AS DOUBLE) / 2 END", "v_scale": "CASE WHEN k % 13 > 0 THEN CAST(1 + k % 4 AS DOUBLE) / 2 END", "d_scale": "CASE WHEN k % 13 > 0 THEN CAST(2 + v % 3 AS DOUBLE) END", "sigma_dist": "CASE WHEN k % 13 > 0 THEN CAST(1 + v % 4 AS DOUBLE) / 8 END", "sigma_30s": "CASE WHEN k % 13 > 0 THEN CAST(1 + v % 5 AS DOUBLE) / 8 END"}
GAP, BLOCK, MOST = 3, 5, 8


def rows(spark, sf_dir):
    states = read_events(spark, sf_dir).withColumn("v", F.floor("value") % 20).select(F.col("event_id").alias("row_seq"), *(F.expr(e).alias(n) for n, e in STATES.items()))
    return flow_rows(spark, sf_dir).join(states, "row_seq")


PART = "PARTITION BY session_date, instrument_id"
ROWS = f"""WITH e AS (
  SELECT event_id, CAST(make_date(CAST(epoch_us(ts) // 86400000000 AS INTEGER)) AS DATE) AS session_date, CAST((epoch_us(ts) // 3600000000) * 3600000000000 AS BIGINT) AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 20 AS v FROM events
), r AS (
  SELECT session_date, event_id % 5 AS instrument_id, event_id AS row_seq, ts, ts // {HOUR} AS u, {", ".join(f"{x} AS {n}" for n, x in (FLOW | STATES).items())} FROM e
)"""
_tick = lambda x: f"CASE WHEN sigma_dist IS NOT NULL THEN ({x}) * 0.1 / greatest(sigma_dist, 1e-9) END"
_vol = lambda x, s="1": f"CASE WHEN v_scale IS NOT NULL THEN ({x}) / greatest(v_scale * {s}, 1e-9) END"
_cut = lambda x: f"round(CAST({x} AS DOUBLE), 6)"


def rounded(df, keep, names):
    return df.select(*keep, *(F.round(F.col(n).cast("double"), 6).alias(n) for n in names))


_EVENT = {
    "dt_s": "coalesce((ts - lag(ts) OVER w) / 1e9, 0)", "t_buy_norm": _vol("t_buy"), "t_sell_norm": _vol("t_sell"), "trade_n": "t_buy_n + t_sell_n", "trade_px_dist_mid_norm": f"CASE WHEN t_buy + t_sell > 0 AND mid_ticks IS NOT NULL THEN {_tick('(t_px_high + t_px_low) / 2.0 / 1e8 - mid_ticks')} ELSE 0 END",
    **{f"{x}_norm": _vol(x) for x in ("add_near_b", "add_near_a", "pull_near_b", "pull_near_a", "fill_b", "fill_a")}, "hidden_norm": _vol("hidden_b + hidden_a"), "mid_change_norm": f"CASE WHEN mid_ticks - lag(mid_ticks) OVER w IS NOT NULL THEN {_tick('mid_ticks - lag(mid_ticks) OVER w')} ELSE 0 END",
    "microprice_disp_norm": "microprice_disp_ticks_norm", "mlofi_1_norm": "mlofi_1_s_norm", "age_best_b_s": "age_best_b / 1e9", "age_best_a_s": "age_best_a / 1e9", "term_pulled": "term_pulled_touched + term_pulled_untouched", "refill_n": "refill_b + refill_a",
}


@query("input_events", f"{ROWS} SELECT session_date, instrument_id, row_seq, {', '.join(f'{_cut(_EVENT.get(n, n))} AS {n}' for n in I.EVENT)} FROM r WINDOW w AS ({PART} ORDER BY ts, row_seq)")
def input_events(spark, sf_dir):
    return rounded(I.event_stream(rows(spark, sf_dir), STREAM), (*STREAM, "row_seq"), I.EVENT)


_FIRST = f"greatest(u + 1, nxt - {GAP})"
SECONDS = f"""{ROWS}, noted AS (
  SELECT *, last_value(CASE WHEN valid = 1 THEN depth_b_near + depth_a_near END IGNORE NULLS) OVER ({PART} ORDER BY ts, row_seq ROWS UNBOUNDED PRECEDING) AS noted FROM r
), ends AS (
  SELECT *, row_number() OVER ({PART}, u ORDER BY ts DESC, row_seq DESC) AS back, row_number() OVER ({PART}, u ORDER BY ts, row_seq) AS fore, sum(t_buy - t_sell) OVER q AS delta0, sum(t_buy + t_sell) OVER q AS volume0, count(*) OVER q AS events0,
    first_value(noted) OVER (q ORDER BY ts, row_seq) AS noted0 FROM noted WINDOW q AS ({PART}, u)
), per AS (
  SELECT *, lead(u) OVER w AS nxt, lead(noted0) OVER w AS depth FROM ends WHERE back = 1 WINDOW w AS ({PART} ORDER BY u)
), filled AS (
  SELECT *, unnest(list_concat([u], range({_FIRST}, greatest(nxt, {_FIRST})))) AS s FROM per WHERE nxt IS NOT NULL
), dense AS (
  SELECT * EXCLUDE (u, s), s AS u, CASE WHEN s = u THEN delta0 ELSE 0 END AS delta, CASE WHEN s = u THEN volume0 ELSE 0 END AS volume, CASE WHEN s = u THEN events0 ELSE 0 END AS events FROM filled
)"""


def dense(spark, sf_dir):
    return I.seconds(rows(spark, sf_dir), STREAM, HOUR, GAP)


_MOVE = "mid_ticks - lag(mid_ticks) OVER w"
_TACTICAL = {"delta_inc_norm": _vol("delta"), "vol_inc_norm": _vol("volume"), "events_inc": "events", "mid_change_1s_norm": f"CASE WHEN {_MOVE} IS NOT NULL THEN {_tick(_MOVE)} ELSE 0 END"}


@query("tactical_context", f"{SECONDS} SELECT session_date, instrument_id, u, {', '.join(f'{_cut(_TACTICAL.get(n, n))} AS {n}' for n in I.TACTICAL)} FROM dense WINDOW w AS ({PART} ORDER BY u)")
def tactical_context(spark, sf_dir):
    return rounded(I.tactical(dense(spark, sf_dir), STREAM), (*STREAM, "u"), I.TACTICAL)


_SLOW = {"return_norm": f"CASE WHEN mids >= 2 THEN {_tick('move')} ELSE 0 END", "range_norm": f"CASE WHEN mids >= 1 THEN {_tick('spanned')} ELSE 0 END", "delta_inc_norm": "d", "vol_inc_norm": "vo", "events_inc": "ev", "cvd_slope_norm": "d", "absorption_net_mean": "ab", "depth_norm": "depth / d_scale"}


@query(
    "slow_context",
    f"""{SECONDS}, n AS (SELECT *, (row_number() OVER ({PART} ORDER BY u) - 1) // {BLOCK} AS block, {_vol("delta")} AS dn, {_vol("volume")} AS vn FROM dense),
g AS (SELECT session_date, instrument_id, block, count(mid_ticks) AS mids, arg_max(mid_ticks, u) FILTER (mid_ticks IS NOT NULL) - arg_min(mid_ticks, u) FILTER (mid_ticks IS NOT NULL) AS move, max(mid_ticks) - min(mid_ticks) AS spanned, coalesce(sum(dn), 0) AS d, coalesce(sum(vn), 0) AS vo, sum(events) AS ev,
  avg(absorption_bid_s - absorption_ask_s) AS ab, max(u) AS u FROM n GROUP BY ALL HAVING count(*) = {BLOCK}), j AS (SELECT g.*, n.* EXCLUDE (session_date, instrument_id, block, u) FROM g JOIN n USING (session_date, instrument_id, block, u))
SELECT session_date, instrument_id, block, {', '.join(f'{_cut(_SLOW.get(c, c))} AS {c}' for c in I.SLOW)} FROM j""",
)
def slow_context(spark, sf_dir):
    return rounded(I.slow(dense(spark, sf_dir), STREAM, BLOCK), (*STREAM, "block"), I.SLOW)


_REGIME = {
    "event_rate": "events", "buy_vol": "(volume + delta) / 2.0", "sell_vol": "(volume - delta) / 2.0", "volatility": "sigma_30s", "spread": "spread_ticks", "absorption": "absorption_net_s", "queue_turnover": "(queue_turnover_bid_m + queue_turnover_ask_m) / 2", "replenishment": "(replenish_bid_m + replenish_ask_m) / 2",
    "sweep_activity": "sweep_buy_ticks_m + sweep_sell_ticks_m",
}


@query("regime_bases", f"{SECONDS} SELECT session_date, instrument_id, u, {', '.join(f'{_cut(_REGIME.get(n, n))} AS {n}' for n in I.REGIME)} FROM dense")
def regime_bases(spark, sf_dir):
    return rounded(I.regime_bases(dense(spark, sf_dir), STREAM), (*STREAM, "u"), I.REGIME)


SPANS = (2, 4, 8, 16, 24)


def _rank(base: str, n: int) -> str:
    """Over the joined earlier seconds ``b`` of a second ``a``."""
    below = f"sum(CASE WHEN b.u < a.u - {n} OR b.{base} IS NULL THEN 0.0 WHEN b.{base} < a.{base} THEN 1.0 WHEN b.{base} = a.{base} THEN 0.5 ELSE 0.0 END)"
    return f"round(CASE WHEN any_value(a.{base}) IS NOT NULL THEN CAST({below} AS DOUBLE) / nullif(count(CASE WHEN b.u >= a.u - {n} THEN b.{base} END), 0) END, 6) AS {base}_pct_{n}"


@query(
    "regime_all_percentiles",
    f"""{SECONDS}, base AS (SELECT session_date, instrument_id, u, {', '.join(f'CAST({_REGIME.get(n, n)} AS DOUBLE) AS {n}' for n in I.REGIME)} FROM dense)
SELECT a.session_date, a.instrument_id, a.u, {', '.join(_rank(n, s) for n in I.REGIME for s in SPANS)} FROM base a LEFT JOIN base b ON b.session_date = a.session_date AND b.instrument_id = a.instrument_id AND b.u BETWEEN a.u - {max(SPANS)} AND a.u - 1 GROUP BY a.session_date, a.instrument_id, a.u""",
)
def regime_all_percentiles(spark, sf_dir):
    """All 11 bases over five spans."""
    out = samples.regime_percentiles(I.regime_bases(dense(spark, sf_dir), STREAM), STREAM, I.REGIME, SPANS)
    return rounded(out, (*STREAM, "u"), [f"{n}_pct_{s}" for n in I.REGIME for s in SPANS])


# Bars of at most MOST rows or 12 hours, by recursion over the rows of a stream.
_SUM = {"n_trades": "t_buy_n + t_sell_n", "buy": "t_buy", "sell": "t_sell", **{x: x for x in ("add_near_b", "add_near_a", "pull_near_b", "pull_near_a", "fill_b", "fill_a", "add_best_b", "add_best_a", "pull_best_b", "pull_best_a", "term_filled")}, "hidden": "hidden_b + hidden_a", "m1": "flow_b_1 - flow_a_1", "m3": "flow_b_1 + flow_b_2 + flow_b_3 - flow_a_1 - flow_a_2 - flow_a_3", "sweep": "CASE WHEN (t_buy > 0) <> (t_sell > 0) THEN (t_px_high - t_px_low) / 1e8 ELSE 0 END", "term_pulled": "term_pulled_touched + term_pulled_untouched", "refill_n": "refill_b + refill_a"}
_held = lambda s: f"CASE WHEN s_add_best_{s} + s_fill_{s} + s_pull_best_{s} > 0 THEN s_add_best_{s} * 1.0 / (s_add_best_{s} + s_fill_{s} + s_pull_best_{s}) ELSE 0.5 END"
_BAR = {
    "duration_s": "dur", "n_events": "n", "n_trades": "s_n_trades", "buy_vol_norm": _vol("s_buy", "dur"), "sell_vol_norm": _vol("s_sell", "dur"), "delta_norm": _vol("s_buy - s_sell", "dur"), **{f"{x}_norm": _vol(f"s_{x}", "dur") for x in ("add_near_b", "add_near_a", "pull_near_b", "pull_near_a", "fill_b", "fill_a", "hidden")},
    "replenish_bar_bid": _held("b"), "replenish_bar_ask": _held("a"), "mid_change_norm": f"CASE WHEN mid_open IS NOT NULL THEN {_tick('coalesce(mid_ticks, mid_open) - mid_open')} ELSE 0 END", "range_norm": f"CASE WHEN mid_open IS NOT NULL THEN {_tick('greatest(hi, mid_open) - least(lo, mid_open)')} ELSE 0 END",
    "mlofi_1_norm": "s_m1 / d_scale", "mlofi_near_norm": "s_m3 / d_scale", "sweep_ticks_norm": _tick("s_sweep"), "term_filled": "s_term_filled", "term_pulled": "s_term_pulled", "refill_n": "s_refill_n", "events_per_s": "n / dur", "microprice_disp_norm": "microprice_disp_ticks_norm",
}


@query(
    "input_bars",
    ROWS.replace("WITH e AS", "WITH RECURSIVE e AS")
    + f""", o AS (SELECT *, row_number() OVER ({PART} ORDER BY ts, row_seq) AS i FROM r), walk AS (
  SELECT session_date, instrument_id, i, ts, ts AS opened, 1 AS n, 0 AS bar, {MOST} <= 1 AS closes FROM o WHERE i = 1
  UNION ALL SELECT o.session_date, o.instrument_id, o.i, o.ts, CASE WHEN w.closes THEN w.ts ELSE w.opened END, CASE WHEN w.closes THEN 1 ELSE w.n + 1 END, CASE WHEN w.closes THEN w.bar + 1 ELSE w.bar END,
    CASE WHEN w.closes THEN 1 ELSE w.n + 1 END >= {MOST} OR o.ts - CASE WHEN w.closes THEN w.ts ELSE w.opened END >= {12 * HOUR} FROM walk w JOIN o ON o.session_date = w.session_date AND o.instrument_id = w.instrument_id AND o.i = w.i + 1
), t AS (SELECT o.*, w.bar, w.closes, w.opened FROM o JOIN walk w USING (session_date, instrument_id, i)
), g AS (SELECT session_date, instrument_id, bar, max(i) AS i, count(*) AS n, max(mid_ticks) AS hi, min(mid_ticks) AS lo, arg_min(mid_ticks, i) FILTER (mid_ticks IS NOT NULL) AS mid0, {", ".join(f"sum({e}) AS s_{c}" for c, e in _SUM.items())} FROM t GROUP BY ALL
), b AS (SELECT g.* EXCLUDE (i), t.* EXCLUDE (session_date, instrument_id, bar, term_filled), greatest((t.ts - t.opened) / CAST({HOUR} AS DOUBLE), 1e-9) AS dur, coalesce(lag(t.mid_ticks) OVER (PARTITION BY g.session_date, g.instrument_id ORDER BY g.bar), mid0) AS mid_open FROM g JOIN t USING (session_date, instrument_id, i))
SELECT session_date, instrument_id, CAST(bar AS BIGINT) AS bar, {", ".join(f"{_cut(_BAR.get(c, c))} AS {c}" for c in I.BAR)} FROM b WHERE closes""",
)
def input_bars(spark, sf_dir):
    barred = I.with_bars(rows(spark, sf_dir), STREAM, MOST, 12 * HOUR)
    return rounded(I.bar_frame(barred, STREAM, unit=HOUR), (*STREAM, "bar"), I.BAR)


@query("assembled_inputs")
def assembled_inputs(spark, sf_dir):
    """The four sequence inputs at every sample of every stream."""
    return I.assemble(rows(spark, sf_dir), STREAM, 4 * HOUR, HOUR, MOST, 12 * HOUR, (16, 4, 8, 2), GAP, BLOCK)
