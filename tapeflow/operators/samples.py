"""Training samples: half-unit slots, triggers, greedy spacing, uniqueness weights; and model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.operators.folds import Ranks, fold
from tapeflow.operators.windows import Clock, ring
from tapeflow.schema import NANOS


def half_slots(rows: DataFrame, keys: Sequence[str], half: int = NANOS // 2, ts: str = "ts", seq: str = "row_seq") -> DataFrame:
    """The first row of each slot: even slots are clock candidates, odd ones event candidates. Adds slot, clock."""
    slot = F.floor(F.col(ts) / half).cast("bigint")
    first = F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(ts, seq))
    return rows.withColumn("slot", slot).withColumn("_first", first).where("_first = 1").drop("_first").withColumn("clock", F.col("slot") % 2 == 0)


#: Thresholds of the triggers, in the order of their precedence.
THRESHOLDS = {"absorption_onset": 0.35, "mlofi_shift": 5.0, "trade_burst": 0.9, "queue_collapse": 0.9, "vacuum": 0.9, "replenishment": 0.98}


def with_triggers(slots: DataFrame, keys: Sequence[str], thresholds: dict[str, float] = THRESHOLDS, ts: str = "ts", seq: str = "row_seq") -> DataFrame:
    """Adds trigger: clock on even slots, else the first event trigger that fires, else null.

    Onsets compare with the previous odd slot, at first with 0.
    """
    t = thresholds
    odd = Window.partitionBy(*keys, "clock").orderBy(ts, seq)
    sweep = F.col("sweep_buy_ticks_m") + F.col("sweep_sell_ticks_m")
    before_sweep, before = F.coalesce(F.lag(sweep).over(odd), F.lit(0.0)), F.coalesce(F.lag("absorption_net_s").over(odd), F.lit(0.0))
    top = lambda *c: F.greatest(*(F.col(x) for x in c))
    kind = (
        F.when(sweep > before_sweep, "sweep")
        .when((F.abs("absorption_net_s") >= t["absorption_onset"]) & (F.abs(before) < t["absorption_onset"]), "absorption_onset")
        .when(F.abs("mlofi_near_s_norm") >= t["mlofi_shift"], "mlofi_shift")
        .when(F.col("trade_burst_intensity_s") >= t["trade_burst"], "trade_burst")
        .when(top("queue_depletion_bid_s", "queue_depletion_ask_s") >= t["queue_collapse"], "queue_collapse")
        .when(top("liquidity_vacuum_up", "liquidity_vacuum_down") >= t["vacuum"], "vacuum")
        .when(top("replenish_bid_m", "replenish_ask_m") >= t["replenishment"], "replenishment")
    )
    return slots.withColumn("trigger", F.when(F.col("clock"), "clock").otherwise(kind))


def greedy_pick(candidates: DataFrame, keys: Sequence[str], gap: int = NANOS // 2, cap: int = 300, ts: str = "ts", seq: str = "row_seq") -> DataFrame:
    """The rows that a pass in time order keeps: an event kind at most ``cap`` times, then at least ``gap`` after the last kept row.

    candidates: rows with trigger and active (whether scales are warm). What is kept depends on what was kept before, so
    this is a fold over a stream's slots.
    """
    some = candidates.where(F.col("trigger").isNotNull() & F.col("active"))

    def step(state, at, trigger):
        last, counts = state
        if (trigger == "clock" or counts.get(trigger, 0) < cap) and (last is None or at - last >= gap):
            return (at, counts | {trigger: counts.get(trigger, 0) + 1}), (True,)
        return state, (False,)

    return fold(some, list(keys), [ts, seq], [ts, "trigger"], lambda: (None, {}), step, [("_kept", "boolean")]).where("_kept").drop("_kept")


def trainable(complete: Column, crosses: Column, policy: Column, sigma: Column) -> Column:
    return F.coalesce((complete == 1) & ~crosses & (policy != "exclude") & (sigma > 0), F.lit(False))


def uniqueness(samples: DataFrame, keys: Sequence[str], h: int, unit: int = NANOS, ts: str = "ts", flag: str = "trainable") -> DataFrame:
    """Adds uniqueness: the mean of 1 / concurrency over (u, u + h], where only trainable samples count; 0 for others.

    Concurrency changes only where a sample's window begins or ends, so two running sums do: no sample is expanded over its window.
    """
    keys = list(keys)
    u = F.floor(F.col(ts) / unit).cast("bigint")
    live = samples.where(F.col(flag)).select(*keys, u.alias("_u"))
    starts = live.select(*keys, (F.col("_u") + 1).alias("at"), F.lit(1).alias("d"))
    ends = live.select(*keys, (F.col("_u") + h + 1).alias("at"), F.lit(-1).alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = starts.unionByName(ends).groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    steps = steps.withColumn("c", F.sum("d").over(run)).withColumn("n", F.coalesce(F.lead("at").over(w) - F.col("at"), F.lit(0)))
    # Mass of 1 / concurrency before ``at``; windows begin and end at such places, so equi-joins suffice.
    mass = F.when(F.col("c") > 0, F.col("n") / F.col("c")).otherwise(0.0)
    before = steps.select(*keys, "at", F.coalesce(F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("m"))
    out = samples.withColumn("_u", u)
    for name, shift in (("_a", 1), ("_b", h + 1)):
        out = out.join(before.select(*keys, (F.col("at") - shift).alias("_u"), F.col("m").alias(name)), [*keys, "_u"], "left")
    return out.withColumn("uniqueness", F.when(F.col(flag), (F.col("_b") - F.col("_a")) / h).otherwise(0.0)).drop("_u", "_a", "_b")


def summary(samples: DataFrame, sessions: DataFrame, session: str = "session") -> DataFrame:
    """A row for every session, also empty ones: picked, clock, events, trainable, effective size, classes."""
    a = samples.groupBy(session).agg(
        F.count(F.lit(1)).alias("picked"), F.count(F.when(F.col("trigger") == "clock", 1)).alias("clock"), F.count(F.when(F.col("trigger") != "clock", 1)).alias("events"),
        F.count(F.when(F.col("trainable"), 1)).alias("trainable"), F.sum("uniqueness").alias("effective_n"), *(F.count(F.when(F.col("direction") == k, 1)).alias(n) for k, n in enumerate(("none", "up", "down"))),
    )
    joined = sessions.select(session).distinct().join(a, session, "left")
    return joined.select(session, *(F.coalesce(c, F.lit(0)).alias(c) if c != "effective_n" else F.coalesce(c, F.lit(0.0)).alias(c) for c in a.columns if c != session))


def padded_inputs(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int, ts: str = "ts", seq: str = "row_seq") -> DataFrame:
    """Adds inputs (n lists of floats, zeros first) and length: the last n rows of each stream."""
    v = F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns))
    c = Clock(list(keys), ts, seq)
    zero = F.array(*(F.lit(0.0).cast("float") for _ in columns))
    return rows.withColumns({"inputs": ring(c, v, n, zero), "length": F.least(F.count(F.lit(1)).over(c.so_far()), F.lit(n)).cast("int")})


def regime_percentiles(dense: DataFrame, keys: Sequence[str], values: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """Adds <value>_pct_<span>: the mid-rank of a unit's value among those of the ``span`` units before it; null without any."""

    def step(state, u, *now):
        out = []
        for v, trackers in zip(now, state):
            v = None if v is None else float(v)
            out += [t.rank(u, v) for t in trackers]
            for t in trackers:
                t.push(u, v)
        return state, tuple(out)

    added = [(f"{v}_pct_{n}", "double") for v in values for n in spans]
    return fold(dense, keys, ["u"], ["u", *values], lambda: [[Ranks(n) for n in spans] for _ in values], step, added)


def regime_tail(rows: DataFrame, ledger: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """For rows with a calendar attached: capped seconds to and since events, tiers, blackout, phase code, settlement, and
    with a roll ledger days to expiry and since the last roll."""
    from tapeflow.operators import calendar as K
    from tapeflow.schema import PHASES

    cap = F.lit(7 * 86_400.0)
    out = K.with_next_last(rows, ts)
    t = F.col(ts)
    out = out.withColumns(
        {
            "seconds_to_next": F.least("seconds_to_next", cap),
            "seconds_since_last": F.least("seconds_since_last", cap),
            "blackout": K.in_blackout(F.col(K.EVENTS), t).cast("int"),
            "phase_code": F.array_position(F.array(*map(F.lit, PHASES)), K.phase(t)).cast("int") - 1,
            "settlement": K.is_settlement(t).cast("int"),
        }
    ).drop(K.EVENTS)
    if ledger is None:
        return out
    last = Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a session
    side = ledger.withColumn("_roll", F.max(F.when(F.col("rolled"), F.col("session_date"))).over(last)).select("session_date", "days_to_expiry", F.datediff("session_date", "_roll").alias("days_since_roll"))
    return out.join(side, "session_date", "left")


def capture(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature vector at the sample, its columns prefixed with ``f_``, so that none clashes with a label."""
    return rows.select(*(F.col(c).alias(f"f_{c}" if c in features else c) for c in rows.columns))


def with_hygiene(samples: DataFrame, calendar: DataFrame, h: int, ts: str = "ts") -> DataFrame:
    """Adds label_end_ts (ts + h), release_policy and calendar_uncovered over the label's window, and crosses_session."""
    from tapeflow.operators import calendar as K

    out = samples.withColumn("label_end_ts", F.col(ts) + F.lit(h).cast("bigint"))
    out = K.attach(out, calendar)
    a, b, events = F.col(ts), F.col("label_end_ts"), F.col(K.EVENTS)
    out = out.withColumns({"release_policy": K.label_policy(events, a, b), "calendar_uncovered": (~K.covered(events, a, b)).cast("double")}).drop(K.EVENTS)
    return out.withColumn("crosses_session", (K.session_id(a) != K.session_id(b)).cast("double"))


def with_horizon(samples: DataFrame, keys: Sequence[str], h: int, unit: int = NANOS, ts: str = "ts") -> DataFrame:
    """Adds h<h>_trainable and h<h>_uniqueness from h<h>_window_complete, h<h>_sigma_pts and the hygiene columns."""
    ok = trainable(F.col(f"h{h}_window_complete"), F.col("crosses_session") == 1, F.col("release_policy"), F.col(f"h{h}_sigma_pts"))
    out = uniqueness(samples.withColumn(f"h{h}_trainable", ok), keys, h, unit, ts, f"h{h}_trainable")
    return out.withColumnRenamed("uniqueness", f"h{h}_uniqueness")
