"""Contracts, rolls and the archive's calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Month codes January to December, and the liquid months.
MONTHS = "FGHJKMNQUVXZ"
LIQUID = "GJMQVZ"
OUTRIGHT = rf"^GC([{MONTHS}])(\d)$"


def with_contract(rows: DataFrame, symbol: str = "symbol", day: str = "session_date") -> DataFrame:
    """Keeps outrights and adds delivery (first of the month) and expiry (its third-last weekday).

    The year digit means the first year from the session's year less one on that ends in it; ten more if the 28th of the
    delivery month lies over 60 days before the session.
    """
    rows = rows.where(F.col(symbol).rlike(OUTRIGHT))
    month = F.instr(F.lit(MONTHS), F.regexp_extract(symbol, OUTRIGHT, 1))
    digit = F.regexp_extract(symbol, OUTRIGHT, 2).cast("int")
    base = F.year(day) - 1
    year = base + F.pmod(digit - base, F.lit(10))
    year = F.when(F.datediff(day, F.make_date(year, month, F.lit(28))) > 60, year + 10).otherwise(year)
    rows = rows.withColumn("delivery", F.make_date(year, month, F.lit(1)))
    return rows.withColumn("expiry", third_last_weekday(F.last_day("delivery")))


def third_last_weekday(last: Column) -> Column:
    """From a month's last day."""
    d = F.weekday(last)  # Monday is 0
    back = F.when(d == 6, 4).when(d == 5, 3).when(d >= 2, 2).otherwise(4)
    return F.date_sub(last, back)


def roll_ledger(contracts: DataFrame, crosses: int = 2) -> DataFrame:
    """contracts(session_date, symbol, volume, expiry): a row per session with the active contract.

    An automaton over the sessions in order, as a native fold: sessions are few (one row a day), their contracts arrays.
    A roll that was decided takes effect in the next session that lists it; an active contract that vanished gives way to
    the volume leader; an expired one is forced out; a later expiry with more volume ``crosses`` sessions in a row decides a roll.
    """
    one = F.struct("volume", "symbol", "expiry")
    days = contracts.groupBy("session_date").agg(F.sort_array(F.collect_list(one), asc=False).alias("outs"), F.sum("volume").alias("total"))
    days = days.agg(F.array_sort(F.collect_list(F.struct("session_date", "outs", "total"))).alias("days"))
    row = "struct<session_date:date,active:string,active_volume:bigint,active_share:double,active_expiry:date,days_to_expiry:int,next_symbol:string,next_volume:bigint,cross_streak:int,rolled:boolean,forced:boolean,leader:string>"
    start = F.struct(F.lit(None).cast("string").alias("active"), F.lit(0).alias("streak"), F.lit(None).cast("string").alias("pending"), F.array().cast(f"array<{row}>").alias("rows"))

    def step(a: Column, d: Column) -> Column:
        outs = d["outs"]
        listed = lambda s: F.exists(outs, lambda o: o["symbol"] == s)
        get = lambda s: F.get(F.filter(outs, lambda o: o["symbol"] == s), F.lit(0))
        leader = F.get(outs, F.lit(0))["symbol"]
        applies = a["pending"].isNotNull() & listed(a["pending"])
        active = F.when(applies, a["pending"]).otherwise(a["active"])
        gone = active.isNull() | ~listed(active)
        expired = ~gone & (d["session_date"] >= get(active)["expiry"])
        now = F.when(gone | expired, leader).otherwise(active)
        rolled = applies | (gone & (F.size(a["rows"]) > 0)) | expired
        mine = get(now)
        later = F.filter(outs, lambda o: o["expiry"] > mine["expiry"])
        best = F.get(later, F.lit(0))
        ahead = F.coalesce(best["volume"] > mine["volume"], F.lit(False))
        streak = F.when(ahead, F.when(applies | expired, 0).otherwise(a["streak"]) + 1).otherwise(0)
        pending = F.when(streak >= crosses, best["symbol"]).otherwise(F.when(applies, F.lit(None)).otherwise(a["pending"]))
        out = F.struct(
            d["session_date"].alias("session_date"), now.alias("active"), mine["volume"].alias("active_volume"),
            (mine["volume"] / F.when(d["total"] == 0, 1).otherwise(d["total"])).cast("double").alias("active_share"), mine["expiry"].alias("active_expiry"),
            F.datediff(mine["expiry"], d["session_date"]).alias("days_to_expiry"), best["symbol"].alias("next_symbol"), F.coalesce(best["volume"], F.lit(0)).cast("bigint").alias("next_volume"),
            streak.cast("int").alias("cross_streak"), rolled.alias("rolled"), expired.alias("forced"), leader.alias("leader"),
        )
        return F.struct(now.alias("active"), streak.cast("int").alias("streak"), pending.alias("pending"), F.concat(a["rows"], F.array(out)).alias("rows"))

    rows = days.select(F.explode(F.aggregate("days", start, step, lambda a: a["rows"])).alias("r"))
    return rows.select("r.*").withColumn("leader_is_active", F.col("leader") == F.col("active"))


def ledger_checks(ledger: DataFrame, known: tuple[str, str, str] | None = None) -> DataFrame:
    """One row: whether each check of a ledger holds.

    ``known``, (first day, last day, symbol), adds the check that the symbol is active on all sessions of those days.
    """
    ordered = Window.orderBy("session_date")  # one row a session
    rolls = ledger.where("rolled").withColumn("_up", F.coalesce(F.col("active_expiry") >= F.lag("active_expiry").over(ordered), F.lit(True)))
    a = ledger.agg(
        F.coalesce(F.bool_and(F.col("active").rlike(OUTRIGHT)), F.lit(True)).alias("outright"),
        F.coalesce(F.bool_and(F.col("days_to_expiry") >= 0), F.lit(True)).alias("not_expired"),
        (F.count(F.when(F.col("forced"), 1)) == 0).alias("not_forced"),
        (F.percentile("active_share", F.lit(0.5)) > 0.7).alias("dominates"),
        (F.avg(F.col("leader_is_active").cast("double")) >= 0.93).alias("leads"),
        (F.datediff(F.max("session_date"), F.min("session_date")) / 365.25).alias("_years"),
    )
    b = rolls.agg(F.coalesce(F.bool_and("_up"), F.lit(True)).alias("later"), F.count(F.lit(1)).alias("n_rolls"), F.coalesce(F.avg(F.instr(F.lit(LIQUID), F.substring("active", 3, 1)).cast("boolean").cast("double")) >= 0.95, F.lit(True)).alias("liquid"))
    out = a.join(b)  # one row each
    if known is not None:
        first, last, symbol = known
        inside = ledger.where(F.col("session_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        out = out.join(inside.agg(F.coalesce(F.bool_and(F.col("active").eqNullSafe(symbol)), F.lit(True)).alias("known")))
    return out.withColumn("cadence", (F.col("n_rolls") / F.col("_years")).between(4.5, 7.5)).drop("_years")


def with_active(rows: DataFrame, ledger: DataFrame, day: str = "session_date") -> DataFrame:
    """Adds the active contract of each row's day; a day that the ledger doesn't have is an error. A ledger has a row a session."""
    known = ledger.select(F.col("session_date").alias("_day"), F.col("active").alias("_active"))
    missing = F.raise_error(F.concat(F.lit("not in the ledger: "), F.coalesce(F.col(day).cast("string"), F.lit("null")))).cast("string")
    return rows.join(known, F.col(day) == F.col("_day"), "left").withColumn("active", F.when(F.col("_day").isNull(), missing).otherwise(F.col("_active"))).drop("_day", "_active")


def with_crosses_roll(rows: DataFrame, ledger: DataFrame, first: Column, last: Column) -> DataFrame:
    """Adds crosses_roll: whether a roll lies in (first, last], by the ledger's roll dates, attached as one small array; null
    where a bound is, unless there is no roll at all."""
    dates = ledger.where("rolled").agg(F.collect_list("session_date")).scalar()
    inside = F.exists("_rolls", lambda d: (d > first) & (d <= last))
    return rows.withColumn("_rolls", dates).withColumn("crosses_roll", inside).drop("_rolls")


def calendar_gaps(days: DataFrame, day: str = "session_date") -> DataFrame:
    """Days between the first and the last, Saturdays left out, that are missing."""
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias(day)).where(F.weekday(day) != 5)
    return every.join(days.select(day).distinct(), day, "left_anti")


def worst_condition(reports: DataFrame) -> DataFrame:
    """reports(day, condition, n): of several reports for a day the worst, later ones on ties: missing, degraded, pending, others."""
    rank = F.when(F.col("condition") == "missing", 3).when(F.col("condition") == "degraded", 2).when(F.col("condition") == "pending", 1).otherwise(0)
    return reports.groupBy("day").agg(F.max_by("condition", F.struct(rank, F.col("n"))).alias("condition"))


def quality_mask(days: DataFrame, present: DataFrame, conditions: DataFrame) -> DataFrame:
    """Status of each day: missing without a file, degraded where reported so, else ok; with a reason."""
    have = present.select("day").distinct().withColumn("_here", F.lit(True))
    out = days.select("day").distinct().join(have, "day", "left").join(conditions, "day", "left")
    status = F.when(F.col("_here").isNull() | (F.col("condition") == "missing"), "missing").when(F.col("condition") == "degraded", "degraded").otherwise("ok")
    reason = F.when(F.col("_here").isNull(), "no file").when(F.col("condition").isin("missing", "degraded"), F.concat(F.lit("reported "), F.col("condition"))).otherwise("")
    return out.select("day", status.alias("status"), reason.alias("reason"))
