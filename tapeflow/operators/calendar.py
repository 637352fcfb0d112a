"""Scheduled events and session phases. A calendar is small: it enters a plan as one sorted array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.schema import CALENDAR, NANOS, TIERS

#: The names of months in schedules begin with these.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

NY = "America/New_York"
DAY_S = 86_400


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the header ts_utc,name,tier,source -> ts (ns), name, tier, source, by time. Times without a zone are UTC;
    an unknown tier is an error."""
    raw = spark.read.schema(CALENDAR).csv(path, header=True)
    tier = F.lower(F.trim("tier"))
    ok = F.assert_true(tier.isin("high", "medium", "low"), F.concat(F.lit("unknown tier: "), tier))
    ts = F.unix_micros(F.to_timestamp(F.regexp_replace("ts_utc", "Z$", "+00:00"))) * 1000
    return raw.select(ts.alias("ts"), "name", tier.alias("tier"), "source", ok.alias("_ok")).where(F.col("_ok").isNull()).drop("_ok").orderBy("ts", "name")


def merge_calendars(spark: SparkSession, pattern: str) -> DataFrame:
    """All calendar files of a folder or glob as one, by time, for writing as one CSV."""
    return spark.read.schema(CALENDAR).csv(pattern, header=True).orderBy("ts_utc", "name")


def decisions(spark: SparkSession, days: list[str]) -> DataFrame:
    """Statement times of meetings: 14:00 New York time of each final day, as UTC; tier high."""
    local = F.to_timestamp(F.concat("day", F.lit(" 14:00:00")))
    out = spark.createDataFrame([(d,) for d in days], "day string").select(F.date_format(F.to_utc_timestamp(local, NY), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"))
    return out.select("ts_utc", F.lit("FOMC").alias("name"), F.lit("high").alias("tier"), F.lit("federalreserve.gov").alias("source")).orderBy("ts_utc")


def releases(pages: DataFrame, first_year: int = 2017, last_year: int = 2026) -> DataFrame:
    """pages(name, html): rows of schedule tables -> name, day, once each. Reads ``Month dd, yyyy`` cells."""
    cells = F.regexp_extract_all("html", F.lit(r"<td[^>]*>\s*([A-Z][a-z]+\.? \d{1,2}, \d{4})\s*</td>"), F.lit(1))
    found = pages.select("name", F.explode(cells).alias("cell"))
    day = F.coalesce(F.try_to_timestamp("cell", F.lit("MMMM d, yyyy")), F.try_to_timestamp(F.regexp_replace("cell", r"\.", ""), F.lit("MMM d, yyyy"))).cast("date")
    return found.select("name", day.alias("day")).where(F.year("day").between(first_year, last_year)).dropDuplicates(["name", "day"])


def _releases(found: DataFrame, day: Column, clock: Column, first_year: int, last_year: int) -> DataFrame:
    """The events of local days (``yyyy-M-d``) and clock times (``hh:mm AM``): one a (name, time), from the source that sorts last."""
    local = F.try_to_timestamp(F.concat_ws(" ", day, F.regexp_replace(clock, r"\s+", " ")), F.lit("yyyy-M-d hh:mm a"))
    out = found.withColumn("_utc", F.to_utc_timestamp(local, NY)).where(F.year("_utc").between(first_year, last_year))
    out = out.groupBy("name", "_utc").agg(F.max(F.struct("source", "tier")).alias("_s"))
    return out.select(F.date_format("_utc", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts_utc"), "name", F.col("_s.tier").alias("tier"), F.col("_s.source").alias("source"))


def timed_releases(pages: DataFrame, first_year: int = 2017, last_year: int = 2026, least_rows: int = 10) -> DataFrame:
    """pages(name, tier, source, html) of yearly schedules -> ts_utc, name, tier, source, to be read by ``read_calendar``.

    A row of a table counts if one cell is a date (``Jan. 11, 2024``, ``January 11, 2024``) and one a time of day
    (``08:30 AM``, New York); the last of several counts. Pages with fewer than ``least_rows`` such rows give nothing
    (``short_pages`` lists them), days that don't exist neither; years are those of the UTC time.
    """
    rows = _schedule_rows(pages).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("name", "source")))  # rows of one page
    return _releases(rows.where(F.col("_n") >= least_rows), F.col("_day"), F.col("_clock"), first_year, last_year)


def short_pages(pages: DataFrame, least_rows: int = 10) -> DataFrame:
    """name, source, rows of the pages that ``timed_releases`` leaves out."""
    found = _schedule_rows(pages).groupBy("name", "source").agg(F.count(F.lit(1)).alias("rows"))
    out = pages.select("name", "source").distinct().join(found, ["name", "source"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.where(F.col("rows") < least_rows)


def _schedule_rows(pages: DataFrame) -> DataFrame:
    """name, tier, source, _day, _clock of each table row with a date and a time."""
    row = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"^\s+|\s+$", ""))
    date = rf"^({'|'.join(MONTH_NAMES)})[a-z]*\.?\s+(\d{{1,2}}),\s+(\d{{4}})$"
    last = lambda pattern: F.try_element_at(F.filter("_cells", lambda c: c.rlike(pattern)), F.lit(-1))
    out = pages.select("name", "tier", "source", row.alias("_row")).withColumn("_cells", cells)
    out = out.withColumns({"_date": last(date), "_clock": last(r"^\d{2}:\d{2}\s+[AP]M$")}).where("_date IS NOT NULL AND _clock IS NOT NULL")
    part = lambda i: F.regexp_extract("_date", date, i)
    month = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), part(1))
    return out.select("name", "tier", "source", F.concat_ws("-", part(3), month, part(2)).alias("_day"), "_clock")


def monthly_releases(pages: DataFrame, first_year: int = 2017, last_year: int = 2026) -> DataFrame:
    """pages(name, tier, source, label, year, month, html) of monthly grids -> as ``timed_releases``.

    A cell begins with its day of the month and lists ``<label> <Month yyyy> 08:30 AM``, any number of times.
    """
    cell = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)))
    text = F.trim(F.regexp_replace(F.regexp_replace("_cell", "<[^>]+>", " "), r"\s+", " "))
    out = pages.select("name", "tier", "source", "label", "year", "month", cell.alias("_cell")).withColumn("_text", text)
    out = out.withColumn("_d", F.regexp_extract("_text", r"^(\d{1,2})\b", 1)).where("_d <> ''")
    clock = F.regexp_extract_all("_text", F.concat(F.lit(r"\Q"), "label", F.lit(r"\E\s+[A-Z][a-z]+ \d{4}\s+(\d{2}:\d{2} [AP]M)")), F.lit(1))
    out = out.withColumn("_clock", F.explode(clock))
    return _releases(out, F.concat_ws("-", "year", "month", "_d"), F.col("_clock"), first_year, last_year)


def write_calendar(events: DataFrame, path: str) -> None:
    """The events by time as one CSV file with the header that ``read_calendar`` and ``merge_calendars`` take; a calendar is small."""
    events.select("ts_utc", "name", "tier", "source").coalesce(1).sortWithinPartitions("ts_utc", "name").write.mode("overwrite").csv(path, header=True)


def release_gaps(found: DataFrame, most_days: int = 45) -> DataFrame:
    """Neighbouring releases of a name that lie further apart than ``most_days``."""
    before =F.lag("day").over(Window.partitionBy("name").orderBy("day"))
    return found.withColumn("before", before).where(F.datediff("day", "before") > most_days)


EVENTS = "_events"


def attach(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds the calendar to every row as one sorted array of (ts, tier code, name): a scalar subquery of the calendar's size."""
    code = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) - 1
    return rows.withColumn(EVENTS, calendar.agg(F.array_sort(F.collect_list(F.struct("ts", code.cast("int").alias("tier"), "name")))).scalar())


def with_next_last(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """For rows with the calendar attached. Adds seconds_to_next, next_tier (strictly after) and seconds_since_last, last_tier (at or before).

    Infinity and tier 0 where there is none.
    """
    t, events = F.col(ts), F.col(EVENTS)
    rows = rows.withColumn("_next", F.get(F.filter(events, lambda e: e["ts"] > t), F.lit(0)))
    rows = rows.withColumn("_last", F.element_at(F.concat(F.array(F.lit(None)), F.filter(events, lambda e: e["ts"] <= t)), -1))
    inf = F.lit(float("inf"))
    return rows.withColumns(
        {
            "seconds_to_next": F.coalesce((F.col("_next.ts") - t) / NANOS, inf),
            "next_tier": F.coalesce("_next.tier", F.lit(0)),
            "seconds_since_last": F.coalesce((t - F.col("_last.ts")) / NANOS, inf),
            "last_tier": F.coalesce("_last.tier", F.lit(0)),
        }
    ).drop("_next", "_last")


def in_blackout(events: Column, ts: Column, before: int = 120 * NANOS, after: int = 300 * NANOS) -> Column:
    """Whether a high event lies so near that ts is in [event - before, event + after]."""
    return F.exists(events, lambda e: (e["tier"] == 3) & (e["ts"] - before <= ts) & (ts <= e["ts"] + after))


def label_policy(events: Column, start: Column, end: Column) -> Column:
    """exclude with a high event in [start, end], else tag with a medium one, else ok."""
    inside = lambda tier: F.exists(events, lambda e: (e["tier"] == tier) & (e["ts"] >= start) & (e["ts"] <= end))
    return F.when(inside(3), "exclude").when(inside(2), "tag").otherwise("ok")


def covered(events: Column, start: Column, end: Column, days: int = 45) -> Column:
    """Whether any event lies within ``days`` of the interval."""
    reach = days * DAY_S * NANOS
    return F.exists(events, lambda e: (e["ts"] >= start - reach) & (e["ts"] <= end + reach))


def _local(ts: Column) -> Column:
    """New York wall time of ns since 1970; the session must run on UTC."""
    return F.from_utc_timestamp(F.timestamp_micros(F.floor(ts / 1000).cast("bigint")), NY)


def session_id(ts: Column) -> Column:
    """The trading day: New York time less 18 hours, as a date."""
    return F.to_date(_local(ts) - F.expr("interval 18 hours"))


def phase(ts: Column) -> Column:
    """asia, london [3:00, 8:20), ny [8:20, 13:30), post [13:30, 17:00), maintenance [17:00, 18:00) New York time."""
    local = _local(ts)
    m = F.hour(local) * 60 + F.minute(local)
    return F.when((m >= 180) & (m < 500), "london").when((m >= 500) & (m < 810), "ny").when((m >= 810) & (m < 1020), "post").when((m >= 1020) & (m < 1080), "maintenance").otherwise("asia")


def is_settlement(ts: Column) -> Column:
    """The minute before 13:30 New York time."""
    local = _local(ts)
    return (F.hour(local) == 13) & (F.minute(local) == 29)
