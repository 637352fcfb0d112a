import datetime

import pytest
from pyspark.sql import functions as F

from tapeflow.operators import calendar as K
from tapeflow.operators import rolls as R
from tapeflow.sources import archive


def ns(text):
    return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**9


def test_phases_and_sessions_follow_new_york_time(spark):
    times = ["2024-01-16T08:00:00", "2024-07-16T07:00:00", "2024-01-16T18:29:30", "2024-01-16T22:30:00", "2024-01-16T23:00:00", "2024-01-16T22:59:59"]
    df = spark.createDataFrame([(i, ns(t)) for i, t in enumerate(times)], "i int, ts long")
    got = df.select("i", K.phase(F.col("ts")).alias("p"), K.is_settlement(F.col("ts")).alias("s"), K.session_id(F.col("ts")).alias("d")).orderBy("i").collect()
    assert [r["p"] for r in got] == ["london", "london", "ny", "maintenance", "asia", "maintenance"]
    assert [r["s"] for r in got] == [False, False, True, False, False, False]
    assert [str(r["d"]) for r in got][-2:] == ["2024-01-16", "2024-01-15"]


def test_calendar_file_policy_and_blackout(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("ts_utc,name,tier,source\n2024-03-12T12:30:00Z,CPI, High ,x\n2024-03-12T18:00:00,auction,medium,x\n2024-03-13T14:00:00,survey,low,x\n")
    cal = K.read_calendar(spark, str(path))
    assert [(r["ts"], r["tier"]) for r in cal.collect()] == [(ns("2024-03-12T12:30:00"), "high"), (ns("2024-03-12T18:00:00"), "medium"), (ns("2024-03-13T14:00:00"), "low")]
    t = ns("2024-03-12T12:30:00")
    df = K.attach(spark.createDataFrame([(0, t - 120 * 10**9), (1, t - 121 * 10**9), (2, t + 300 * 10**9), (3, ns("2024-03-12T17:55:00")), (4, ns("2024-04-01T00:00:00"))], "i int, ts long"), cal)
    e = F.col(K.EVENTS)
    got = df.select("i", K.in_blackout(e, F.col("ts")).alias("b"), K.label_policy(e, F.col("ts"), F.col("ts") + 600 * 10**9).alias("p")).orderBy("i").collect()
    assert [r["b"] for r in got] == [True, False, True, False, False]
    assert [r["p"] for r in got] == ["exclude", "exclude", "ok", "tag", "ok"]
    last = K.with_next_last(df).where("i = 4").first()
    assert last["seconds_to_next"] == float("inf") and last["next_tier"] == 0 and last["last_tier"] == 1
    path.write_text("ts_utc,name,tier,source\n2024-03-12T12:30:00Z,CPI,urgent,x\n")
    with pytest.raises(Exception, match="unknown tier"):
        K.read_calendar(spark, str(path)).collect()


def test_release_pages(spark):
    html = "<table><tr><td>March 12, 2024</td><td>8:30</td></tr><tr><td>Jun. 5, 2024</td></tr><tr><td>March 12, 2024</td></tr><tr><td>March 1, 1999</td></tr></table>"
    found = K.releases(spark.createDataFrame([("CPI", html)], "name string, html string"))
    assert sorted(str(r["day"]) for r in found.collect()) == ["2024-03-12", "2024-06-05"]
    assert K.release_gaps(found).count() == 1


def test_timed_releases(spark, tmp_path):
    row = "<tr class='x'>\n<th>{}</th><td><b>{}</b>\n</td><td> {} </td></tr>"
    days = [("Jan. 11, 2024", "08:30 AM"), ("July 11, 2024", "08:30 AM"), ("August 14, 2024", "02:00 PM"), ("March 12, 2024", ""), ("Feb. 31, 2024", "08:30 AM"), ("May 1, 1999", "08:30 AM"), ("Jan. 11, 2024", "08:30 AM")]
    html = "<table>" + "".join(row.format("ref", d, t) for d, t in days) + "</table>"
    pages = spark.createDataFrame([("CPI", "high", "a", html), ("CPI", "high", "b", html), ("PPI", "medium", "c", row.format("", "June 3, 2024", "08:30 AM")), ("X", "low", "d", None)], "name string, tier string, source string, html string")
    found = K.timed_releases(pages, least_rows=5)
    got = sorted(map(tuple, found.collect()))
    assert got == [(t, "CPI", "high", "b") for t in ("2024-01-11T13:30:00+00:00", "2024-07-11T12:30:00+00:00", "2024-08-14T18:00:00+00:00")]
    assert sorted(map(tuple, K.short_pages(pages, 5).collect())) == [("PPI", "c", 1), ("X", "d", 0)]
    K.write_calendar(found, str(tmp_path / "events_a.csv"))
    K.write_calendar(K.decisions(spark, ["2024-01-31"]), str(tmp_path / "events_b.csv"))
    K.write_calendar(K.merge_calendars(spark, str(tmp_path / "events_*.csv")), str(tmp_path / "events.csv"))
    back = K.read_calendar(spark, str(tmp_path / "events.csv")).collect()
    assert [r["ts"] for r in back] == [ns(t) for t in ("2024-01-11T13:30:00", "2024-01-31T19:00:00", "2024-07-11T12:30:00", "2024-08-14T18:00:00")]


def test_monthly_grids(spark):
    html = "<tr><td>blank</td><td><p>9</p>Producer Price Index (x)<br>May 2018 08:30 AM</td><td>11<br/>Other Index May 2018 10:00 AM Producer Price\n Index May 2018 08:30 AM <i>Producer Price Index</i> June 2018 01:15 PM</td></tr>"
    page = spark.createDataFrame([("PPI", "medium", "m", "Producer Price Index", 2018, 6, html)], "name string, tier string, source string, label string, year int, month int, html string")
    assert sorted(r["ts_utc"] for r in K.monthly_releases(page).collect()) == ["2018-06-11T12:30:00+00:00", "2018-06-11T17:15:00+00:00"]


def test_contracts_and_expiries(spark):
    d = datetime.date
    df = spark.createDataFrame([(d(2026, 1, 6), "GCG6"), (d(2026, 1, 6), "GCZ5"), (d(2019, 12, 30), "GCG0"), (d(2026, 1, 6), "GCG6-GCJ6")], "session_date date, symbol string")
    got = {(r["symbol"]): (str(r["delivery"]), str(r["expiry"])) for r in R.with_contract(df).collect()}
    assert got == {"GCG6": ("2026-02-01", "2026-02-25"), "GCZ5": ("2025-12-01", "2025-12-29"), "GCG0": ("2020-02-01", "2020-02-26")}


def test_roll_ledger_waits_for_two_sessions_and_acts_on_the_next(spark):
    d0 = datetime.date(2026, 1, 5)
    g, j = datetime.date(2026, 2, 25), datetime.date(2026, 4, 28)
    volumes = [(10, 1), (5, 9), (10, 9), (5, 9), (4, 9), (3, 9), (2, 9)]
    rows = [(d0 + datetime.timedelta(i), s, v, x) for i, (a, b) in enumerate(volumes) for s, v, x in (("GCG6", a, g), ("GCJ6", b, j))]
    got = R.roll_ledger(spark.createDataFrame(rows, "session_date date, symbol string, volume long, expiry date")).orderBy("session_date").collect()
    assert [r["active"] for r in got] == ["GCG6"] * 5 + ["GCJ6"] * 2
    assert [r["cross_streak"] for r in got] == [0, 1, 0, 1, 2, 0, 0] and [r["rolled"] for r in got] == [False] * 5 + [True, False]


def test_ledger_answers_for_its_days_and_against_what_is_known(spark):
    d = datetime.date
    rows = [(d(2026, 1, i), "GCG6", False, d(2026, 2, 25), 40, False, 0.9, True) for i in (5, 6, 7)] + [(d(2026, 1, 8), "GCJ6", True, d(2026, 4, 28), 99, False, 0.9, True)]
    ledger = spark.createDataFrame(rows, "session_date date, active string, rolled boolean, active_expiry date, days_to_expiry int, forced boolean, active_share double, leader_is_active boolean")
    assert R.ledger_checks(ledger, ("2026-01-05", "2026-01-07", "GCG6")).first()["known"] and not R.ledger_checks(ledger, ("2026-01-05", "2026-01-08", "GCG6")).first()["known"]
    days = spark.createDataFrame([(d(2026, 1, 8),), (d(2026, 1, 5),)], "session_date date")
    assert sorted(r["active"] for r in R.with_active(days, ledger).collect()) == ["GCG6", "GCJ6"]
    with pytest.raises(Exception, match="not in the ledger: 2026-02-01"):
        R.with_active(spark.createDataFrame([(d(2026, 2, 1),)], "session_date date"), ledger).collect()
    crossed = R.with_crosses_roll(days, ledger, F.lit("2026-01-07").cast("date"), F.col("session_date")).collect()
    assert {str(r["session_date"]): r["crosses_roll"] for r in crossed} == {"2026-01-08": True, "2026-01-05": False}
    assert R.with_crosses_roll(days, ledger, F.lit("2026-01-08").cast("date"), F.lit("2026-03-01").cast("date")).where("crosses_roll").count() == 0


def test_worst_condition_ranks_pending_above_available(spark):
    reports = spark.createDataFrame([(1, "pending", 1), (1, "available", 2), (2, "degraded", 1), (2, "pending", 2), (3, "missing", 1), (3, "degraded", 2)], "day int, condition string, n int")
    assert {r["day"]: r["condition"] for r in R.worst_condition(reports).collect()} == {1: "pending", 2: "degraded", 3: "missing"}


def test_next_and_last_events_in_hours_that_the_session_zone_skips(spark, tmp_path):
    from tapeflow.plans.calendar_queries import calendar_next_last

    times = ["2023-03-12T02:30:00", "2024-01-05T19:00:00", "2024-03-10T02:30:00"]  # the first and last don't exist in New York
    df = spark.createDataFrame([(i, t, "{\"k\": 1}") for i, t in enumerate(times)], "event_id long, t string, props string")
    df.select("event_id", F.to_timestamp_ntz("t").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), "props").write.parquet(str(tmp_path / "events.parquet"))
    inf = float("inf")
    since = lambda a, b: (ns(b) - ns(a)) / 1e9
    want = [(0, since(times[0], "2024-01-02T13:30:00"), 3, inf, 0), (1, since(times[1], "2024-01-09T14:00:00"), 1, 0.0, 3), (2, inf, 0, since("2024-01-25T13:30:00", times[2]), 3)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert sorted(tuple(r) for r in calendar_next_last(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_archive_round_trip(spark, tmp_path):
    from tests.records import frame, random_stream

    mbo = frame(spark, random_stream(50, 1))
    archive.write_sessions(mbo, str(tmp_path / "a"))
    archive.write_sessions(mbo, str(tmp_path / "a"))
    back = archive.read_sessions(spark, str(tmp_path / "a"), "2024-01-01", "2024-12-31")
    assert back.count() == 50 and archive.missing_sessions(mbo, back).count() == 0
    (tmp_path / "x-20240116.csv").write_text("header\n" + "\n".join(",".join(map(str, r)) for r in random_stream(20, 2)))
    spark.dataSource.register(archive.RecordFiles)
    assert spark.read.format("mbo_csv").option("paths", str(tmp_path / "x-20240116.csv")).load().count() == 20
    found = archive.inventory(spark, str(tmp_path / "*.csv"))
    assert str(found.first()["day"]) == "2024-01-16" and archive.spot_files(found).count() == 1
