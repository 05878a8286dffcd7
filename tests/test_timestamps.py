from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.operators.timestamps import days_from_civil, normalise_columns, parse_instant

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*parts, zone="UTC", fold=0):
    return (datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


CASES = [
    ("2021-03-28T01:38:19.785890+01:00[Europe/Paris]", "Asia/Tokyo", us(2021, 3, 28, 0, 38, 19, 785890)),
    ("2016-10-03T05:07:05.439395127+00:00", None, us(2016, 10, 3, 5, 7, 5, 439395)),
    ("2016-05-23 06:51:34 CEST", "Europe/Berlin", us(2016, 5, 23, 4, 51, 34)),
    ("26 Nov 2016, 02:26:54 EST", "Asia/Tokyo", us(2016, 11, 26, 7, 26, 54)),
    ("Sun, 24 Jan 2016 04:05:52 +0000", "Etc/Nowhere", us(2016, 1, 24, 4, 5, 52)),
    ("14,June,2016", "Europe/Berlin", us(2016, 6, 14, zone="Europe/Berlin")),
    ("11 mars 2018 0h17", "America/Los_Angeles", us(2018, 3, 11, 0, 17, zone="America/Los_Angeles")),
    ("18. April 2016, 12:31", "Asia/Tokyo", us(2016, 4, 18, 12, 31, zone="Asia/Tokyo")),
    ("05.02.16 22:45 Uhr", "Pacific/Auckland", us(2016, 2, 5, 22, 45, zone="Pacific/Auckland")),
    ("03/02/2016 12:19 am", "America/New_York", us(2016, 3, 2, 0, 19, zone="America/New_York")),
    ("6/17/2019, 1:14 p.m.", "Asia/Kathmandu", us(2019, 6, 17, 13, 14, zone="Asia/Kathmandu")),
    ("September 8, 2021 at 12:41PM", None, us(2021, 9, 8, 12, 41)),
    ("20160218_133422", "Australia/Sydney", us(2016, 2, 18, 13, 34, 22, zone="Australia/Sydney")),
    ("20190717T171453Z", "Asia/Tokyo", us(2019, 7, 17, 17, 14, 53)),
    (" 2022-09-26 03:06-07:00 \n", "UTC", us(2022, 9, 26, 10, 6)),
    ("1526117907", "Europe/London", 1526117907 * 10**6),
    ("@1633688776", None, 1633688776 * 10**6),
    ("1570514192.977", None, 1570514192977000),
    ("1509192444416", None, 1509192444416000),
    ("1636928136783200", None, 1636928136783200),
    ("2019-11-03 01:30:00", "America/New_York", us(2019, 11, 3, 1, 30, zone="America/New_York", fold=0)),
    ("2018-03-11 02:30:00", "America/Los_Angeles", us(2018, 3, 11, 2, 30, zone="America/Los_Angeles", fold=0)),
    ("2024-02-29", "", us(2024, 2, 29)),
    ("2016-07-29T10:40", "Europe/Atlantis", us(2016, 7, 29, 10, 40)),
    ("2020-06-01 12:00:00 BST", "Asia/Tokyo", us(2020, 6, 1, 11)),
    *[(bad, "UTC", None) for bad in ("2023-02-29", "2023-02-30 10:00:00", "0000-00-00 00:00:00", "2021-13-05T09:00:00Z", "25:61", "", "  ", "null", "last tuesday", "??.05.2020", "13/40/2020 1:00 PM", "13:00 PM", "99999999999", "20160218", "x" * 50_000)],
    (None, "UTC", None),
]


def test_formats_against_zoneinfo(spark):
    rows = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string")
    got = {r.i: r.u for r in rows.select("i", parse_instant(spark, F.col("t"), F.col("z")).alias("u")).collect()}
    assert [(CASES[i][0], got[i]) for i in sorted(got)] == [(t, want) for t, _, want in CASES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.datetimes(min_value=datetime(2016, 1, 1), max_value=datetime(2026, 12, 31)), min_size=1, max_size=40), st.sampled_from(["Europe/Berlin", "America/New_York", "Pacific/Auckland", "Asia/Kathmandu"]))
def test_local_times_against_zoneinfo(spark, times, zone):
    rows = spark.createDataFrame([(i, t.isoformat(sep=" ")) for i, t in enumerate(times)], "i int, t string")
    got = {r.i: r.u for r in rows.select("i", parse_instant(spark, F.col("t"), F.lit(zone)).alias("u")).collect()}
    assert [got[i] for i in range(len(times))] == [us(t.year, t.month, t.day, t.hour, t.minute, t.second, t.microsecond, zone=zone) for t in times]


def test_day_numbers(spark):
    dates = [(1600, 2, 29), (1970, 1, 1), (1999, 12, 31), (2000, 3, 1), (2400, 2, 29)]
    rows = spark.createDataFrame(dates, "y int, m int, d int")
    got = [r.n for r in rows.select(days_from_civil(F.col("y"), F.col("m"), F.col("d")).alias("n")).collect()]
    assert got == [(datetime(*d) - datetime(1970, 1, 1)).days for d in dates]


def test_repeated_rows_extra_columns_and_empty_table(spark):
    schema = "group_id string, uuid string, a string, time_zone string, instant_us string"
    rows = [("g", "1", "2020-01-01", None, "clash")] * 3 + [("g", "1", "2020-01-02", None, "x"), (None, None, None, None, None)]
    got = normalise_columns(spark.createDataFrame(rows, schema), ["a"], ["group_id", "uuid"])
    assert sorted(r.instant_us for r in got.collect()) == [us(2020, 1, 1), us(2020, 1, 2)]
    assert normalise_columns(spark.createDataFrame([], schema), ["a"], ["group_id", "uuid"]).count() == 0


def test_no_python_in_the_plan(spark, data):
    from marginalia.plans.timestamps import p2_found

    plan = p2_found(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("zone", ["Europe/London", "Australia/Sydney"])
def test_whole_table(spark, data, zone):
    from marginalia.plans.timestamps import p2_found

    rows = p2_found(spark, data)
    assert rows.columns == ["group_id", "uuid", "field_name", "instant_us"]
    assert rows.count() > 100
