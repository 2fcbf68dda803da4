from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fieldmill.operators.instants import convert, estimate_offsets, normalise, settled_histories


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-10-20T09:08:07.000123Z", None, us(2024, 10, 20, 9, 8, 7, micro=123)),
    ("2024-10-20t09:08:07.5z", None, us(2024, 10, 20, 9, 8, 7, micro=500_000)),
    ("2024-10-20T09:08:07,123456789Z", None, us(2024, 10, 20, 9, 8, 7, micro=123_456)),
    (" 2024-10-20T09:08:07Z\t", None, us(2024, 10, 20, 9, 8, 7)),
    ("2024-10-20T09:08:07Z ", None, us(2024, 10, 20, 9, 8, 7)),
    ("2024-10-20 09:08:07", "Europe/Berlin", us(2024, 10, 20, 7, 8, 7)),
    ("2024-10-20 09:08:07", None, None),
    ("2024-10-20 09:08:07", "No/Where", None),
    ("2024-10-20T09:08:07+0530", "Europe/Berlin", us(2024, 10, 20, 3, 38, 7)),
    ("2024-10-20T09:08:07-04", None, us(2024, 10, 20, 13, 8, 7)),
    ("2024-10-20T09:08:07+02:00[America/New_York]", None, us(2024, 10, 20, 7, 8, 7)),
    ("2024-10-20 09:08:07 America/New_York", "Asia/Tokyo", us(2024, 10, 20, 13, 8, 7)),
    ("2024-10-20 09:08:07 EDT", "Asia/Tokyo", us(2024, 10, 20, 13, 8, 7)),
    ("2024-10-20 09:08:07 QQT", "Asia/Tokyo", None),
    ("20241020T090807.25Z", None, us(2024, 10, 20, 9, 8, 7, micro=250_000)),
    ("20241020090807", "UTC", us(2024, 10, 20, 9, 8, 7)),
    ("10/04/2024 12:05:06 AM", "UTC", us(2024, 10, 4, 0, 5, 6)),
    ("10/04/2024 12:05:06 PM", "UTC", us(2024, 10, 4, 12, 5, 6)),
    ("10/04/2024 13:05:06 PM", "UTC", None),
    ("04.10.2024 13:05:06", "UTC", us(2024, 10, 4, 13, 5, 6)),
    ("Sun, 20 Oct 2024 09:08:07 -0700", None, us(2024, 10, 20, 16, 8, 7)),
    ("[20/Oct/2024:09:08:07 +0200]", None, us(2024, 10, 20, 7, 8, 7)),
    ("2024 6 OCT 01:06:23", "UTC", us(2024, 10, 6, 1, 6, 23)),
    ("Sun Oct 20 09:08:07 2024", "UTC", us(2024, 10, 20, 9, 8, 7)),
    ("2024-10-27 02:30:00", "Europe/Berlin", us(2024, 10, 27, 0, 30)),  # occurs twice: the earlier
    ("2024-03-31 02:30:00", "Europe/Berlin", None),  # never occurs
    ("2024-10-06 02:30:00", "Australia/Sydney", None),
    ("1729415287", "Asia/Tokyo", us(2024, 10, 20, 9, 8, 7)),
    ("1729415287.1234567", None, us(2024, 10, 20, 9, 8, 7, micro=123_456)),
    ("1729415287123", None, us(2024, 10, 20, 9, 8, 7, micro=123_000)),
    ("1729415287123456", None, us(2024, 10, 20, 9, 8, 7, micro=123_456)),
    ("1729415287123456789", None, us(2024, 10, 20, 9, 8, 7, micro=123_456)),
    ("2147483647", None, None),
    ("86400", None, None),
    ("2024-02-30T10:00:00Z", None, None),
    ("2024-13-45T99:00:00Z", None, None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("1999-10-20T09:08:07Z", None, None),
    ("2024-10-20T", "UTC", None),
    ("2024-10-20T09:08", "UTC", None),
    ("T09:08:07Z", None, None),
    ("not recorded", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
]


def test_written_forms(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, text string, zone string")
    got = {r.i: r.utc_us for r in normalise(df, "text", zone="zone").collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]]
    assert not wrong and len(got) == len(CASES)


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
def test_the_session_zone_does_not_matter(spark, zone):
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        test_written_forms(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_extra_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([("1729415287", "a", 1), ("1729415287", "a", 1)], "`t.x` string, utc_us string, `a.b` int")
    out = normalise(df, "t.x", fixed_zone="UTC")
    assert out.columns == ["t.x", "a.b", "utc_us"] and [r.utc_us for r in out.collect()] == [us(2024, 10, 20, 9, 8, 7)] * 2
    assert normalise(df.limit(0), "t.x").count() == 0
    long = spark.createDataFrame([("9" * 200_000,), ("2024-" * 50_000,)], "t string")
    assert [r.utc_us for r in normalise(long, "t").collect()] == [None, None]


def test_fixed_zone(spark):
    df = spark.createDataFrame([("2024-10-20 09:08:07",)], "t string")
    assert normalise(df, "t", fixed_zone="Asia/Kolkata").first().utc_us == us(2024, 10, 20, 3, 38, 7)


def test_estimated_history_finds_the_change_of_offset(spark):
    rows, day = [], 86_400_000_000
    base = us(2024, 10, 20)
    for d in range(14):
        for k in range(12):
            true = base + d * day + k * 3_600_000_000
            east = (2 if d < 7 else 1) * 3_600_000_000
            late = 5_000_000 if k else 40_000_000_000  # one late row a day
            text = datetime.fromtimestamp((true + late + east) / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
            rows.append(("s", text, true))
    rows += [("s", None, base), ("s", "2024-10-20T00:00:00Z", base), (None, "2024-10-20 00:00:00", base), ("t", "word", base)]
    df = spark.createDataFrame(rows, "place string, text string, ref bigint")
    got = [(r.place, r.offset_minutes, r.readings, r.violations) for r in estimate_offsets(df, "place", "text", F.col("ref")).orderBy("from_us").collect()]
    assert got == [("s", 120, 84, 7), ("s", 60, 84, 7)]


def test_readings_that_no_offset_explains_are_counted(spark):
    day, hour, base = 86_400_000_000, 3_600_000_000, us(2024, 10, 20)
    spelled = lambda t: datetime.fromtimestamp(t / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    rows = [("s", spelled(base + k * hour + hour), base + k * hour) for k in range(5)]
    rows += [("s", spelled(base + 40 * hour), base), ("s", spelled(base - 30 * hour), base), ("s", spelled(base + 3 * day), base + day), ("far", spelled(base + 2 * day), base)]
    df = spark.createDataFrame(rows, "place string, text string, ref bigint")
    got = [(r.place, r.offset_minutes, r.readings, r.violations, (r.to_us - r.from_us) // hour) for r in estimate_offsets(df, "place", "text", F.col("ref")).orderBy("place").collect()]
    assert got == [("far", None, 1, 1, 1), ("s", 60, 8, 3, 25)]


def test_conversion_by_the_settled_history(spark):
    """A declared zone that readings bear out is used to the instant, a refuted one gives way, an undeclared place has its estimate."""
    spelled = lambda t: datetime.fromtimestamp(t / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    hour, base, rows = 3_600_000_000, us(2024, 10, 26), []
    for k in range(96):
        at = base + k * hour
        berlin = (2 if at < us(2024, 10, 27, 1) else 1) * hour
        rows += [("b", spelled(at + berlin + 60_000_000), at), ("wrong", spelled(at + berlin + 60_000_000), at), ("open", spelled(at + 5 * hour + 60_000_000), at)]
    df = spark.createDataFrame(rows + [("few", "2024-10-26 00:00:30", base)], "place string, text string, ref bigint")
    zones = spark.createDataFrame([("b", "Europe/Berlin"), ("b", "Europe/Berlin"), ("wrong", "Asia/Tokyo"), ("few", "Asia/Tokyo"), ("unread", "No/Such"), (None, "UTC")], "place string, zone string").where("place is not null")
    found = estimate_offsets(df, "place", "text", F.col("ref"), zones=zones)
    assert [(r.offset_minutes, r.violations, r.declared_violations) for r in found.where("place = 'b'").orderBy("from_us").collect()] == [(120, 0, 0), (60, 0, 0)]
    settled = settled_histories(found, zones)
    assert {r.place: r.zone for r in settled.collect()} == {"b": "Europe/Berlin", "wrong": None, "few": "Asia/Tokyo", "open": None, "unread": "No/Such"}
    asked = [("b", "2024-10-27 02:30:00"), ("b", "2025-03-30 02:30:00"), ("wrong", "2024-10-26 12:00:00"), ("wrong", "2024-10-27 02:30:00"), ("wrong", "2024-10-28 12:00:00"), ("open", "2024-10-28 12:00:00"), ("few", "2024-10-26 09:00:00"),
             ("unread", "2024-10-26 09:00:00"), ("z", "2024-10-26 09:00:00"), (None, "2024-10-26 09:00:00"), ("z", "2024-10-26 09:00:00Z"), ("b", None)]
    got = convert(spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "i int, p string, t string"), "t", "p", settled).orderBy("i").collect()
    want = [us(2024, 10, 27, 0, 30), None, us(2024, 10, 26, 10), us(2024, 10, 27, 0, 30), us(2024, 10, 28, 11), us(2024, 10, 28, 7), us(2024, 10, 26), None, None, None, us(2024, 10, 26, 9), None]
    assert [r.utc_us for r in got] == want and got[0].asDict().keys() == {"i", "p", "t", "utc_us"}
    assert convert(spark.createDataFrame([], "p string, t string, utc_us int"), "t", "p", settled.limit(0)).columns == ["p", "t", "utc_us"]
    assert estimate_offsets(df.limit(0), "place", "text", F.col("ref"), zones=zones.limit(0)).count() == 0
    clash = spark.createDataFrame([("b", "2024-10-26 12:00:00", 1, 2)], "place string, t string, zone int, spans int")
    assert convert(clash, "t", "place", settled).first().asDict() == {"place": "b", "t": "2024-10-26 12:00:00", "zone": 1, "spans": 2, "utc_us": us(2024, 10, 26, 10)}
