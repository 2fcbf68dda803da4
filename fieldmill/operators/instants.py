"""Written timestamps of mixed formats, precisions and zones, as microseconds since 1970 in UTC.

A text is rewritten by one anchored pattern per written form into `|year|month|day|hour|minute:second.fraction|half|zone`, put
together again in one standard form and read by the built-in cast, so the work stays in the JVM and does not depend on the
session's time zone. Texts already in the canonical form skip the patterns.

Where a text names no zone, the zone comes from an offset history of the place that wrote it. `declared` histories come from a
zone table. `estimate_offsets` finds the history of a place from its own readings: it aligns each zoneless reading with a
reference instant of the same row, counts for each hour how many readings every offset would violate, and takes the sequence of
offsets with the fewest violations, each change of offset counting as some violations too. `settled_histories` puts the declared zone
to the test against that, and `convert` reads zoneless texts by the history that came out.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, col

MICRO = 1_000_000
#: Real instants lie in [FIRST, LAST), in seconds.
FIRST, LAST = 1_262_304_000, 1_893_456_000
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\z"

_SPACE = " \t\r\n\f     ​ 　﻿"
_TIME = r"(\d{1,2}):(\d{2}:\d{2})(?:[.,](\d+))?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r" ?((?:[Zz]|(?:UTC|GMT)?[+\-−]\d{2}(?::?\d{2}){0,2})?(?: ?[\[(]?[A-Za-z][A-Za-z0-9_+/\-]*[\])]?)?)"
_DAY_NAME = r"(?:[A-Za-z]{3,9}\.?,? +)?"
_MONTH = r"([A-Za-z]{3,9})\.?"

#: Written forms, each with the order of its groups in the common form. The leading | keeps later patterns off.
FORMS = (
    (rf"^(\d{{4}})([-/])(\d{{2}})\2(\d{{2}})(?:[Tt]| +){_TIME}{_ZONE}\z", "|$1|$3|$4|$5|$6.$70||$8"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE + r"\z", "|$1|$2|$3|$4|$5:$6.$70||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +{_TIME}{_HALF}{_ZONE}\z", "|$3|$1|$2|$4|$5.$60|$7|$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +{_TIME}{_HALF}{_ZONE}\z", "|$3|$2|$1|$4|$5.$60|$7|$8"),
    (rf"^\[?(\d{{1,2}})/{_MONTH}/(\d{{4}}):{_TIME}{_ZONE}\]?\z", "|$3|$2|$1|$4|$5.$60||$7"),
    (rf"^{_DAY_NAME}(\d{{1,2}})[ \-]{_MONTH}[ \-](\d{{4}}),? +{_TIME}{_HALF}{_ZONE}\z", "|$3|$2|$1|$4|$5.$60|$7|$8"),
    (rf"^(\d{{4}})[ \-](\d{{1,2}})[ \-]{_MONTH}[ \-]+{_TIME}{_HALF}{_ZONE}\z", "|$1|$3|$2|$4|$5.$60|$7|$8"),
    (rf"^(\d{{4}})[ \-]{_MONTH}[ \-](\d{{1,2}}),? +{_TIME}{_HALF}{_ZONE}\z", "|$1|$2|$3|$4|$5.$60|$7|$8"),
    (rf"^{_DAY_NAME}{_MONTH} +(\d{{1,2}}), +(\d{{4}}),? +{_TIME}{_HALF}{_ZONE}\z", "|$3|$1|$2|$4|$5.$60|$7|$8"),
    (rf"^{_DAY_NAME}{_MONTH} +(\d{{1,2}}) +{_TIME} +(?:([A-Za-z]{{1,5}}) +)?(\d{{4}})\z", "|$7|$1|$2|$3|$4.$50||$6"),
)

#: Minutes east of UTC of zone abbreviations in use by the public time zone database and mail headers.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "PKT": 300, "ICT": 420, "WIB": 420, "SGT": 480, "HKT": 480, "AWST": 480,
    "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "SAST": 120,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
}


def _clock(minutes: int) -> str:
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def _micros(text: Column) -> Column:
    return F.unix_micros(text.try_cast("timestamp"))


def zoned_micros(wall_text: Column, wall: Column, zone: Column) -> Column:
    """UTC microseconds of a wall reading in a named zone: the earlier instant where it occurs twice, null where it never does.

    An unknown zone gives null too.
    """
    us = _micros(F.concat(wall_text, F.lit(" "), zone))
    return F.when(us.isNotNull() & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) == wall), us)


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns computed once: a generated row keeps the optimizer from copying them into every later use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def read_texts(df: DataFrame, text: Column, prefix: str = "__at_") -> DataFrame:
    """df with {prefix}text and {prefix}wall, the reading without its zone as text and in microseconds, {prefix}known, the instant
    that needs no zone from outside, and {prefix}open, whether the reading is valid and names no zone.
    """
    p = prefix
    c = lambda n: F.col(p + n)
    form = F.btrim(text, F.lit(_SPACE))
    for pattern, order in FORMS:
        form = F.regexp_replace(form, pattern, order)
    read = _fixed(df, **{p + "form": F.when(text.rlike(CANONICAL), text).otherwise(form)})
    number = F.when(c("form").rlike(r"^\d{10,19}(?:\.\d+)?\z"), F.split(c("form"), r"\.", 2))
    read = _fixed(read, **{p + "part": F.when(c("form").startswith("|"), F.split(c("form"), r"\|", 8)), p + "number": number})
    part = c("part")
    month = F.expr(f"instr('janfebmaraprmayjunjulaugsepoctnovdec', substr(lower(`{p}part`[2]), 1, 3)) + 2")
    month = F.when(part[2].rlike("^[0-9]"), part[2]).when(month % 3 == 0, F.expr(f"string((instr('janfebmaraprmayjunjulaugsepoctnovdec', substr(lower(`{p}part`[2]), 1, 3)) + 2) div 3)"))
    hour = part[4].try_cast("int")
    hour = F.when(part[6] == "", part[4]).when(hour.between(1, 12), (hour % 12 + F.when(F.lower(part[6]) == "p", 12).otherwise(0)).cast("string"))
    zone = F.translate(F.translate(part[7], "−", "-"), "[]() ", "")
    wall_text = F.concat(part[1], F.lit("-"), month, F.lit("-"), part[3], F.lit(" "), hour, F.lit(":"), part[5])
    read = _fixed(read, **{p + "text": wall_text, p + "zone": zone, p + "stated": F.regexp_extract(zone, r"^(?:[Zz]|UTC|GMT)?([+-]\d{2}(?::?\d{2}){0,2})", 1)})
    table = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, _clock(v))))
    short = F.when(c("stated") != "", c("stated")).when(c("zone").rlike("^[A-Za-z]{1,5}\\z"), F.try_element_at(table, F.upper(c("zone"))))
    read = _fixed(read, **{p + "wall": _micros(F.concat(c("text"), F.lit("Z"))), p + "east": short})
    zoned = F.when(c("east").isNotNull(), _micros(F.concat(c("text"), c("east")))).when(
        c("zone") != "", zoned_micros(c("text"), c("wall"), F.regexp_replace(c("zone"), r"^[Zz](?=[A-Z][a-z])", ""))
    )
    whole = c("number")[0].try_cast("bigint")
    part_of = lambda n: F.rpad(F.substring(F.coalesce(F.get(c("number"), F.lit(1)), F.lit("")), 1, n), n, "0").cast("bigint")
    inside = lambda k: (whole >= FIRST * k) & (whole < LAST * k)
    bare = (
        F.when(inside(1), whole * MICRO + part_of(6)).when(inside(1000), whole * 1000 + part_of(3))
        .when(inside(MICRO), whole).when(inside(1000 * MICRO), F.expr(f"try_cast(`{p}number`[0] as bigint) div 1000"))
    )
    known = F.when(c("form").rlike(CANONICAL), _micros(c("form"))).when(c("number").isNotNull(), bare).otherwise(zoned)
    read = _fixed(read, **{p + "known": known, p + "open": c("wall").isNotNull() & (c("zone") == "")})
    return read.select(*(col(x) for x in df.columns), c("text"), c("wall"), c("known"), c("open"))


def real(us: Column) -> Column:
    """us if it lies where real instants do, else null."""
    return F.when((us >= FIRST * MICRO) & (us < LAST * MICRO), us)


def normalise(df: DataFrame, text: str, out: str = "utc_us", zone: str | None = None, fixed_zone: str | None = None) -> DataFrame:
    """df with `out`, the instant (bigint, microseconds UTC) that the column `text` denotes, or null.

    zone names a column with the IANA zone for texts that name none (null or unknown: such a text denotes nothing);
    fixed_zone is one zone for all rows. Nulls, blanks and words give null; a reading that occurs twice is the earlier instant,
    one that never occurs is null; digits finer than a microsecond are cut. Every row is kept, repeated ones too, and all other
    columns pass through; `out` replaces a column of that name. An empty table gives an empty one.
    """
    p = "__at_"
    read = read_texts(df, col(text).cast("string"), p)
    if fixed_zone == "UTC":
        opened = F.col(p + "wall")
    else:
        place = F.lit(fixed_zone) if fixed_zone else col(zone) if zone else F.lit(None).cast("string")
        opened = zoned_micros(F.col(p + "text"), F.col(p + "wall"), place)
    us = real(F.coalesce(F.col(p + "known"), F.when(F.col(p + "open"), opened)))
    read = _fixed(read, **{p + "out": us})
    return read.select(*(col(c) for c in df.columns if c != out), F.col(p + "out").alias(out))


# Offset histories ---------------------------------------------------------------------------------------------------

#: Offsets lie on quarter hours from 12 hours west to 14 hours east.
STEP_US = 15 * 60 * MICRO
LOWEST, HIGHEST = -48, 56


def offset_votes(df: DataFrame, place: str, text: str, reference_us: Column) -> DataFrame:
    """(place, hour, step, n): zoneless readings by the quarter-hour step that lies between them and their reference instant.

    Step is null for readings that lie so far from their reference that no offset explains them. Bounded by places x hours x steps,
    whatever the rows; partial votes of parts of the data can be added up.
    """
    p = "__at_"
    read = read_texts(df.select(col(place).alias("place"), col(text).cast("string").alias("text"), reference_us.alias("ref")), F.col("text"), p)
    step = F.floor((F.col(p + "wall") - F.col("ref")) / F.lit(float(STEP_US)))
    return (
        read.where(F.col(p + "open") & F.col("ref").isNotNull() & F.col("place").isNotNull())
        .select("place", F.floor(F.col("ref") / F.lit(3600.0 * MICRO)).alias("hour"), F.when(step.between(LOWEST, HIGHEST), step).alias("step"))
        .groupBy("place", "hour", "step")
        .agg(F.count("*").alias("n"))
    )


def _declared_steps(zone: str | None, hours: list[int]) -> list[int | None]:
    """The quarter-hour step of a named zone in each hour; none for an unknown zone."""
    try:
        tz = ZoneInfo(zone) if zone else None
    except (ValueError, OSError, KeyError):
        tz = None
    return [None if tz is None else int(datetime.fromtimestamp(h * 3600, tz).utcoffset().total_seconds() // 900) for h in hours]


def _history(votes: pd.DataFrame, change: int) -> pd.DataFrame:
    """Dynamic program over hours: the offsets with the fewest violated readings; a change of offset counts as `change`."""
    place, zone = votes["place"].iloc[0], votes["zone"].iloc[0]
    hours, at = np.unique(votes["hour"].to_numpy(np.int64), return_inverse=True)
    n, near = votes["n"].to_numpy(np.int64), votes["step"].notna().to_numpy()
    total, grid = np.zeros(len(hours), np.int64), np.zeros((len(hours), HIGHEST - LOWEST + 1), np.int64)
    np.add.at(total, at, n)
    np.add.at(grid, (at[near], votes["step"].to_numpy()[near].astype(np.int64) - LOWEST), n[near])
    declared = _declared_steps(zone, hours.tolist())
    said = [0 if s is None or not LOWEST <= s <= HIGHEST else int(grid[i, s - LOWEST]) for i, s in enumerate(declared)]
    steps: list[int | None] = [None] * len(hours)
    if near.any():
        cost, every = total[0] - grid[0], np.arange(grid.shape[1])
        back = np.empty(grid.shape, np.int16)
        for i in range(1, len(hours)):
            best = int(cost.argmin())
            stay = cost <= cost[best] + change
            back[i] = np.where(stay, every, best)
            cost = np.where(stay, cost, cost[best] + change) + total[i] - grid[i]
        k = int(cost.argmin())
        for i in range(len(hours) - 1, -1, -1):
            steps[i] = k + LOWEST
            k = int(back[i, k]) if i else k
    rows: list[dict] = []
    for i, step in enumerate(steps):
        hits = 0 if step is None else int(grid[i, step - LOWEST])
        if not rows or rows[-1]["offset_minutes"] != (None if step is None else step * 15):
            rows.append({"place": place, "zone": zone, "from_us": int(hours[i]) * 3600 * MICRO, "to_us": 0, "offset_minutes": None if step is None else step * 15, "readings": 0, "violations": 0, "declared_violations": 0})
        r = rows[-1]
        r["to_us"] = (int(hours[i]) + 1) * 3600 * MICRO
        r["readings"] += int(total[i])
        r["violations"] += int(total[i]) - hits
        r["declared_violations"] += int(total[i]) - said[i]
    return pd.DataFrame(rows)


def estimate_offsets(df: DataFrame, place: str, text: str, reference_us: Column, change: int = 3, zones: DataFrame | None = None) -> DataFrame:
    """The offset history of each place: (place, zone, from_us, to_us, offset_minutes, readings, violations, declared_violations).

    A reading violates an offset if, moved by it, it lies before its reference instant or a quarter of an hour or more after.
    Readings that violate every offset count too; a place that has no others comes out as one row without an offset. zones
    (place, zone) are the declared zones, a prior that is put to the same test: declared_violations counts the readings of the span that
    the declared zone violates. Ties go to the lower cost found first; places without zoneless readings have no history. One task sees at
    most hours x 106 counts of a place.
    """
    votes = offset_votes(df, place, text, reference_us)
    if zones is None:
        votes = votes.withColumn("zone", F.lit(None).cast("string"))
    else:
        one = zones.groupBy("place").agg(F.min("zone").alias("zone"))
        votes = votes.join(broadcast_if_small(one, one.count()), "place", "left")
    schema = "place string, zone string, from_us bigint, to_us bigint, offset_minutes int, readings bigint, violations bigint, declared_violations bigint"
    return votes.select("place", "zone", "hour", "step", "n").groupBy("place").applyInPandas(lambda v: _history(v, change), schema)


#: A declared zone is given up for the estimate if it violates more than half of at least so many readings, and the estimate at most a fifth.
TRUSTED = 30


def settled_histories(estimated: DataFrame, zones: DataFrame) -> DataFrame:
    """(place, zone, spans array<struct<from_us, offset_us>>): what zoneless readings of each place are converted by.

    A declared zone that the estimate bears out, or that has too few readings to be judged, is the history, as it knows the exact
    instants of its changes; one that the readings contradict gives way to the estimated spans, and zone is null. Places without a declared
    zone have the estimate alone.
    """
    spans = F.array_sort(F.collect_list(F.when(F.col("offset_minutes").isNotNull(), F.struct("from_us", (F.col("offset_minutes").cast("bigint") * 60 * MICRO).alias("offset_us")))))
    of = estimated.groupBy("place").agg(spans.alias("spans"), F.sum("readings").alias("n"), F.sum("violations").alias("bad"), F.sum("declared_violations").alias("said_bad"))
    joined = zones.groupBy("place").agg(F.min("zone").alias("zone")).join(of, "place", "full_outer")
    refuted = (F.col("n") >= TRUSTED) & (F.col("said_bad") * 2 > F.col("n")) & (F.col("bad") * 5 <= F.col("n"))
    return joined.select("place", F.when(~F.coalesce(refuted, F.lit(False)), F.col("zone")).alias("zone"), "spans")


def convert(df: DataFrame, text: str, place: str, histories: DataFrame, out: str = "utc_us") -> DataFrame:
    """df with `out`, the instant that the column `text` denotes, zoneless texts by the settled history of their place.

    As `normalise`; a place that is null or has no history leaves its zoneless texts without an instant. In estimated spans a reading that occurs
    twice is the earlier instant, and the first span also holds before it begins.
    """
    named = histories.select(F.col("place").alias("__place"), F.col("zone").alias("__zone"), F.col("spans").alias("__spans"))
    joined = df.join(broadcast_if_small(named, named.count()), col(place) == F.col("__place"), "left")
    p = "__at_"
    read = read_texts(joined, col(text).cast("string"), p)
    wall = F.col(p + "wall")
    begun = F.filter("__spans", lambda s: s["from_us"] + s["offset_us"] <= wall)
    span = F.when(F.size(begun) > 0, F.element_at(begun, -1)).otherwise(F.get("__spans", F.lit(0)))
    earlier = F.get(F.filter(begun, lambda s: (s["from_us"] + s["offset_us"] <= wall) & (s["from_us"] < span["from_us"])), F.size(begun) - 2)
    by_span = F.when(earlier.isNotNull() & (wall - earlier["offset_us"] < span["from_us"]), wall - earlier["offset_us"]).otherwise(wall - span["offset_us"])
    opened = F.coalesce(zoned_micros(F.col(p + "text"), wall, F.col("__zone")), F.when(F.col("__zone").isNull(), by_span))
    us = real(F.coalesce(F.col(p + "known"), F.when(F.col(p + "open"), opened)))
    read = _fixed(read, **{p + "out": us})
    return read.select(*(col(c) for c in df.columns if c != out), F.col(p + "out").alias(out))
