"""Mixed timestamp texts to one instant.

Every accepted format is one branch of a single alternation with named groups. The text is rewritten once into its
components (the replacement names every group; branches that did not take part contribute nothing), the calendar
ranges are checked, and the instant is assembled from integer day numbers. Everything is a Column expression: no
Python worker, no shuffle, one regular-expression run per value.

Defined results: null, blank or unreadable text, and text naming no existing date or time, give null. Texts with
offset or zone ignore the zone column; others are local time in it (UTC where it is null or no known zone).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Month names in English, German and French, lower case, accents removed, first letters suffice.
MONTHS = {
    1: ["jan", "january", "januar", "janner", "janvier", "janv"],
    2: ["feb", "february", "februar", "fevrier", "fevr", "fev"],
    3: ["mar", "march", "marz", "maerz", "mrz", "mars"],
    4: ["apr", "april", "avril", "avr"],
    5: ["may", "mai"],
    6: ["jun", "june", "juni", "juin"],
    7: ["jul", "july", "juli", "juillet", "juil"],
    8: ["aug", "august", "aout"],
    9: ["sep", "sept", "september", "septembre"],
    10: ["oct", "october", "okt", "oktober", "octobre"],
    11: ["nov", "november", "novembre"],
    12: ["dec", "december", "dez", "dezember", "decembre"],
}
# Zone abbreviations in their usual meaning, minutes east of UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "MET": 60, "CEST": 120, "MESZ": 120,
    "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570,
    "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180,
}

_FRAC = r"(?:[.,](?<f{i}>\d{{1,12}}))?"
_CLOCK = r"(?<h{i}>\d{{1,2}})[:h](?<n{i}>\d{{2}})(?::(?<s{i}>\d{{2}})" + _FRAC + r")?"
_ZONE = r"(?:\s*(?<z{i}>[Zz]|(?:UTC|GMT)?[+-]\d{{2}}:?\d{{2}}|[+-]\d{{2}}|[A-Z]{{2,4}}))?(?:\s*\[(?<r{i}>[A-Za-z0-9_+/-]+)\])?"
_HALF = r"(?:\s*(?<a{i}>[AaPp]\.?[Mm]\.?))?"
_WORD = r"[\p{{L}}]{{3,10}}"
#: One branch per format family; ``{i}`` numbers the groups. y m d M h n s f z r a e: year, month, day, month name, hour,
#: minute, second, fraction, zone, bracketed region, half of the day, Unix time.
BRANCHES = [
    r"(?<y{i}>\d{{4}})([-/])(?<m{i}>\d{{2}})\2(?<d{i}>\d{{2}})(?:[Tt ]\s*" + _CLOCK + _ZONE + r")?",
    r"(?<y{i}>\d{{4}})(?<m{i}>\d{{2}})(?<d{i}>\d{{2}})[T_](?<h{i}>\d{{2}})(?<n{i}>\d{{2}})(?<s{i}>\d{{2}})" + _FRAC + _ZONE,
    r"(?:" + _WORD + r"\.?,?\s+)?(?<d{i}>\d{{1,2}})\.?\s*(?<M{i}>" + _WORD + r")\.?\s+(?<y{i}>\d{{4}})(?:,?\s+(?:um\s+|at\s+|à\s+)?" + _CLOCK + _HALF + r"(?:\s*Uhr)?" + _ZONE + r")?",
    r"(?<d{i}>\d{{1,2}}),(?<M{i}>" + _WORD + r"),(?<y{i}>\d{{4}})",
    r"(?:" + _WORD + r",\s+)?(?<M{i}>" + _WORD + r")\.?\s+(?<d{i}>\d{{1,2}}),?\s+(?<y{i}>\d{{4}})(?:,?\s+(?:at\s+)?" + _CLOCK + _HALF + _ZONE + r")?",
    r"(?<m{i}>\d{{1,2}})/(?<d{i}>\d{{1,2}})/(?<y{i}>\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?" + _CLOCK + _HALF + _ZONE + r")?",
    r"(?<d{i}>\d{{1,2}})\.(?<m{i}>\d{{1,2}})\.(?<y{i}>\d{{4}}|\d{{2}})(?:,?\s+(?:um\s+)?" + _CLOCK + r"(?:\s*Uhr)?" + _ZONE + r")?",
    r"@?(?<e{i}>\d{{9,19}}(?:\.\d{{1,9}})?)",
]
FIELDS = "y m d M h n s f z r a e".split()
_MARK = "\u0001"


def _pattern_and_replacement() -> tuple[str, str]:
    parts, names = [], {f: [] for f in FIELDS}
    for i, branch in enumerate(BRANCHES):
        text = branch.format(i=i).replace(r"\2", r"\k<p0>").replace("([-/])", "(?<p0>[-/])")
        parts.append(f"(?:{text})")
        for f in FIELDS:
            if f"(?<{f}{i}>" in text:
                names[f].append(f"${{{f}{i}}}")
    return r"(?sU)^\s*(?:" + "|".join(parts) + r")\s*$", _MARK + _MARK.join("".join(names[f]) for f in FIELDS)


PATTERN, REPLACEMENT = _pattern_and_replacement()


def known_zones(spark: SparkSession) -> list[str]:
    """Region ids the JVM knows (about 600, independent of the data), fetched in one call."""
    return spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toString()[1:-1].split(", ")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic on the shifted year."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mp = F.pmod(m + 9, F.lit(12))
    leap_days = F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400)
    return yy * 365 + leap_days + F.floor((mp * 153 + 2) / 5) + d - 1 - 719468


def _int(col: Column) -> Column:
    return F.when(col != "", col.cast("bigint"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` bound once: Catalyst cannot copy a lambda variable into each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_instant(spark: SparkSession, text: Column, time_zone: Column, first_year: int = 2016, last_year: int = 2026) -> Column:
    """Microseconds since 1970-01-01 UTC that ``text`` denotes, or null.

    ``first_year`` and ``last_year`` choose the unit of plain Unix numbers. Finer digits than microseconds are cut off.
    A local time that occurs twice is the first of the two; one that does not occur is read with the offset before
    the change.
    """
    parts = F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(REPLACEMENT)), _MARK)
    zones = known_zones(spark)
    read = lambda x: _instant(x, time_zone, zones, first_year, last_year)
    return _let(parts, lambda p: F.when(F.size(p) == len(FIELDS) + 1, _let(_numbers(p), read)))


def _numbers(parts: Column) -> Column:
    """The components as numbers, with what is left of them for the zone and Unix time."""
    y, m, d, month_name, h, n, s, frac, zone, region, half, epoch = (F.get(parts, F.lit(i + 1)) for i in range(len(FIELDS)))
    names = F.create_map(*[F.lit(x) for k, forms in MONTHS.items() for form in forms for x in (form, k)])
    plain = F.translate(F.lower(month_name), "äáàâéèêëûùüôö", "aaaaeeeeuuuoo")
    hour = F.coalesce(_int(h), F.lit(0))
    return F.struct(
        F.when(F.length(y) == 2, _int(y) + 2000).otherwise(_int(y)).alias("year"),
        F.coalesce(_int(m), F.try_element_at(names, plain).cast("bigint")).alias("month"),
        _int(d).alias("day"),
        F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(F.lower(F.substring(half, 1, 1)) == "p", 12).otherwise(0)).alias("hour"),
        F.coalesce(_int(n), F.lit(0)).alias("minute"),
        F.coalesce(_int(s), F.lit(0)).alias("second"),
        F.when(frac == "", 0).otherwise(F.substring(F.concat(frac, F.lit("000000")), 1, 6).cast("bigint")).alias("micro"),
        F.regexp_replace(zone, F.lit(r"^(?:UTC|GMT)(?=[+-])|:"), F.lit("")).alias("off"),
        region.alias("region"),
        epoch.alias("epoch"),
        F.split_part(epoch, F.lit("."), F.lit(1)).try_cast("bigint").alias("whole"),
        F.split_part(epoch, F.lit("."), F.lit(2)).alias("digits"),
    )


def _instant(x: Column, given: Column, zones: list[str], first_year: int, last_year: int) -> Column:
    year, month, day, number, off = (x[k] for k in ("year", "month", "day", "whole", "off"))
    low, high = (int(datetime(yr, 1, 1, tzinfo=timezone.utc).timestamp()) for yr in (first_year, last_year + 1))
    in_unit = lambda scale: number.between(low * scale, min(high * scale - 1, 2**63 - 1))
    tail = lambda k: F.substring(F.concat(x["digits"], F.lit("0" * k)), 1, k).cast("bigint")
    unix = F.when(in_unit(1), number * 1_000_000 + tail(6)).when(in_unit(1_000), number * 1_000 + tail(3)).when(in_unit(1_000_000), number).when(in_unit(1_000_000_000), F.floor(number.cast("decimal(20,0)") / 1000).cast("bigint"))

    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    month_days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    exists = (year >= 1) & month.between(1, 12) & day.between(1, month_days) & x["hour"].between(0, 23) & x["minute"].between(0, 59) & x["second"].between(0, 59)
    local = ((((days_from_civil(year, month, day) * 24 + x["hour"]) * 60 + x["minute"]) * 60 + x["second"]) * 1_000_000 + x["micro"]).cast("bigint")

    off_minutes = F.substring(off, 2, 2).try_cast("bigint") * 60 + F.when(F.length(off) > 3, F.substring(off, 4, 2).try_cast("bigint")).otherwise(0)
    signed = F.when(F.substring(off, 1, 1) == "-", -off_minutes).otherwise(off_minutes)
    abbreviations = F.create_map(*[F.lit(v) for pair in ZONES.items() for v in pair])
    minutes = F.when(off.rlike(r"^[+-]"), signed).otherwise(F.try_element_at(abbreviations, F.upper(off)).cast("bigint"))
    zone = F.when(x["region"].isin(zones), x["region"]).when(given.isin(zones) | given.rlike(r"^[+-]\d{2}:\d{2}$"), given).otherwise("UTC")
    zoned = _let(local, lambda us: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone)))
    shifted = _let(minutes, lambda mins: F.when(mins.between(-18 * 60, 18 * 60), local - mins * 60_000_000))
    return F.when(x["epoch"] != "", unix).when(exists, F.when(off == "", zoned).otherwise(shifted))


def normalise_columns(df: DataFrame, fields: list[str], keys: list[str], zone: str = "time_zone") -> DataFrame:
    """Long form: one distinct row ``(*keys, field_name, instant_us)`` per readable value of ``fields``.

    Rows imported twice collapse; the only shuffle is that of the final distinct over four narrow columns.
    An empty table gives an empty result; columns of ``df`` beyond those named are not read.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("_text")) for f in fields])
    long = df.select(*keys, F.col(zone).alias("_zone"), F.explode(pairs).alias("_p")).select(*keys, "_zone", "_p.field_name", "_p._text")
    instant = parse_instant(df.sparkSession, F.col("_text"), F.col("_zone")).alias("instant_us")
    out = long.where(F.col("_text").isNotNull()).select(*keys, "field_name", instant)
    return out.where(F.col("instant_us").isNotNull()).distinct()
