"""Date and time functions over timestamps in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def parse_iso(text: Column) -> Column:
    """ISO text to an instant, null where it is none; text without an offset is UTC (the session's zone)."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def entry_title(at: Column) -> Column:
    """Weekday, month and day, such as Tuesday Nov 5, 2024."""
    return F.date_format(at, "EEEE MMM d, yyyy")


def refused_update(text: Column) -> Column:
    """Why a new time for an entry is refused (null when fine): bad text, or no offset."""
    parsed = parse_iso(text)
    return F.when(text.isNull() | parsed.isNull(), "no ISO time").when(~text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), "no time zone")


def week_start(at: Column) -> Column:
    """Monday 00:00 of the week."""
    return F.date_trunc("week", at)


def period_label(at: Column, now: Column) -> Column:
    """This Week (and any later time), Last Week, else month and year."""
    this = week_start(now)
    return F.when(at >= this, "This Week").when(at >= this - F.expr("INTERVAL 7 DAYS"), "Last Week").otherwise(F.date_format(at, "MMMM yyyy"))


def periods(entries: DataFrame, group: str, at: str, key: str, now: Column) -> DataFrame:
    """(group, period, period_start, period_end, entries, first_index) in the order of a listing, newest first.

    Entries without a time are left out. Month bounds are whole months, so they may overlap the weeks; this is how the
    listing works. The counts are aggregated before anything is ranked: one row a period and journal.
    """
    label = period_label(F.col(at), now).alias("period")
    per = entries.where(F.col(at).isNotNull()).groupBy(group, label).agg(F.count("*").alias("entries"), F.max(F.struct(at, key)).alias("_newest"))
    start = F.when(F.col("period") == "This Week", week_start(now)).when(F.col("period") == "Last Week", week_start(now) - F.expr("INTERVAL 7 DAYS")).otherwise(F.date_trunc("month", F.col(f"_newest.{at}")))
    end = F.when(F.col("period").isin("This Week", "Last Week"), F.col("period_start") + F.expr("INTERVAL 7 DAYS")).otherwise(F.add_months("period_start", 1).cast("timestamp"))
    before = Window.partitionBy(group).orderBy(F.desc("_newest")).rowsBetween(Window.unboundedPreceding, -1)
    out = per.withColumn("period_start", start).withColumn("period_end", end).withColumn("first_index", F.coalesce(F.sum("entries").over(before), F.lit(0)))
    return out.select(group, "period", "period_start", "period_end", "entries", "first_index")


def xml_date(text: Column, zone: str) -> Column:
    """Day, month name and year as local midnight in ``zone``, as an instant; null where it is no date."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("d,MMMM,yyyy")), zone)


def dayone_local(text: Column, zone: Column, zones: list[str]) -> Column:
    """struct(instant, zone): the instant, and the zone it is shown in (UTC where the name is none)."""
    return F.struct(parse_iso(text).alias("instant"), F.when(zone.isin(zones), zone).otherwise("UTC").alias("zone"))


def score(at: Column) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(at) / 1e6


def valid_order(valid_at: Column, invalid_at: Column) -> Column:
    """False only where both are given and the end does not lie after the start."""
    return F.coalesce(invalid_at > valid_at, F.lit(True))
