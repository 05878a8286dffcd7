"""Listings of entries: pages, neighbours in the listing, separators, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import preview

def _order() -> list:
    return [F.desc("valid_at"), F.desc("uuid")]


def page(ep: DataFrame, group: str, limit: int = 100, offset: int = 0, chars: int = 240) -> DataFrame:
    """(uuid, name, valid_at, preview) of one page, newest first. Only the head of a text is read into the preview."""
    rows = ep.where(F.col("group_id") == group).orderBy(*_order()).offset(offset).limit(limit)
    return rows.select("uuid", "name", "valid_at", preview(F.substring("content", 1, chars)).alias("preview"))


def has_more(ep: DataFrame, group: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """One row (has_more): whether a page is followed by another; one row more than the page is asked for, nothing is counted."""
    rows = ep.where(F.col("group_id") == group).orderBy(*_order()).offset(offset).limit(limit + 1)
    return rows.agg((F.count("*") > limit).alias("has_more"))


def neighbours(ep: DataFrame) -> DataFrame:
    """(group_id, uuid, newer_uuid, older_uuid, new_date): the entries before and after each in the listing, and whether its date differs from the newer one's.

    Windows run by journal and month; the ends of months meet in a second, short pass, so a large journal is spread over its months.
    """
    rows = ep.where("valid_at IS NOT NULL").select("group_id", "uuid", "valid_at", F.date_trunc("month", "valid_at").alias("month"))
    w = Window.partitionBy("group_id", "month").orderBy(*_order())
    inner = rows.withColumn("newer", F.lag(F.struct("valid_at", "uuid")).over(w)).withColumn("older", F.lead(F.struct("valid_at", "uuid")).over(w))
    ends = rows.groupBy("group_id", "month").agg(F.max(F.struct("valid_at", "uuid")).alias("top"), F.min(F.struct("valid_at", "uuid")).alias("bottom"))
    by_month = Window.partitionBy("group_id").orderBy(F.desc("month"))
    ends = ends.select("group_id", "month", F.lag("bottom").over(by_month).alias("above"), F.lead("top").over(by_month).alias("below"))
    out = inner.join(ends, ["group_id", "month"])
    newer, older = F.coalesce("newer", "above"), F.coalesce("older", "below")
    return out.select("group_id", "uuid", newer["uuid"].alias("newer_uuid"), older["uuid"].alias("older_uuid"), (~F.to_date("valid_at").eqNullSafe(F.to_date(newer["valid_at"]))).alias("new_date"))


def positions(ep: DataFrame) -> DataFrame:
    """(group_id, uuid, position): 0-based places in the listing, ranked by month with the sizes of newer months added."""
    rows = ep.where("valid_at IS NOT NULL").select("group_id", "uuid", "valid_at", F.date_trunc("month", "valid_at").alias("month"))
    sizes = rows.groupBy("group_id", "month").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group_id").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("group_id", "month", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inner = rows.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "month").orderBy(*_order())) - 1)
    return inner.join(offsets, ["group_id", "month"]).select("group_id", "uuid", (F.col("r") + F.col("skip")).alias("position"))
