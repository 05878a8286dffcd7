"""Queries over entries, entities and their mentions.

Tables: ``ep(group_id, uuid, valid_at, content, ...)``, ``en(group_id, uuid, name, type)``, ``m(group_id, uuid, episode_uuid,
entity_uuid)``. A journal is an island: every join carries ``group_id``. Mentions may be parallel, so counts are of
distinct entries unless they say rows. Ties end in the uuid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch


def point(table: DataFrame, group: str, uuid) -> DataFrame:  # noqa: ANN001
    """One row by key, or none; the filter reaches the scan."""
    return table.where((F.col("group_id") == group) & (F.col("uuid") == uuid)).limit(1)


def pairs(m: DataFrame) -> DataFrame:
    """Distinct (group_id, episode_uuid, entity_uuid)."""
    return m.select("group_id", "episode_uuid", "entity_uuid").where("episode_uuid IS NOT NULL AND entity_uuid IS NOT NULL").distinct()


def neighbors(ep: DataFrame, en: DataFrame, m: DataFrame, sources: DataFrame, self_name: str, exclude: list | None = None, limit: int = 20) -> DataFrame:
    """(group_id, uuid, name, hits, oldest): entities sharing entries with ``sources(group_id, entity_uuid)``, by the number of
    different sources met and then the oldest common entry. The sources, those excluded and the self entity do not come out."""
    base = pairs(m)
    of_source = base.join(sources.select("group_id", "entity_uuid").distinct(), ["group_id", "entity_uuid"], "left_semi").withColumnRenamed("entity_uuid", "source")
    met = of_source.join(base, ["group_id", "episode_uuid"])
    met = met.join(sources.select("group_id", "entity_uuid").distinct(), ["group_id", "entity_uuid"], "left_anti")
    if exclude:
        met = met.where(~F.col("entity_uuid").isin(exclude))
    met = met.join(ep.select("group_id", F.col("uuid").alias("episode_uuid"), "valid_at"), ["group_id", "episode_uuid"])
    ranked = met.groupBy("group_id", F.col("entity_uuid").alias("uuid")).agg(F.countDistinct("source").alias("hits"), F.min("valid_at").alias("oldest"))
    named = ranked.join(en.select("group_id", "uuid", "name"), ["group_id", "uuid"]).where(F.col("name") != self_name)
    return named.orderBy(F.desc("hits"), F.asc("oldest"), "group_id", "uuid").limit(limit)


def cooccurring(ep: DataFrame, en: DataFrame, m: DataFrame, group: str, target, self_name: str, limit: int = 20) -> DataFrame:  # noqa: ANN001
    """(uuid, name, co_count, sample): entities in the same entries as ``target``, with the newest common entry's text."""
    base = pairs(m.where(F.col("group_id") == group))
    here = base.where(F.col("entity_uuid") == target).select("episode_uuid")
    others = base.join(here, "episode_uuid", "left_semi").where(F.col("entity_uuid") != target)
    texts = ep.where(F.col("group_id") == group).select(F.col("uuid").alias("episode_uuid"), "valid_at", "content")
    counted = others.join(texts, "episode_uuid").groupBy(F.col("entity_uuid").alias("uuid")).agg(
        F.count("*").alias("co_count"), F.max_by("content", F.struct("valid_at", "episode_uuid")).alias("sample")
    )
    named = counted.join(en.where(F.col("group_id") == group).select("uuid", "name"), "uuid").where(F.col("name") != self_name)
    return named.select("uuid", "name", "co_count", "sample").orderBy(F.desc("co_count"), "uuid").limit(limit)


def timeline(ep: DataFrame, m: DataFrame, group: str, target) -> DataFrame:  # noqa: ANN001
    """The entries that mention an entity, one row a mention (parallel mentions repeat), newest first."""
    here = m.where((F.col("group_id") == group) & (F.col("entity_uuid") == target)).select("group_id", F.col("episode_uuid").alias("uuid"))
    return ep.join(here, ["group_id", "uuid"]).orderBy(F.desc("valid_at"), F.desc("uuid"))


def headers(ep: DataFrame, en: DataFrame, m: DataFrame) -> DataFrame:
    """(group_id, uuid, name, entry_count, first_mention, last_mention) of all mentioned entities; entry_count counts mention rows."""
    seen = m.select("group_id", "entity_uuid", F.col("episode_uuid").alias("uuid")).join(ep.select("group_id", "uuid", "valid_at"), ["group_id", "uuid"])
    spans = seen.groupBy("group_id", "entity_uuid").agg(F.count("*").alias("entry_count"), F.min("valid_at").alias("first_mention"), F.max("valid_at").alias("last_mention"))
    return en.select("group_id", "uuid", "name").join(spans.withColumnRenamed("entity_uuid", "uuid"), ["group_id", "uuid"])


def mention_counts(m: DataFrame) -> DataFrame:
    """(group_id, uuid, mention_count) over distinct entries."""
    return pairs(m).groupBy("group_id", F.col("entity_uuid").alias("uuid")).agg(F.count("*").alias("mention_count"))


def entry_entities(nodes: DataFrame, m: DataFrame, group: str, episode, self_name: str) -> DataFrame:  # noqa: ANN001
    """(pos, uuid, name, type, mention_count) of an entry's entities with their counts over the journal, 0 where none."""
    own = nodes.where((F.col("group_id") == group) & (F.col("episode_uuid") == episode) & (F.col("name") != self_name))
    counts = mention_counts(m.where(F.col("group_id") == group).join(own.select("group_id", F.col("uuid").alias("entity_uuid")), ["group_id", "entity_uuid"], "left_semi"))
    return own.join(counts, ["group_id", "uuid"], "left").select("pos", "uuid", "name", "type", F.coalesce("mention_count", F.lit(0)).alias("mention_count")).orderBy("pos")


def orphans(en: DataFrame, m: DataFrame) -> DataFrame:
    """Entities without a mention."""
    return en.join(m.select("group_id", F.col("entity_uuid").alias("uuid")).distinct(), ["group_id", "uuid"], "left_anti")


def period_rollup(ep: DataFrame, nodes: DataFrame, start: Column, end: Column, self_name: str) -> DataFrame:
    """(group_id, entry_count, connection_count) over entries with start <= valid_at < end; entries without entities count."""
    inside = ep.where((F.col("valid_at") >= start) & (F.col("valid_at") < end)).select("group_id", F.col("uuid").alias("episode_uuid"))
    links = nodes.where(F.col("name") != self_name).groupBy("group_id", "episode_uuid").agg(F.count("*").alias("n"))
    joined = inside.join(links, ["group_id", "episode_uuid"], "left")
    return joined.groupBy("group_id").agg(F.count("*").alias("entry_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("connection_count"))


def period_names(ep: DataFrame, nodes: DataFrame, start: Column, end: Column, self_name: str, limit: int = 100) -> DataFrame:
    """(group_id, name, frequency, uuid, rank): the most frequent names of a period; uuid is that of the newest entry naming it.

    Ties keep the order of first encounter, newest entry first. The rank is taken over one row a name.
    """
    inside = ep.where((F.col("valid_at") >= start) & (F.col("valid_at") < end)).select("group_id", F.col("uuid").alias("episode_uuid"), "valid_at")
    seen = inside.join(nodes.where(F.col("name") != self_name), ["group_id", "episode_uuid"])
    newest = F.max(F.struct("valid_at", "episode_uuid", (-F.col("pos")).alias("back"), "uuid")).alias("newest")
    per = seen.groupBy("group_id", "name").agg(F.count("*").alias("frequency"), newest)
    order = Window.partitionBy("group_id").orderBy(F.desc("frequency"), F.desc("newest"), "name")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("group_id", "name", "frequency", F.col("newest.uuid").alias("uuid"), "rank")


def recent_as_of(ep: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    """(group_id, probe, uuid, valid_at, rank): the last ``most`` entries at or before each probe time of ``probes(group_id, at)``.

    Entries and probes are one time line: a running list of the last entries is carried along it. To keep a journal
    with a third of all rows off one task, lines are cut by month; each month starts with the last entries of earlier months, which are
    at most ``most`` a month.
    """
    month = lambda c: F.date_trunc("month", c)
    entries = ep.select("group_id", "uuid", "valid_at", month(F.col("valid_at")).alias("month"))
    per_month = Window.partitionBy("group_id", "month").orderBy(F.desc("valid_at"), F.desc("uuid"))
    tails = entries.withColumn("r", F.row_number().over(per_month)).where(F.col("r") <= most)
    lists = tails.groupBy("group_id", "month").agg(F.sort_array(F.collect_list(F.struct("valid_at", "uuid")), asc=False).alias("last"))
    wanted = probes.select("group_id", "at", month(F.col("at")).alias("month")).distinct()
    months = lists.unionByName(wanted.select("group_id", "month").distinct().join(lists.select("group_id", "month"), ["group_id", "month"], "left_anti").withColumn("last", F.array().cast(lists.schema["last"].dataType)))
    # Earlier months: enough of them to hold ``most`` entries. Months without entries take no place in the frame.
    by_month = Window.partitionBy("group_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    numbered = months.withColumn("index", F.coalesce(F.sum((F.size("last") > 0).cast("int")).over(by_month), F.lit(0)))
    before = Window.partitionBy("group_id").orderBy("index").rangeBetween(-most, -1)
    earlier = numbered.withColumn("earlier", F.flatten(F.collect_list("last").over(before)))
    carried = wanted.join(earlier.select("group_id", "month", F.slice(F.sort_array("earlier", asc=False), 1, most).alias("earlier")), ["group_id", "month"]).select("group_id", "at", F.explode("earlier").alias("e"))
    within = wanted.join(entries, ["group_id", "month"]).where(F.col("valid_at") <= F.col("at")).select("group_id", "at", F.struct("valid_at", "uuid").alias("e"))
    rank = Window.partitionBy("group_id", "at").orderBy(F.desc("e"))
    out = carried.unionByName(within).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
    return out.select("group_id", F.col("at").alias("probe"), "e.uuid", "e.valid_at", "rank")


def degrees(m: DataFrame) -> DataFrame:
    """(group_id, uuid, degree) over mention rows."""
    return m.groupBy("group_id", F.col("entity_uuid").alias("uuid")).agg(F.count("*").alias("degree"))


def totals(ep: DataFrame, en: DataFrame) -> DataFrame:
    """One row: entries and entities."""
    return ep.agg(F.count("*").alias("episodes")).crossJoin(en.agg(F.count("*").alias("entities")))  # two scalars


def relations_of(relations: DataFrame, en: DataFrame) -> DataFrame:
    """Relations whose two ends exist in their journal, with the names of both."""
    ends = en.select("group_id", "uuid", "name")
    source = ends.select("group_id", F.col("uuid").alias("source_uuid"), F.col("name").alias("source_name"))
    target = ends.select("group_id", F.col("uuid").alias("target_uuid"), F.col("name").alias("target_name"))
    return relations.join(source, ["group_id", "source_uuid"]).join(target, ["group_id", "target_uuid"])


def path_lengths(edges: DataFrame, start, end) -> DataFrame:  # noqa: ANN001
    """(length, paths): numbers of directed paths of any length from ``start`` to ``end`` over ``edges(id, src, dst)``, no edge used twice.

    One join a step until no path goes on; the edges used travel with the path, so cycles end. Only edges on some way
    from ``start`` to ``end`` are followed, so dead ends cost no paths. Steps are written to the shared folder.
    """
    disk = Scratch(edges.sparkSession, "paths")
    edges = disk.save(_between(edges.select("id", "src", "dst").dropna(), start, end, disk))
    reach = disk.save(edges.where(F.col("src") == start).select(F.col("dst").alias("at"), F.array("id").alias("used")))
    found = reach.where(F.col("at") == end).agg(F.lit(1).alias("length"), F.count("*").alias("paths"))
    length = 1
    while not reach.isEmpty():
        length += 1
        step = reach.join(edges, reach["at"] == edges["src"]).where(~F.array_contains("used", F.col("id")))
        reach = disk.save(step.select(F.col("dst").alias("at"), F.array_append("used", F.col("id")).alias("used")))
        found = found.unionAll(reach.where(F.col("at") == end).agg(F.lit(length).alias("length"), F.count("*").alias("paths")))
    out = disk.save(found.where("paths > 0"), keep=True)
    disk.clean()
    return out


def _between(edges: DataFrame, start, end, disk: Scratch) -> DataFrame:  # noqa: ANN001
    """The ``edges`` that lie on a walk from ``start`` to ``end``: reached forwards from the one and backwards from the other."""
    for spot, near, far in ((start, "src", "dst"), (end, "dst", "src")):
        seen = disk.save(edges.where(F.col(near) == spot).select(F.col(near).alias("v")).distinct())
        fresh = seen
        while not fresh.isEmpty():
            ahead = edges.join(fresh.withColumnRenamed("v", near), near, "left_semi").select(F.col(far).alias("v")).distinct()
            fresh = disk.save(ahead.join(seen, "v", "left_anti"))
            seen = seen.unionAll(fresh)
        edges = edges.join(seen.withColumnRenamed("v", near), near, "left_semi")
    return edges
