"""Relations between entities: building from extracted records, rules by type, merging with existing ones, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import parse_iso, valid_order
from ..functions.text import edge_name, excerpt

# Which relation may join which types; "Entity" stands for any type, symmetric ones hold both ways.
RULES = [
    ("Person", "Person", "Knows", True), ("Person", "Person", "SpendsTimeWith", True), ("Person", "Person", "Supports", False), ("Person", "Person", "ConflictsWith", True),
    ("Person", "Activity", "ParticipatesIn", False), ("Activity", "Place", "OccursAt", False), ("Person", "Place", "Visits", False), ("Entity", "Entity", "RELATES_TO", True),
]


def rules(spark: SparkSession) -> DataFrame:
    """(source_type, target_type, relation); symmetric rules between different types appear in both directions."""
    rows = {(a, b, r) for a, b, r, _ in RULES} | {(b, a, r) for a, b, r, both in RULES if both}
    return spark.createDataFrame(sorted(rows), "source_type string, target_type string, relation string")


def allowed_relations(nodes: DataFrame, rule: DataFrame) -> DataFrame:
    """(group_id, episode_uuid, source_uuid, target_uuid, relation) for ordered pairs of an entry's nodes; any node also counts as Entity."""
    typed = nodes.select("group_id", "episode_uuid", "uuid", F.explode(F.array_distinct(F.array("type", F.lit("Entity")))).alias("t"))
    source = typed.select("group_id", "episode_uuid", F.col("uuid").alias("source_uuid"), F.col("t").alias("source_type")).join(rule, "source_type")
    target = typed.select("group_id", "episode_uuid", F.col("uuid").alias("target_uuid"), F.col("t").alias("target_type"))
    return source.join(target, ["group_id", "episode_uuid", "target_type"]).where("source_uuid <> target_uuid").select("group_id", "episode_uuid", "source_uuid", "target_uuid", "relation").distinct()


def build(records: DataFrame, nodes: DataFrame, rule: DataFrame) -> DataFrame:
    """Relations from ``records(group_id, episode_uuid, source_pos, target_pos, relation, fact, valid_at, invalid_at)``.

    Positions outside the entry drop the record, as do ends that are the same and times in the wrong order. A relation
    that the types do not allow becomes RELATES_TO.
    """
    end = lambda side: nodes.select("group_id", "episode_uuid", F.col("pos").alias(f"{side}_pos"), F.col("uuid").alias(f"{side}_uuid"), F.col("type").alias(f"{side}_type"))
    joined = records.join(end("source"), ["group_id", "episode_uuid", "source_pos"]).join(end("target"), ["group_id", "episode_uuid", "target_pos"])
    joined = joined.where("source_uuid <> target_uuid").withColumn("valid_at", parse_iso(F.col("valid_at"))).withColumn("invalid_at", parse_iso(F.col("invalid_at")))
    joined = joined.where(valid_order(F.col("valid_at"), F.col("invalid_at"))).withColumn("name", edge_name(F.col("relation")))
    permitted = rule.select("source_type", "target_type", edge_name(F.col("relation")).alias("name"), F.lit(True).alias("_ok"))
    checked = joined.join(F.broadcast(permitted), ["source_type", "target_type", "name"], "left")  # the fixed rules
    return checked.select("group_id", "episode_uuid", "source_uuid", "target_uuid", F.when(F.col("_ok"), F.col("name")).otherwise("RELATES_TO").alias("name"), "fact", "valid_at", "invalid_at")


def merge(existing: DataFrame, built: DataFrame) -> DataFrame:
    """One row a (group_id, source_uuid, target_uuid, name): ``status`` merged keeps uuid and fact of the old one, new has none yet; episodes are the sorted union."""
    keys = ["group_id", "source_uuid", "target_uuid", "name"]
    new = built.groupBy(*keys).agg(F.sort_array(F.collect_set("episode_uuid")).alias("_new"), F.min(F.struct("episode_uuid", "fact")).alias("_first"))
    old = existing.groupBy(*keys).agg(F.min_by("uuid", "uuid").alias("uuid"), F.min_by("fact", "uuid").alias("_fact"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("episodes")))).alias("_old"))
    joined = new.join(old, keys, "left")
    status = F.when(F.col("uuid").isNull(), "new").otherwise("merged")
    return joined.select(*keys, "uuid", F.coalesce("_fact", "_first.fact").alias("fact"), F.array_sort(F.array_union(F.coalesce("_old", F.array().cast(new.schema["_new"].dataType)), F.col("_new"))).alias("episodes"), status.alias("status"))


def all_pairs(nodes: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Fallback relations between every two nodes of an entry, earlier position first, with a shortened text as fact.

    The nodes of one entry are few (what one text mentions); the join is on the entry.
    """
    a = nodes.select("group_id", "episode_uuid", F.col("pos").alias("a_pos"), F.col("uuid").alias("source_uuid"))
    b = nodes.select("group_id", "episode_uuid", F.col("pos").alias("b_pos"), F.col("uuid").alias("target_uuid"))
    pairs = a.join(b, ["group_id", "episode_uuid"]).where("a_pos < b_pos").select("group_id", "episode_uuid", "source_uuid", "target_uuid", F.lit("RELATES_TO").alias("name"))
    if entries is None:
        return pairs
    return pairs.join(entries.select("group_id", F.col("uuid").alias("episode_uuid"), excerpt(F.col("content")).alias("fact")), ["group_id", "episode_uuid"])


def with_fallback(built: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Built relations, and all pairs for entries that got none."""
    bare = nodes.join(built.select("group_id", "episode_uuid").distinct(), ["group_id", "episode_uuid"], "left_anti")
    return built.select("group_id", "episode_uuid", "source_uuid", "target_uuid", "name", "fact").unionByName(all_pairs(bare, entries))


def merge_attributes(old: Column, new: Column) -> Column:
    """Attribute maps: new values win, null values leave."""
    empty = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce(old, empty), F.map_filter(F.coalesce(new, empty), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(mine, lambda k, _: ~F.map_contains_key(theirs, k)), theirs)
