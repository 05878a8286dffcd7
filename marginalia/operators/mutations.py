"""Changes as new tables: each function takes the tables before and returns the tables after.

Nothing is edited in place; ``sources.snapshot`` writes the result as a new version and moves the pointer last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the key of the self entity in every journal.
SELF_UUID = "11111111-1111-1111-1111-111111111111"


@dataclass(frozen=True)
class Graph:
    """Entries, entities and mentions of any number of journals."""

    episodes: DataFrame
    entities: DataFrame
    mentions: DataFrame


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows, and the ``old`` rows whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_edges(graph: Graph, new: DataFrame) -> DataFrame:
    """Mentions after an upsert; edges without both ends are dropped."""
    ends = new.join(graph.episodes.select("group_id", F.col("uuid").alias("episode_uuid")), ["group_id", "episode_uuid"], "left_semi")
    ends = ends.join(graph.entities.select("group_id", F.col("uuid").alias("entity_uuid")), ["group_id", "entity_uuid"], "left_semi")
    return upsert(graph.mentions, ends.select(*graph.mentions.columns), ["group_id", "uuid"])


def ensure_self(have: DataFrame, groups: DataFrame, now: Column) -> DataFrame:
    """One self entity a journal: existing summary, attributes and time stay, missing ones are filled in."""
    kept = have.where(F.col("uuid") == SELF_UUID).select("group_id", *[F.col(c).alias(f"_{c}") for c in ("summary", "attributes", "created_at")])
    rows = groups.select("group_id").distinct().join(kept, "group_id", "left")
    return rows.select(
        "group_id", F.lit(SELF_UUID).alias("uuid"), F.lit("I").alias("name"), F.array(F.lit("Entity"), F.lit("Person")).alias("labels"),
        F.nullif("_summary", F.lit("")).alias("summary"), F.coalesce("_attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.coalesce("_created_at", now).alias("created_at"),
    )


def update(episodes: DataFrame, patch: DataFrame) -> DataFrame:
    """Entries with the non-null fields of ``patch(group_id, uuid, content, name, valid_at)`` and ``content_changed``.

    A patch for an entry that does not exist changes nothing (``missing`` lists them).
    """
    p = patch.select("group_id", "uuid", *[F.col(c).alias(f"_{c}") for c in ("content", "name", "valid_at")])
    joined = episodes.join(p, ["group_id", "uuid"], "left")
    changed = F.coalesce(F.col("_content").isNotNull() & ~F.col("_content").eqNullSafe(F.col("content")), F.lit(False))
    fields = [F.coalesce(f"_{c}", c).alias(c) if c in ("content", "name", "valid_at") else F.col(c) for c in episodes.columns]
    return joined.select(*fields, changed.alias("content_changed"))


def missing(episodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys without an entry."""
    return keys.join(episodes.select("group_id", "uuid"), ["group_id", "uuid"], "left_anti")


def _prune(graph: Graph, mentions: DataFrame, touched: DataFrame) -> DataFrame:
    """Entities without those of ``touched(group_id, uuid)`` that no mention is left for."""
    left = mentions.select("group_id", F.col("entity_uuid").alias("uuid")).distinct()
    return graph.entities.join(touched.distinct().join(left, ["group_id", "uuid"], "left_anti"), ["group_id", "uuid"], "left_anti")


def delete_episodes(graph: Graph, keys: DataFrame) -> Graph:
    """Entries of ``keys(group_id, uuid)`` leave with their mentions, and entities they alone mentioned."""
    gone = keys.select("group_id", F.col("uuid").alias("episode_uuid")).distinct()
    touched = graph.mentions.join(gone, ["group_id", "episode_uuid"], "left_semi").select("group_id", F.col("entity_uuid").alias("uuid"))
    mentions = graph.mentions.join(gone, ["group_id", "episode_uuid"], "left_anti")
    return Graph(graph.episodes.join(keys, ["group_id", "uuid"], "left_anti"), _prune(graph, mentions, touched), mentions)


def doomed(graph: Graph, keys: DataFrame) -> DataFrame:
    """(group_id, uuid, edges): entities that would leave with the entries, and their mention rows."""
    gone = keys.select("group_id", F.col("uuid").alias("episode_uuid"), F.lit(1).alias("_gone"))
    per = graph.mentions.join(gone, ["group_id", "episode_uuid"], "left").groupBy("group_id", F.col("entity_uuid").alias("uuid"))
    return per.agg(F.count("*").alias("edges"), F.sum("_gone").alias("_n")).where("edges = _n").drop("_n")


def delete_mentions(graph: Graph, keys: DataFrame) -> Graph:
    """Mentions of ``keys(group_id, episode_uuid, entity_uuid)`` leave; the entity leaves if it has none then, also when no edge was there."""
    mentions = graph.mentions.join(keys, ["group_id", "episode_uuid", "entity_uuid"], "left_anti")
    return Graph(graph.episodes, _prune(graph, mentions, keys.select("group_id", F.col("entity_uuid").alias("uuid"))), mentions)


def deleted_entities(graph: Graph, keys: DataFrame) -> DataFrame:
    """(group_id, uuid, name, deleted_edges) of entities that leave with all their mentions."""
    edges = graph.mentions.groupBy("group_id", F.col("entity_uuid").alias("uuid")).agg(F.count("*").alias("n"))
    return graph.entities.join(keys, ["group_id", "uuid"], "left_semi").join(edges, ["group_id", "uuid"], "left").select("group_id", "uuid", "name", F.coalesce("n", F.lit(0)).alias("deleted_edges"))


def delete_entities(graph: Graph, keys: DataFrame) -> Graph:
    """Entities leave with all their mentions."""
    gone = keys.select("group_id", F.col("uuid").alias("entity_uuid"))
    return Graph(graph.episodes, graph.entities.join(keys, ["group_id", "uuid"], "left_anti"), graph.mentions.join(gone, ["group_id", "entity_uuid"], "left_anti"))


def relink(mentions: DataFrame, episodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Mentions after re-extraction: listed old edges go, new ones come; entries deleted meanwhile get none. Entities are not pruned."""
    kept = mentions.join(old_edges.select("group_id", "uuid"), ["group_id", "uuid"], "left_anti")
    alive = new_edges.join(episodes.select("group_id", F.col("uuid").alias("episode_uuid")), ["group_id", "episode_uuid"], "left_semi")
    return upsert(kept, alive, ["group_id", "uuid"])


def cached_nodes_without(nodes: DataFrame, keys: DataFrame, self_name: str = "I") -> tuple[DataFrame, DataFrame]:
    """(nodes left, (group_id, episode_uuid) of touched entries where nothing but the self entity is left, which are done)."""
    left = nodes.join(keys.select("group_id", "episode_uuid", F.col("entity_uuid").alias("uuid")), ["group_id", "episode_uuid", "uuid"], "left_anti")
    others = left.where(F.col("name") != self_name).select("group_id", "episode_uuid").distinct()
    return left, keys.select("group_id", "episode_uuid").distinct().join(others, ["group_id", "episode_uuid"], "left_anti")
