"""From extracted names to linked entities: suppression, cleanup, candidates, similarity, exact match, links, counters.

``names(group_id, episode_uuid, pos, name, entity_type_id)`` are what an extractor gave; the steps are set-based and keep the
order in which they happen to one entry: suppress raw names, clean, drop repeats, resolve by similarity, then by exact name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clean_entity_name, name_uuid, strip, type_name


def suppressed_names(scopes: DataFrame) -> DataFrame:
    """(group_id, episode_uuid or null, name_lc): ``scopes(group_id, episode_uuid, name)`` as a set; a null entry means the whole journal."""
    return scopes.select("group_id", "episode_uuid", F.lower("name").alias("name_lc")).where("name_lc IS NOT NULL").distinct()


def suppress(names: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Names that neither their entry nor their journal suppresses, by lower case of the raw name."""
    marked = names.withColumn("name_lc", F.lower("name"))
    journal = suppressed.where("episode_uuid IS NULL").select("group_id", "name_lc")
    entry = suppressed.where("episode_uuid IS NOT NULL").select("group_id", "episode_uuid", "name_lc")
    left = marked.join(journal, ["group_id", "name_lc"], "left_anti").join(entry, ["group_id", "episode_uuid", "name_lc"], "left_anti")
    return left.drop("name_lc")


def is_suppressed(names: DataFrame, suppressed: DataFrame) -> DataFrame:
    """``names`` with the column ``suppressed``."""
    kept = suppress(names, suppressed).select("group_id", "episode_uuid", "pos").withColumn("_kept", F.lit(True))
    return names.join(kept, ["group_id", "episode_uuid", "pos"], "left").withColumn("suppressed", F.col("_kept").isNull()).drop("_kept")


def clean_batch(names: DataFrame) -> DataFrame:
    """Cleaned names, the first of each (ignoring case) in an entry; names that clean to nothing leave."""
    cleaned = names.withColumn("name", clean_entity_name(F.col("name"))).where("name IS NOT NULL")
    first = Window.partitionBy("group_id", "episode_uuid", F.lower("name")).orderBy("pos")
    return cleaned.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def _bigrams(c: Column) -> Column:
    """Distinct two-letter pieces (the whole of shorter texts): what a substring of a text must have among its own."""
    return F.when(F.length(c) < 2, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))))


def candidates(entities: DataFrame, provisional: DataFrame) -> DataFrame:
    """(group_id, name_lc, uuid): existing entities whose name contains a provisional name, ignoring case; one direction only.

    A substring join by equality: distinct provisional names meet entities on their rarest bigram, which every name
    containing them has; then the containment is checked. Names of one letter meet on that letter.
    """
    wanted = provisional.select("group_id", F.lower(strip(F.col("name"))).alias("name_lc")).where("name_lc <> ''").distinct()
    have = entities.select("group_id", "uuid", F.lower("name").alias("have_lc")).where("have_lc IS NOT NULL")
    pieces = have.select("group_id", "uuid", "have_lc", F.explode(F.array_union(_bigrams(F.col("have_lc")), F.array_distinct(F.split("have_lc", "")))).alias("piece"))
    counts = pieces.groupBy("group_id", "piece").agg(F.count("*").alias("n"))
    keys = wanted.select("group_id", "name_lc", F.explode(_bigrams(F.col("name_lc"))).alias("piece")).join(counts, ["group_id", "piece"])
    whole = wanted.select("group_id", "name_lc", F.size(_bigrams(F.col("name_lc"))).alias("all"))
    rarest = keys.groupBy("group_id", "name_lc").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count("*").alias("found"))
    rarest = rarest.join(whole, ["group_id", "name_lc"]).where("found = all").drop("found", "all")
    return rarest.join(pieces, ["group_id", "piece"]).where(F.contains("have_lc", F.col("name_lc"))).select("group_id", "name_lc", "uuid").distinct()


def exact_matches(entities: DataFrame, provisional: DataFrame) -> DataFrame:
    """(group_id, provisional_uuid, uuid): the oldest entity with the same name ignoring case and outer blanks."""
    key = lambda c: F.lower(strip(F.col(c)))
    first = entities.where("name IS NOT NULL").groupBy("group_id", key("name").alias("k")).agg(F.min_by("uuid", F.struct("created_at", "uuid")).alias("uuid"))
    return provisional.select("group_id", F.col("uuid").alias("provisional_uuid"), key("name").alias("k")).join(first, ["group_id", "k"]).drop("k")


def shingles(c: Column, size: int = 3) -> Column:
    """Distinct character pieces of a squeezed lower-case name (the whole of shorter names)."""
    text = F.lower(F.regexp_replace(c, F.lit(r"(?U)\s+"), F.lit(" ")))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def similar_matches(entities: DataFrame, provisional: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(group_id, provisional_uuid, uuid, similarity): the most similar existing entity at or above ``threshold``.

    Exact set-similarity join by prefix filtering: with pieces in a fixed order, two sets as similar as wanted share one
    of the first ``n - ceil(threshold * n) + 1`` pieces of each, so only prefixes meet. No pair above the threshold is lost,
    unlike with hashed bands. Pieces are ordered rarest first, which keeps hot pieces out of prefixes.
    """
    existing = entities.where("name IS NOT NULL").select("group_id", F.col("uuid"), shingles(F.col("name")).alias("s"))
    wanted = provisional.where("name IS NOT NULL").select("group_id", F.col("uuid").alias("provisional_uuid"), shingles(F.col("name")).alias("p"))
    rare = existing.select("group_id", F.explode("s").alias("piece")).groupBy("group_id", "piece").agg(F.count("*").alias("n"))

    def prefix(rows: DataFrame, key: str, pieces: str) -> DataFrame:
        long = rows.select("group_id", key, F.size(pieces).alias("size"), F.explode(pieces).alias("piece")).join(rare, ["group_id", "piece"], "left")
        listed = long.groupBy("group_id", key, "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))).alias("l"))
        keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
        return listed.select("group_id", key, F.explode(F.slice("l", F.lit(1), keep.cast("int"))).alias("x")).select("group_id", key, F.col("x.piece").alias("piece"))

    met = prefix(wanted, "provisional_uuid", "p").join(prefix(existing, "uuid", "s"), ["group_id", "piece"]).select("group_id", "provisional_uuid", "uuid").distinct()
    scored = met.join(wanted, ["group_id", "provisional_uuid"]).join(existing, ["group_id", "uuid"]).withColumn("similarity", jaccard(F.col("p"), F.col("s")))
    hits = scored.where(F.col("similarity") >= threshold)
    best = hits.groupBy("group_id", "provisional_uuid").agg(F.min(F.struct((-F.col("similarity")).alias("k"), "uuid")).alias("b"))
    return best.select("group_id", "provisional_uuid", "b.uuid", (-F.col("b.k")).alias("similarity"))


def resolve(entities: DataFrame, provisional: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(group_id, provisional_uuid, uuid, how): similarity first, then the exact name, else the name stands for itself."""
    similar = similar_matches(entities, provisional, threshold).select("group_id", "provisional_uuid", F.col("uuid").alias("_s"))
    exact = exact_matches(entities, provisional).select("group_id", "provisional_uuid", F.col("uuid").alias("_e"))
    keys = provisional.select("group_id", F.col("uuid").alias("provisional_uuid"), "name")
    joined = keys.join(similar, ["group_id", "provisional_uuid"], "left").join(exact, ["group_id", "provisional_uuid"], "left")
    how = F.when(F.col("_s").isNotNull(), "similar").when(F.col("_e").isNotNull(), "exact").otherwise("new")
    return joined.select("group_id", "provisional_uuid", F.coalesce("_s", "_e", "provisional_uuid").alias("uuid"), how.alias("how"))


def distinct_nodes(resolved: DataFrame) -> DataFrame:
    """One row an entity and entry, that of the smallest position."""
    first = Window.partitionBy("group_id", "episode_uuid", "uuid").orderBy("pos")
    return resolved.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def remap(edges: DataFrame, mapping: DataFrame, ends: list[str]) -> DataFrame:
    """``edges`` with provisional ids of ``mapping(group_id, provisional_uuid, uuid)`` replaced at each end."""
    for end in ends:
        to = mapping.select("group_id", F.col("provisional_uuid").alias(end), F.col("uuid").alias("_to"))
        edges = edges.join(to, ["group_id", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges


def extract_nodes(entries: DataFrame, entities: DataFrame, suppressed: DataFrame, extractor: Callable[[DataFrame], DataFrame], threshold: float = 0.9, strict_types: bool = False) -> dict[str, DataFrame]:
    """The whole step from entries to links, as lazily evaluated tables.

    ``extractor`` turns ``entries`` into ``names``. Result: nodes(group_id, episode_uuid, pos, uuid, name, type, how), mentions, uuid_map,
    unresolved (to be looked at later), counters (per entry: extracted, resolved, new, exact, fuzzy).
    """
    names = clean_batch(suppress(extractor(entries), suppressed))
    spot = F.concat_ws(":", F.lit("entity"), "group_id", F.col("episode_uuid").cast("string"), F.col("pos").cast("string"))
    own = names.withColumn("provisional_uuid", name_uuid(spot)).withColumn("type", type_name(F.col("entity_type_id"), strict_types))
    mapping = resolve(entities, own.select("group_id", F.col("provisional_uuid").alias("uuid"), "name"), threshold)
    linked = own.join(mapping, ["group_id", "provisional_uuid"])
    nodes = distinct_nodes(linked).select("group_id", "episode_uuid", "pos", "uuid", "name", "type", "how")
    edge = name_uuid(F.concat_ws(":", F.lit("mention"), "group_id", F.col("episode_uuid").cast("string"), "uuid"))
    mentions = nodes.select("group_id", edge.alias("uuid"), "episode_uuid", F.col("uuid").alias("entity_uuid"))
    uuid_map = linked.groupBy("group_id", "episode_uuid").agg(F.map_from_entries(F.collect_list(F.struct("provisional_uuid", "uuid"))).alias("uuid_map"))
    return {"nodes": nodes, "mentions": mentions, "uuid_map": uuid_map, "unresolved": nodes.where("how = 'new'").select("group_id", "episode_uuid", "uuid"), "counters": counters(names, linked, entities)}


def counters(names: DataFrame, linked: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, episode_uuid, extracted, resolved, new_entities, exact_matches, fuzzy_matches): a match counts as exact when the names agree ignoring case."""
    have = entities.select("group_id", "uuid", F.lower(strip(F.col("name"))).alias("_have"))
    joined = linked.join(have, ["group_id", "uuid"], "left")
    same = F.col("_have") == F.lower(strip(F.col("name")))
    return joined.groupBy("group_id", "episode_uuid").agg(
        F.count("*").alias("extracted"), F.countDistinct("uuid").alias("resolved"), F.sum((F.col("how") == "new").cast("int")).alias("new_entities"),
        F.sum(((F.col("how") != "new") & same).cast("int")).alias("exact_matches"), F.sum(((F.col("how") != "new") & ~same).cast("int")).alias("fuzzy_matches"),
    )


def with_self(names: DataFrame, entries: DataFrame, self_uuid: str) -> DataFrame:
    """Names with the author handled: an extracted pronoun becomes the author, who leaves where the text has no pronoun and joins where it has one."""
    from ..functions.text import has_first_person, is_self_name

    speaks = entries.select("group_id", F.col("uuid").alias("episode_uuid"), has_first_person(F.col("content")).alias("_speaks"))
    others = names.where(~is_self_name(F.col("name"))).withColumn("uuid", F.lit(None).cast("string"))
    author = speaks.where("_speaks").select("group_id", "episode_uuid", F.lit(-1).alias("pos"), F.lit("I").alias("name"), F.lit(1).alias("entity_type_id"), F.lit(self_uuid).alias("uuid"))
    return others.unionByName(author, allowMissingColumns=True)
