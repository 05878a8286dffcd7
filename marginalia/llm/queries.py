"""Queries of the corpus operators: each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Scratch, table
from .components import match_groups
from .cooccur import cooccurrence
from .langid import CONTRADICTION, fit, identify
from .mix import mixture, shares
from .names import link_names, variant_pairs
from .pack import pack_all, sized_table
from .pii import detect, fitted, labelled_sample, person_names, redact
from .split import split_texts
from .tokens import token_count

#: The entity that stands for the author of every journal.
SELF = "11111111-1111-1111-1111-111111111111"

ORACLES: dict[str, str] = {}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, name_a, name_b): two spellings of one person, place or organisation of a journal."""
    return variant_pairs(link_names(table(spark, folder, "extracted_entities")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, uuid, root_uuid) of every uuid linked to another."""
    return match_groups(table(spark, folder, "duplicate_pairs"), table(spark, folder, "extract_results"))


def _mentioned(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mentions").where(F.col("entity_uuid") != SELF)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, uuid_a, uuid_b) in five or more common entries and at least three times as often as by chance."""
    pairs = cooccurrence(_mentioned(spark, folder), "group_id", "episode_uuid", "entity_uuid", min_count=5)
    cases = pairs.where(F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))
    return cases.select("group_id", F.col("item_a").alias("uuid_a"), F.col("item_b").alias("uuid_b"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of entities of a journal with its common entries, lift and log-likelihood ratio."""
    pairs = cooccurrence(_mentioned(spark, folder), "group_id", "episode_uuid", "entity_uuid")
    return pairs.select("group_id", F.col("item_a").alias("uuid_a"), F.col("item_b").alias("uuid_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("llr", 6).alias("llr"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, uuid) of entries that had to be cut."""
    return p5_pieces(spark, folder).where("piece_no > 0").select("group_id", "uuid").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every entry."""
    return split_texts(table(spark, folder, "episodes"), "content", ["group_id", "uuid"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, uuid, kind, start_pos, end_pos) of each passage with personal information."""
    entries = table(spark, folder, "episodes")
    tagger = fitted(spark, *labelled_sample(entries, person_names(table(spark, folder, "extracted_entities")), ["group_id", "uuid"], "content"))
    return detect(entries, ["group_id", "uuid"], "content", tagger).distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with placeholders in place of personal information."""
    entries = table(spark, folder, "episodes").where("content IS NOT NULL").groupBy("group_id", "uuid").agg(F.min("content").alias("content"))
    disk = Scratch(spark, "redacted")
    return redact(entries, ["group_id", "uuid"], "content", disk.save(p6_found(spark, folder), keep=True))


def _sized(spark: SparkSession, folder: str, label: str, *columns: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sized_table(docs.select("doc_id", token_count(F.col("text")).alias("tokens"), *columns), label)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or piece of one larger than a container, with its container of each kind."""
    return pack_all(_sized(spark, folder, "packing"), "doc_id", "tokens", table(spark, folder, "pack_specs"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used of each kind, the least possible number by volume, and how full they are."""
    placed = p7_containers(spark, folder).groupBy("container_kind").agg(F.countDistinct("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    out = placed.join(table(spark, folder, "pack_specs"), "container_kind")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")
    return out.select("container_kind", "capacity_tokens", "containers", least, "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, folder, "mix_targets").orderBy("source").collect()]
    docs = _sized(spark, folder, "mixing", "source", "text")
    return mixture(docs.select(F.col("doc_id").alias("doc"), "tokens", "source", "text"), targets)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with how often it is used."""
    return _mixed(spark, folder).select(F.col("doc").alias("doc_id"), "source", "member_of", "tokens", "rate", "copies")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share each source reached."""
    return shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def _identified(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify(docs, "text", "lang", "doc_id", fit(docs, "text", "lang", "doc_id"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, seg_start, lang): texts whose label is missing or wrong, and the passages of texts in several languages."""
    rows = _identified(spark, folder)
    wrong = F.col("label_code").isNull() | ((F.col("label_code") != F.col("lang")) & (F.col("label_log_odds") > CONTRADICTION))
    return rows.where((F.col("passages") > 1) | wrong).select("doc_id", "seg_start", "lang")


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of every text with its language and confidence."""
    return _identified(spark, folder).drop("label_log_odds")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_pairs": p4_pairs, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_languages": p9_languages}
# One record for each uuid in a group; the smallest uuid reachable over links in either direction.
ORACLES["p3_found"] = """
WITH RECURSIVE canon AS (
  SELECT group_id, node_uuid AS a, canonical_uuid AS b FROM duplicate_pairs
  UNION ALL
  SELECT group_id, e.k AS a, e.v AS b FROM (SELECT group_id, UNNEST(map_entries(uuid_map)) AS x FROM extract_results) t, LATERAL (SELECT x.key AS k, x.value AS v) e
), hex AS (
  SELECT group_id, regexp_replace(lower(trim(a, E' \\t\\n\\r')), '^urn:uuid:|[{}()-]', '', 'g') AS a, regexp_replace(lower(trim(b, E' \\t\\n\\r')), '^urn:uuid:|[{}()-]', '', 'g') AS b FROM canon
), links AS (
  SELECT DISTINCT group_id, a, b FROM hex WHERE regexp_full_match(a, '[0-9a-f]{32}') AND regexp_full_match(b, '[0-9a-f]{32}') AND a <> b
), ways AS (
  SELECT group_id, a, b FROM links UNION SELECT group_id, b, a FROM links
), reach(group_id, a, b) AS (
  SELECT group_id, a, b FROM ways
  UNION
  SELECT r.group_id, r.a, w.b FROM reach r JOIN ways w ON r.group_id = w.group_id AND r.b = w.a
), roots AS (
  SELECT group_id, a, least(a, min(b)) AS r FROM reach GROUP BY group_id, a
)
SELECT group_id,
  concat_ws('-', a[1:8], a[9:12], a[13:16], a[17:20], a[21:32]) AS uuid,
  concat_ws('-', r[1:8], r[9:12], r[13:16], r[17:20], r[21:32]) AS root_uuid
FROM roots
"""

_MENTIONS = """
WITH sets AS (
  SELECT DISTINCT group_id, episode_uuid AS e, entity_uuid AS x FROM mentions
  WHERE group_id IS NOT NULL AND episode_uuid IS NOT NULL AND entity_uuid IS NOT NULL AND entity_uuid <> '11111111-1111-1111-1111-111111111111'
), item AS (SELECT group_id, x, count(*) AS k FROM sets GROUP BY ALL),
total AS (SELECT group_id, count(DISTINCT e) AS n FROM sets GROUP BY ALL),
both_in AS (SELECT a.group_id, a.x AS uuid_a, b.x AS uuid_b, count(*) AS n_ab FROM sets a JOIN sets b ON a.group_id = b.group_id AND a.e = b.e AND a.x < b.x GROUP BY ALL),
full_row AS (
  SELECT p.*, i.k AS n_a, j.k AS n_b, n FROM both_in p JOIN total USING (group_id)
  JOIN item i ON p.group_id = i.group_id AND p.uuid_a = i.x JOIN item j ON p.group_id = j.group_id AND p.uuid_b = j.x
)
"""
ORACLES["p4_found"] = _MENTIONS + "SELECT group_id, uuid_a, uuid_b FROM full_row WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b"
ORACLES["p4_pairs"] = _MENTIONS + """
, parts AS (
  SELECT *, [n_ab, n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab] AS k, [n_a, n - n_a, n_b, n - n_b] AS m FROM full_row
)
SELECT group_id, uuid_a, uuid_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) AS lift,
  round(greatest(0, 2 * (list_sum([CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END FOR v IN k]) + n * ln(n) - list_sum([CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END FOR v IN m]))), 6) AS llr
FROM parts
"""
ORACLES["p5_found"] = "SELECT DISTINCT group_id, uuid FROM episodes WHERE length(content) > 10000"
