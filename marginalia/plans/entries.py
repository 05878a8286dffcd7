"""Queries over the journal tables: names, resolution, edges, state, metrics, text functions, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as fx
from ..operators import edges as edge_ops, metrics, resolve, state
from ..session import table
from ..sources.importing import load_entries, posts_of
from . import star
from .star import VIEWS


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted names without repeated rows; the smallest type of a place in an entry."""
    x = table(spark, folder, "extracted_entities").where("episode_uuid IS NOT NULL AND name IS NOT NULL")
    return x.groupBy("group_id", "episode_uuid", "pos", "name").agg(F.min("entity_type_id").alias("entity_type_id"))


def _suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """Every activity is suppressed in its journal, lower-case names in their entry."""
    n = _names(spark, folder)
    journal = n.where("entity_type_id = 4").select("group_id", F.lit(None).cast("string").alias("episode_uuid"), "name")
    return resolve.suppressed_names(journal.unionAll(n.where("name = lower(name)").select("group_id", "episode_uuid", "name")))


def suppress_filter(spark, folder):  # noqa: ANN001, ANN201
    """U01, U02, Q16, Q17, M05"""
    return resolve.suppress(_names(spark, folder), _suppressed(spark, folder)).select("group_id", "episode_uuid", "pos", "name")


def suppressed_flags(spark, folder):  # noqa: ANN001, ANN201
    """places of names a journal; the flags themselves are in suppressed_names"""
    return resolve.is_suppressed(_names(spark, folder).dropDuplicates(["group_id", "episode_uuid", "pos"]).withColumn("name", F.col("name")), _suppressed(spark, folder)).groupBy("group_id").agg(F.count("*").alias("n"))


def suppressed_names(spark, folder):  # noqa: ANN001, ANN201
    """Q17: whether the name of each place in an entry is suppressed"""
    n = _names(spark, folder).groupBy("group_id", "episode_uuid", "pos").agg(F.min("name").alias("name"))
    return resolve.is_suppressed(n, _suppressed(spark, folder)).select("group_id", "episode_uuid", "pos", "name", "suppressed")


def name_cleanup(spark, folder):  # noqa: ANN001, ANN201
    """T13"""
    return _names(spark, folder).select("name").distinct().select("name", fx.clean_entity_name(F.col("name")).alias("cleaned"))


def batch_dedupe(spark, folder):  # noqa: ANN001, ANN201
    """T14, W01"""
    n = _names(spark, folder).groupBy("group_id", "episode_uuid", "pos").agg(F.min("name").alias("name"))
    return resolve.clean_batch(n).select("group_id", "episode_uuid", "pos", "name")


def _provisional(spark: SparkSession, folder: str) -> DataFrame:
    n = _names(spark, folder).select("group_id", "name").distinct()
    return n.select("group_id", F.concat_ws(":", "group_id", "name").alias("uuid"), "name")


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entities").where("name IS NOT NULL AND uuid IS NOT NULL")
    return e.groupBy("group_id", "uuid").agg(F.min("name").alias("name"), F.min("created_at").alias("created_at"))


def candidate_contains(spark, folder):  # noqa: ANN001, ANN201
    """Q07, T25"""
    return resolve.candidates(_entities(spark, folder), _provisional(spark, folder))


def exact_resolve(spark, folder):  # noqa: ANN001, ANN201
    """J09"""
    return resolve.exact_matches(_entities(spark, folder), _provisional(spark, folder))


def similar_resolve(spark, folder):  # noqa: ANN001, ANN201
    """J10 at the documented similarity of 0.9, exact"""
    return resolve.similar_matches(_entities(spark, folder), _provisional(spark, folder)).withColumn("similarity", F.round("similarity", 6))


def resolved_names(spark, folder):  # noqa: ANN001, ANN201
    """J10, J09, M09"""
    return resolve.resolve(_entities(spark, folder), _provisional(spark, folder)).groupBy("group_id", "how").agg(F.count("*").alias("n"))


def extract_pipeline_counters(spark, folder):  # noqa: ANN001, ANN201
    """M07, A10, U06, M06, J11 with the stored extraction in the extractor's place"""
    parts = resolve.extract_nodes(table(spark, folder, "episodes").select("group_id", "uuid").distinct(), _entities(spark, folder), _suppressed(spark, folder), lambda _: _names(spark, folder).groupBy("group_id", "episode_uuid", "pos").agg(F.min("name").alias("name"), F.min("entity_type_id").alias("entity_type_id")))
    return parts["counters"]


def pointer_remap(spark, folder):  # noqa: ANN001, ANN201
    """Ids of duplicate pairs over the maps of the same journal"""
    maps = table(spark, folder, "extract_results").select("group_id", F.explode("uuid_map").alias("provisional_uuid", "uuid")).groupBy("group_id", "provisional_uuid").agg(F.min("uuid").alias("uuid"))
    pairs = table(spark, folder, "duplicate_pairs").select("group_id", "node_uuid", "canonical_uuid").where("node_uuid IS NOT NULL AND canonical_uuid IS NOT NULL")
    return resolve.remap(pairs, maps, ["node_uuid", "canonical_uuid"])


def _typed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(t) for t in ("Person", "Place", "Activity", "Group")]), (F.col("uuid") % 4 + 1).cast("int"))
    return star.nodes(spark, folder).withColumn("type", kinds)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    m = star.mentions(spark, folder)
    relation = F.element_at(F.array(*[F.lit(t) for t in ("knows", "spends time with", " visits ", "supports", "SpendsTimeWith")]), (F.col("uuid") % 5 + 1).cast("int"))
    end = F.when(F.col("uuid") % 3 == 0, F.lit("2020-01-01T00:00:00Z")).when(F.col("uuid") % 3 == 1, F.lit("bad"))
    return m.select("group_id", "episode_uuid", F.col("pos").alias("source_pos"), (F.col("pos") + 1).alias("target_pos"), relation.alias("relation"), F.concat(F.lit("fact "), "uuid").alias("fact"), F.when(F.col("uuid") % 2 == 0, F.lit("2020-06-01T00:00:00+02:00")).otherwise("").alias("valid_at"), end.alias("invalid_at"))


def edge_build(spark, folder):  # noqa: ANN001, ANN201
    """M28, J12, J15, D11, D12, T18"""
    built = edge_ops.build(_records(spark, folder), _typed_nodes(spark, folder), edge_ops.rules(spark))
    return built.select("group_id", "episode_uuid", "source_uuid", "target_uuid", "name", "fact")


def edge_merge(spark, folder):  # noqa: ANN001, ANN201
    """J13, U04, A11, P20"""
    built = edge_ops.build(_records(spark, folder), _typed_nodes(spark, folder), edge_ops.rules(spark))
    old = built.where("episode_uuid % 2 = 0").select("group_id", "source_uuid", "target_uuid", "name", F.concat(F.lit("old"), "episode_uuid").alias("uuid"), F.lit("known").alias("fact"), F.array(F.col("episode_uuid") + 1, F.lit(3).cast("bigint")).alias("episodes"))
    return edge_ops.merge(old, built)


def edge_rules(spark, folder):  # noqa: ANN001, ANN201
    """J15"""
    allowed = edge_ops.allowed_relations(_typed_nodes(spark, folder), edge_ops.rules(spark))
    return allowed.groupBy("group_id", "relation").agg(F.count("*").alias("n"))


def all_pairs_edges(spark, folder):  # noqa: ANN001, ANN201
    """J14, M29"""
    return edge_ops.all_pairs(_typed_nodes(spark, folder))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.create_map(*[F.lit(x) for x in ("error", "fail", "purchase", "ok", "signup", "enqueue")])
    event = F.try_element_at(kind, F.col("event_type"))
    return e.select(F.lit("app").alias("group_id"), F.col("user_id").cast("string").alias("episode_uuid"), "ts", F.col("event_id").alias("seq"), event.alias("event")).where("event IS NOT NULL")


def retry_dead(spark, folder):  # noqa: ANN001, ANN201
    """M12, M13, M14, Q12, Q13, Q18"""
    return state.replay(_events(spark, folder))


def status_counts(spark, folder):  # noqa: ANN001, ANN201
    """Q15, Q18, Q19"""
    return state.by_status(state.replay(_events(spark, folder)))


def pending_queue(spark, folder):  # noqa: ANN001, ANN201
    """Open orders as waiting entries, newest first"""
    o = table(spark, folder, "orders")
    waiting = o.where("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("group_id"), F.col("o_orderkey").alias("episode_uuid"), F.lit("pending_nodes").alias("status"))
    return state.pending(waiting, star.episodes(spark, folder), 200)


def queue_pop(spark, folder):  # noqa: ANN001, ANN201
    """L07, M10, Q20"""
    q = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("group_id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("entity_uuid"))
    return state.pop(q, 25)[0]


def task_queue(spark, folder):  # noqa: ANN001, ANN201
    """L10, M18"""
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("group_id"), F.col("o_custkey").alias("episode_uuid"), (F.col("o_orderkey") % 2).alias("priority"), F.col("o_orderkey").alias("seq"))
    return state.task_order(o)


def orphan_state(spark, folder):  # noqa: ANN001, ANN201
    """Extraction results without an entry"""
    r = table(spark, folder, "extract_results").select("group_id", "episode_uuid").where("episode_uuid IS NOT NULL").distinct()
    some = table(spark, folder, "episodes").where("source = 'text'").select("group_id", "uuid").distinct()
    return state.without_entries(r, some)


def display_states(spark, folder):  # noqa: ANN001, ANN201
    """M23"""
    e = table(spark, folder, "events").select("event_id", F.element_at(F.array(*[F.lit(s) for s in ("idle", "loading", "inferring", "unloading")]), (F.col("event_id") % 4 + 1).cast("int")).alias("s"), (F.col("event_id") % 3).alias("n"))
    return e.select("event_id", state.display(F.col("s"), F.col("n"), F.lit(None)).alias("d")).select("event_id", "d.busy", "d.waiting", "d.poll_seconds")


def panel_states(spark, folder):  # noqa: ANN001, ANN201
    """Each user's events as those of a screen"""
    e, of = table(spark, folder, "events"), lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))
    n = F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("key"), n.alias("seq"), of(state.PANEL_EVENTS, F.xxhash64(n)).alias("event"), of(["pending_nodes", "pending_edges", "done", None], F.floor(n / 10)).alias("status"),
        of([True, None, False], F.floor(n / 40)).alias("enabled"), of([True, False, None], F.floor(n / 120)).alias("present"),
    )
    return state.panel_states(rows)


def fact_quality(spark, folder):  # noqa: ANN001, ANN201
    """Facts made round the extracted names by place in the entry"""
    n = _names(spark, folder)
    facts = F.array(*[F.lit(x) for x in ("I met {}", "the narrator knows {}", "{} lives here, indicating a move", " ", "we saw {} and gave my book back", "Suggesting that {} left")])
    fact = F.replace(F.get(facts, F.pmod("pos", F.lit(6)).cast("int")), F.lit("{}"), F.col("name"))
    target = F.when(F.pmod("pos", F.lit(2)) == 0, "I").otherwise("Anna")
    return n.select("group_id", "episode_uuid", "pos", "name", F.array_join(metrics.fact_issues(fact, F.col("name"), target, F.pmod("pos", F.lit(5)) > 0), ",").alias("issues"))


def entity_f1(spark, folder):  # noqa: ANN001, ANN201
    """A fixture for the metric alone: extracted names against themselves without the first place; says nothing about linking"""
    gold = _names(spark, folder).select("episode_uuid", metrics.entity_key(F.col("name"), F.coalesce("entity_type_id", F.lit(-1))).alias("item"))
    have = _names(spark, folder).where("pos > 0").select("episode_uuid", metrics.entity_key(fx.strip(F.col("name")), F.coalesce("entity_type_id", F.lit(-1))).alias("item"))
    s = metrics.set_scores(gold, have, "episode_uuid", "item")
    return s.select("episode_uuid", "correct", "missing", "extra", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def relation_f1(spark, folder):  # noqa: ANN001, ANN201
    """A fixture for the metric alone: mentions against themselves without place 2"""
    m = star.mentions(spark, folder)
    item = metrics.relation_key(F.col("entity_uuid").cast("string"), F.col("pos").cast("string"), F.lit("knows"))
    s = metrics.set_scores(m.select("episode_uuid", item.alias("item")), m.where("pos <> 2").select("episode_uuid", item.alias("item")), "episode_uuid", "item")
    return metrics.mean_score(s, "f1").select(F.round("mean_score", 6).alias("mean_score"), "n")


def attribute_match(spark, folder):  # noqa: ANN001, ANN201
    """X03"""
    o = table(spark, folder, "orders")
    want = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    got = F.create_map(F.lit("status"), F.concat(F.lit(" "), F.lower("o_orderstatus")), F.lit("priority"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", metrics.attribute_match(want, got).alias("score"))


def document_texts(spark, folder):  # noqa: ANN001, ANN201
    """T05, T11"""
    d = table(spark, folder, "documents")
    return d.select("doc_id", fx.token_estimate(F.col("text")).alias("estimate"), fx.search_text(F.col("text")).alias("search"))


def fulltext_query(spark, folder):  # noqa: ANN001, ANN201
    """T12"""
    p = table(spark, folder, "part")
    return p.select("p_partkey", fx.search_query(F.concat(F.lit("the "), "p_name", F.lit(", and "), "p_brand")).alias("query"))


def token_search(spark, folder):  # noqa: ANN001, ANN201
    """BM25 over entity names (an extension)"""
    from ..operators.search import bm25

    p = table(spark, folder, "part").select(F.col("p_partkey").alias("uuid"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return bm25(p, "uuid", "text", ["red", "plate", "economy"], 50).withColumn("score", F.round("score", 6))


def cosine_topk(spark, folder):  # noqa: ANN001, ANN201
    """nearest vectors to each one whose id is divisible by 50, among all (an extension)"""
    from ..operators.search import cosine_top

    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return cosine_top(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 5))


def uuid5_ids(spark, folder):  # noqa: ANN001, ANN201
    """T21"""
    return table(spark, folder, "part").select("p_partkey", fx.name_uuid(F.concat(F.lit("files:"), F.col("p_partkey").cast("string"))).alias("uuid"))


def dayone_clean(spark, folder):  # noqa: ANN001, ANN201
    """T19, T20"""
    raw = F.concat(F.lit(r"Note\! ![](dayone-moment://ABC) "), "o_orderpriority", F.lit(r" \#"), "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", fx.unescape_dayone(raw).alias("text"), fx.hyphenate_uuid(F.md5(F.col("o_orderkey").cast("string"))).alias("uuid"))


def xml_posts(spark, folder):  # noqa: ANN001, ANN201
    """Orders of a customer as a blog, one date for every two posts"""
    o = table(spark, folder, "orders")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<date>"), F.date_format("o_orderdate", "dd,MMMM,yyyy"), F.lit("</date>"))).otherwise("")
    post = F.concat(F.lit("<post> order "), "o_orderkey", F.lit(" & "), "o_orderstatus", F.lit(" </post>"))
    one = o.select("o_custkey", "o_orderkey", F.concat(date, post).alias("x"))
    docs = one.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "x"))), lambda s: s["x"]), "").alias("value"))
    return posts_of(docs.select(F.concat(F.lit("/blog/"), "o_custkey").alias("path"), "value")).select("path", "content", "entry_time")


def import_idempotent(spark, folder):  # noqa: ANN001, ANN201
    """S11, S12, S13, P21"""
    o = table(spark, folder, "orders")
    have = o.where("o_orderkey % 3 = 0").select(F.lit("j").alias("group_id"), F.col("o_orderkey").alias("uuid"), F.lit("n").alias("name"), F.lit("c").alias("content"), F.col("o_orderdate").cast("timestamp").alias("valid_at"))
    new = o.select(F.when(F.col("o_orderkey") % 10 == 1, F.lit("  ")).otherwise(F.col("o_orderstatus")).alias("content"), F.col("o_orderdate").cast("timestamp").alias("entry_time"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("uuid"))
    return load_entries(have, new, "j")[1]


QUERIES = {f.__name__: f for f in (
    suppress_filter, suppressed_flags, suppressed_names, name_cleanup, batch_dedupe, candidate_contains, exact_resolve, similar_resolve, resolved_names, extract_pipeline_counters, pointer_remap, edge_build, edge_merge, edge_rules,
    all_pairs_edges, retry_dead, status_counts, pending_queue, queue_pop, task_queue, orphan_state, display_states, panel_states, fact_quality, entity_f1, relation_f1, attribute_match, document_texts, fulltext_query, token_search,
    cosine_topk, uuid5_ids, dayone_clean, xml_posts, import_idempotent,
)}

_NAMES = """WITH names AS (SELECT group_id, episode_uuid, pos, name, min(entity_type_id) AS entity_type_id FROM extracted_entities WHERE episode_uuid IS NOT NULL AND name IS NOT NULL GROUP BY ALL),
sup AS (SELECT group_id, NULL AS episode_uuid, lower(name) AS name_lc FROM names WHERE entity_type_id = 4 UNION SELECT group_id, episode_uuid, lower(name) FROM names WHERE name = lower(name)),
kept AS (SELECT n.* FROM names n WHERE NOT EXISTS (SELECT 1 FROM sup s WHERE s.group_id = n.group_id AND s.name_lc = lower(n.name) AND (s.episode_uuid IS NULL OR s.episode_uuid = n.episode_uuid))),
prov AS (SELECT DISTINCT group_id, group_id || ':' || name AS uuid, name FROM names),
ent AS (SELECT group_id, uuid, min(name) AS name, min(created_at) AS created_at FROM entities WHERE name IS NOT NULL AND uuid IS NOT NULL GROUP BY ALL)
"""
_W = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8239) || chr(8199) || chr(12288) || chr(8203)"
_STRIP = "regexp_replace(%s, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')"
_CLEAN_ROOM = r"(?i)^(?:(?:living|bed|bath|dining|laundry)[\s\x{A0}]*room|room|balcony|patio|porch|deck|basement|garage|attic)$"
_BARE = _STRIP % ("regexp_replace(" + _STRIP % "name" + ", '^the[\\s\\x{A0}]+', '')")
_CLEANED = f"CASE WHEN NOT regexp_matches({_STRIP % 'name'}, '{_CLEAN_ROOM}') AND NOT regexp_matches({_BARE}, '{_CLEAN_ROOM}') AND length({_BARE}) >= 2 THEN {_BARE} END"
_EVENTS = """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS episode_uuid, ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'enqueue' END AS event FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY episode_uuid ORDER BY ts, seq) AS i FROM ev),
reset AS (SELECT *, coalesce(max(CASE WHEN event <> 'fail' THEN i END) OVER (PARTITION BY episode_uuid), 0) AS r FROM numbered),
per AS (SELECT episode_uuid, count(*) FILTER (event = 'fail' AND i > r) AS fails, max(CASE WHEN i = r THEN event END) AS last FROM reset GROUP BY ALL),
st AS (SELECT 'app' AS group_id, episode_uuid, CASE WHEN fails >= 3 THEN 'dead' WHEN fails > 0 THEN 'pending_nodes' WHEN last = 'ok' THEN 'done' ELSE 'pending_nodes' END AS status, least(fails, 3) AS retry_count FROM per)
"""
_NODES4 = VIEWS + """, tn AS (SELECT group_id, episode_uuid, pos, uuid, name, ['Person', 'Place', 'Activity', 'Group'][CAST(uuid % 4 + 1 AS INT)] AS type FROM nodes),
rule(a, b, r) AS (VALUES ('Person', 'Person', 'KNOWS'), ('Person', 'Person', 'SPENDSTIMEWITH'), ('Person', 'Person', 'SUPPORTS'), ('Person', 'Person', 'CONFLICTSWITH'), ('Person', 'Activity', 'PARTICIPATESIN'),
  ('Activity', 'Place', 'OCCURSAT'), ('Person', 'Place', 'VISITS'), ('Entity', 'Entity', 'RELATES_TO')),
rec AS (SELECT group_id, episode_uuid, pos AS sp, pos + 1 AS tp, ['KNOWS', 'SPENDS_TIME_WITH', 'VISITS', 'SUPPORTS', 'SPENDSTIMEWITH'][CAST(uuid % 5 + 1 AS INT)] AS rel, 'fact ' || uuid AS fact,
  uuid % 2 = 0 AS has_start, uuid % 3 = 0 AS has_end FROM m),
built AS (SELECT rec.group_id, rec.episode_uuid, s.uuid AS source_uuid, t.uuid AS target_uuid, CASE WHEN rule.r IS NULL THEN 'RELATES_TO' ELSE rel END AS name, fact FROM rec
  JOIN tn s ON s.group_id = rec.group_id AND s.episode_uuid = rec.episode_uuid AND s.pos = sp JOIN tn t ON t.group_id = rec.group_id AND t.episode_uuid = rec.episode_uuid AND t.pos = tp
  LEFT JOIN rule ON rule.a = s.type AND rule.b = t.type AND rule.r = rel WHERE s.uuid <> t.uuid AND NOT (has_start AND has_end))
"""

ORACLES = {
    "suppress_filter": _NAMES + "SELECT group_id, episode_uuid, pos, name FROM kept",
    "suppressed_flags": _NAMES + "SELECT group_id, count(DISTINCT (episode_uuid, pos)) AS n FROM names GROUP BY ALL",
    "suppressed_names": _NAMES + """, one AS (SELECT group_id, episode_uuid, pos, min(name) AS name FROM names GROUP BY ALL)
SELECT *, EXISTS (SELECT 1 FROM sup s WHERE s.group_id = o.group_id AND s.name_lc = lower(o.name) AND (s.episode_uuid IS NULL OR s.episode_uuid = o.episode_uuid)) AS suppressed FROM one o""",
    "name_cleanup": _NAMES + f"SELECT DISTINCT name, {_CLEANED} AS cleaned FROM names",
    "batch_dedupe": _NAMES + f""", one AS (SELECT group_id, episode_uuid, pos, min(name) AS name FROM names GROUP BY ALL), c AS (SELECT group_id, episode_uuid, pos, {_CLEANED} AS name FROM one)
SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY group_id, episode_uuid, lower(name) ORDER BY pos) AS r FROM c WHERE name IS NOT NULL) WHERE r = 1""",
    "candidate_contains": _NAMES + f", w AS (SELECT DISTINCT group_id, lower({_STRIP % 'name'}) AS name_lc FROM prov) SELECT DISTINCT w.group_id, name_lc, uuid FROM w JOIN ent ON ent.group_id = w.group_id AND contains(lower(ent.name), name_lc) WHERE name_lc <> ''",
    "exact_resolve": _NAMES + f"SELECT p.group_id, p.uuid AS provisional_uuid, arg_min(e.uuid, (e.created_at, e.uuid)) AS uuid FROM prov p JOIN ent e ON e.group_id = p.group_id AND lower({_STRIP % 'e.name'}) = lower({_STRIP % 'p.name'}) GROUP BY ALL",
    "similar_resolve": _NAMES + """, sh AS (SELECT 0 AS k, group_id, uuid, regexp_replace(lower(name), '[\\s\\x{A0}]+', ' ', 'g') AS t FROM prov UNION ALL SELECT 1, group_id, uuid, regexp_replace(lower(name), '[\\s\\x{A0}]+', ' ', 'g') FROM ent),
s AS (SELECT k, group_id, uuid, CASE WHEN length(t) <= 3 THEN [t] ELSE list_distinct([substr(t, i, 3) FOR i IN range(1, length(t) - 1)]) END AS x FROM sh),
pr AS (SELECT a.group_id, a.uuid AS provisional_uuid, b.uuid, len(list_intersect(a.x, b.x)) AS both_in, len(a.x) + len(b.x) AS all_in FROM s a JOIN s b ON a.k = 0 AND b.k = 1 AND a.group_id = b.group_id AND len(a.x) BETWEEN 0.8 * len(b.x) AND 1.2 * len(b.x)),
ok AS (SELECT *, both_in / (all_in - both_in) AS similarity FROM pr WHERE both_in / (all_in - both_in) >= 0.9)
SELECT group_id, provisional_uuid, arg_min(uuid, (-similarity, uuid)) AS uuid, round(max(similarity), 6) AS similarity FROM ok GROUP BY ALL""",
    "pointer_remap": """WITH maps AS (SELECT group_id, x.key AS p, min(x.value) AS u FROM (SELECT group_id, UNNEST(map_entries(uuid_map)) AS x FROM extract_results) GROUP BY ALL)
SELECT d.group_id, coalesce(a.u, node_uuid) AS node_uuid, coalesce(b.u, canonical_uuid) AS canonical_uuid FROM duplicate_pairs d LEFT JOIN maps a ON a.group_id = d.group_id AND a.p = node_uuid LEFT JOIN maps b ON b.group_id = d.group_id AND b.p = canonical_uuid
WHERE node_uuid IS NOT NULL AND canonical_uuid IS NOT NULL""",
    "edge_build": _NODES4 + "SELECT * FROM built",
    "edge_merge": _NODES4 + """, old AS (SELECT group_id, source_uuid, target_uuid, name, min('old' || episode_uuid) AS uuid, list(episode_uuid + 1) || [3] AS eps FROM built WHERE episode_uuid % 2 = 0 GROUP BY ALL),
new AS (SELECT group_id, source_uuid, target_uuid, name, list(episode_uuid) AS eps, arg_min(fact, (episode_uuid, fact)) AS fact FROM built GROUP BY ALL)
SELECT n.group_id, n.source_uuid, n.target_uuid, n.name, o.uuid, CASE WHEN o.uuid IS NULL THEN n.fact ELSE 'known' END AS fact, list_sort(list_distinct(n.eps || coalesce(o.eps, []))) AS episodes, CASE WHEN o.uuid IS NULL THEN 'new' ELSE 'merged' END AS status
FROM new n LEFT JOIN old o USING (group_id, source_uuid, target_uuid, name)""",
    "edge_rules": _NODES4 + """, rl(a, b, r) AS (VALUES ('Person', 'Person', 'Knows'), ('Person', 'Person', 'SpendsTimeWith'), ('Person', 'Person', 'Supports'), ('Person', 'Person', 'ConflictsWith'), ('Person', 'Activity', 'ParticipatesIn'), ('Activity', 'Place', 'OccursAt'), ('Person', 'Place', 'Visits')),
al AS (SELECT DISTINCT s.group_id, s.episode_uuid, s.uuid AS su, t.uuid AS tu, coalesce(r, 'RELATES_TO') AS relation FROM tn s JOIN tn t ON s.group_id = t.group_id AND s.episode_uuid = t.episode_uuid AND s.uuid <> t.uuid JOIN (SELECT * FROM rl UNION ALL SELECT 'x', 'x', NULL) q ON (q.a = s.type AND q.b = t.type) OR q.r IS NULL)
SELECT group_id, relation, count(*) AS n FROM al GROUP BY ALL""",
    "all_pairs_edges": _NODES4 + "SELECT a.group_id, a.episode_uuid, a.uuid AS source_uuid, b.uuid AS target_uuid, 'RELATES_TO' AS name FROM tn a JOIN tn b ON a.group_id = b.group_id AND a.episode_uuid = b.episode_uuid AND a.pos < b.pos",
    "retry_dead": _EVENTS + "SELECT * FROM st",
    "status_counts": _EVENTS + "SELECT group_id, status, count(*) AS entries FROM st GROUP BY ALL",
    "pending_queue": "SELECT o_orderpriority AS group_id, o_orderkey AS episode_uuid, epoch_us(o_orderdate) / 1e6 AS score FROM orders WHERE o_orderstatus = 'O' ORDER BY score DESC, episode_uuid DESC LIMIT 200",
    "queue_pop": "SELECT group_id, seq, entity_uuid FROM (SELECT o_orderpriority AS group_id, o_orderkey AS seq, o_custkey AS entity_uuid, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 25",
    "task_queue": "SELECT o_orderpriority AS group_id, o_custkey AS episode_uuid, max(o_orderkey % 2) AS priority, arg_max(o_orderkey, (o_orderkey % 2, -o_orderkey)) AS seq FROM orders GROUP BY ALL",
    "orphan_state": "SELECT DISTINCT group_id, episode_uuid FROM extract_results r WHERE episode_uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM episodes e WHERE e.group_id = r.group_id AND e.uuid = r.episode_uuid AND source = 'text')",
    "fact_quality": _NAMES + r""", f AS (SELECT group_id, episode_uuid, pos, name, trim(replace(['I met {}', 'the narrator knows {}', '{} lives here, indicating a move', ' ', 'we saw {} and gave my book back', 'Suggesting that {} left'][pos % 6 + 1], '{}', name), ' ') AS t,
  pos % 5 > 0 AND (lower(name) = 'i' OR pos % 2 = 0) AS mine FROM names),
g AS (SELECT *, contains(lower(t), 'the narrator') AS third, contains(lower(t), ' i ') OR contains(lower(t), ' my ') OR contains(lower(t), ' me ') OR starts_with(t, 'I ') AS first FROM f)
SELECT group_id, episode_uuid, pos, name, CASE WHEN t = '' THEN 'empty' ELSE concat_ws(',', CASE WHEN mine AND third THEN 'third person' END, CASE WHEN mine AND NOT third AND NOT first THEN 'no first person' END,
  CASE WHEN contains(lower(t), 'indicating a') OR contains(lower(t), 'suggesting that') THEN 'analysis' END) END AS issues FROM g""",
    "display_states": "SELECT event_id, event_id % 4 > 0 AS busy, event_id % 4 = 0 AND event_id % 3 > 0 AS waiting, CASE WHEN event_id % 4 > 0 THEN 0.3 WHEN event_id % 3 > 0 THEN 0.5 ELSE 2.0 END::DOUBLE AS poll_seconds FROM events",
    "entity_f1": _NAMES + f""", g AS (SELECT DISTINCT episode_uuid, lower(name) || '|' || coalesce(entity_type_id, -1) AS item FROM names), p AS (SELECT DISTINCT episode_uuid, lower({_STRIP % 'name'}) || '|' || coalesce(entity_type_id, -1) AS item FROM names WHERE pos > 0),
j AS (SELECT coalesce(g.episode_uuid, p.episode_uuid) AS episode_uuid, g.item AS gi, p.item AS pi FROM g FULL JOIN p ON g.episode_uuid = p.episode_uuid AND g.item = p.item),
c AS (SELECT episode_uuid, count(*) FILTER (gi IS NOT NULL AND pi IS NOT NULL) AS correct, count(*) FILTER (pi IS NULL) AS missing, count(*) FILTER (gi IS NULL) AS extra FROM j GROUP BY ALL)
SELECT *, round(CASE WHEN correct + extra = 0 THEN 0 ELSE correct / (correct + extra) END, 6) AS precision, round(correct / (correct + missing), 6) AS recall, round(2 * correct / (2 * correct + missing + extra), 6) AS f1 FROM c""",
    "relation_f1": VIEWS + """, g AS (SELECT DISTINCT episode_uuid, entity_uuid, pos FROM m), c AS (SELECT episode_uuid, count(*) AS want, count(*) FILTER (pos <> 2) AS hit FROM g GROUP BY ALL)
SELECT round(avg(2.0 * hit / (want + hit)), 6) AS mean_score, count(*) AS n FROM c""",
    "attribute_match": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM orders",
    "fulltext_query": "SELECT p_partkey, '(' || array_to_string(list_filter(string_split(regexp_replace(p_name || ' ' || p_brand, '[#]', ' ', 'g'), ' '), lambda w: w <> ''), ' | ') || ')' AS query FROM part",
    "token_search": """WITH d AS (SELECT p_partkey AS uuid, list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '#', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM part),
t AS (SELECT uuid, len(w) AS size, UNNEST(w) AS word FROM d), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), df AS (SELECT word, count(DISTINCT uuid) AS df FROM t WHERE word IN ('red', 'plate', 'economy') GROUP BY ALL),
tf AS (SELECT uuid, size, word, count(*) AS tf FROM t WHERE word IN ('red', 'plate', 'economy') GROUP BY ALL)
SELECT uuid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (word), n GROUP BY uuid ORDER BY score DESC, uuid LIMIT 50""",
    "dayone_clean": """SELECT o_orderkey, 'Note!  ' || o_orderpriority || ' #' || o_orderkey AS text, upper(concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])) AS uuid FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""",
    "xml_posts": """SELECT * FROM (SELECT '/blog/' || o_custkey AS path, 'order ' || o_orderkey || ' & ' || o_orderstatus AS content, last_value(CASE WHEN o_orderkey % 2 = 0 THEN CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS entry_time FROM orders) WHERE entry_time IS NOT NULL""",
    "import_idempotent": """WITH n AS (SELECT o_orderkey - o_orderkey % 2 AS uuid, o_orderdate AS ts, CASE WHEN o_orderkey % 10 = 1 THEN '  ' ELSE o_orderstatus END AS content FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts, content) AS r, uuid % 3 = 0 AND uuid IN (SELECT o_orderkey FROM orders) AS have FROM n)
SELECT count(*) FILTER (trim(content) <> '' AND NOT have AND r = 1) AS imported, count(*) FILTER (trim(content) <> '' AND (have OR r > 1)) AS skipped, count(*) FILTER (trim(content) = '') AS refused FROM s""",
}
