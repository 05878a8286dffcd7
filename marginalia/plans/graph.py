"""Graph, listing and mutation queries over the star projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dates
from ..operators import graph, listing, mutations
from ..session import table
from . import star
from .star import GROUP, SELF, VIEWS

SOURCES, EXCLUDED, TARGET, EPISODE = [1, 2, 3, 5, 8], [10, 11, 12], 7, 12
START, END, NOW = "1996-01-01", "1996-07-01", "1998-08-12 00:00:00"


def _sources(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(GROUP).alias("group_id"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in SOURCES])).alias("entity_uuid"))


def _neighbors(spark, folder, exclude=None):  # noqa: ANN001, ANN202
    return graph.neighbors(star.episodes(spark, folder), star.entities(spark, folder), star.mentions(spark, folder), _sources(spark), SELF, exclude)


def neighbors_top(spark, folder):  # noqa: ANN001, ANN201
    """J03, A04, L04"""
    return _neighbors(spark, folder)


def neighbors_excluding(spark, folder):  # noqa: ANN001, ANN201
    """J21, U03"""
    return _neighbors(spark, folder, EXCLUDED)


def cooccurrence_top20(spark, folder):  # noqa: ANN001, ANN201
    """J02, A03, L03"""
    return graph.cooccurring(star.episodes(spark, folder), star.entities(spark, folder), star.mentions(spark, folder), GROUP, TARGET, SELF)


def entity_timeline(spark, folder):  # noqa: ANN001, ANN201
    """J01, L01"""
    return graph.timeline(star.episodes(spark, folder), star.mentions(spark, folder), GROUP, TARGET)


def entity_headers(spark, folder):  # noqa: ANN001, ANN201
    """A09"""
    return graph.headers(star.episodes(spark, folder), star.entities(spark, folder), star.mentions(spark, folder))


def entry_entities_counts(spark, folder):  # noqa: ANN001, ANN201
    """Q05, J04, A02"""
    return graph.entry_entities(star.nodes(spark, folder), star.mentions(spark, folder), _group_of(spark, folder), EPISODE, SELF)


def _group_of(spark: SparkSession, folder: str) -> str:
    return table(spark, folder, "orders").where(F.col("o_orderkey") == EPISODE).first()["o_orderpriority"]


def zero_mention_entities(spark, folder):  # noqa: ANN001, ANN201
    """J06, J07"""
    return graph.orphans(star.entities(spark, folder), star.mentions(spark, folder)).select("group_id", "uuid", "name")


def period_rollup(spark, folder):  # noqa: ANN001, ANN201
    """J05, A01, J20"""
    return graph.period_rollup(star.episodes(spark, folder), star.nodes(spark, folder), F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp"), SELF)


def period_top_names(spark, folder):  # noqa: ANN001, ANN201
    """A01, L05, J20"""
    return graph.period_names(star.episodes(spark, folder), star.nodes(spark, folder), F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp"), SELF, 20)


def recent_asof(spark, folder):  # noqa: ANN001, ANN201
    """J08, W09"""
    probes = star.groups(spark, folder).select("group_id", F.explode(F.array(*[F.lit(x).cast("timestamp") for x in ("1995-01-01", "1996-02-29", "1999-12-31 12:00:00")])).alias("at"))
    return graph.recent_as_of(star.episodes(spark, folder), probes, 5)


def mention_degrees(spark, folder):  # noqa: ANN001, ANN201
    """A06"""
    return graph.degrees(star.mentions(spark, folder))


def entity_mention_lists(spark, folder):  # noqa: ANN001, ANN201
    """A05"""
    per = star.mentions(spark, folder).groupBy("group_id", "entity_uuid")
    return per.agg(F.sort_array(F.collect_set("episode_uuid")).alias("episodes"), F.sort_array(F.collect_list("uuid")).alias("edges"))


def db_stats(spark, folder):  # noqa: ANN001, ANN201
    """Q11"""
    return graph.totals(star.episodes(spark, folder), star.entities(spark, folder))


def episode_lookup(spark, folder):  # noqa: ANN001, ANN201
    """Q01, Q02"""
    return graph.point(star.episodes(spark, folder), _group_of(spark, folder), EPISODE)


def entities_of_group(spark, folder):  # noqa: ANN001, ANN201
    """Q06, Q08, Q09: those of a journal, and the self entity of any"""
    return star.entities(spark, folder).where((F.col("group_id") == GROUP) | (F.col("name") == SELF))


def relations_by_group(spark, folder):  # noqa: ANN001, ANN201
    """Q10: parts bought in one order with the next line's part as relations; ends must exist"""
    m = star.mentions(spark, folder)
    nxt = m.select("group_id", "episode_uuid", (F.col("pos") - 1).alias("pos"), F.col("entity_uuid").alias("target_uuid"))
    relations = m.select("group_id", "episode_uuid", "pos", F.col("entity_uuid").alias("source_uuid")).join(nxt, ["group_id", "episode_uuid", "pos"])
    few = star.entities(spark, folder).where("type <> 'ECONOMY'")
    return graph.relations_of(relations.select("group_id", "source_uuid", "target_uuid", F.col("episode_uuid").alias("episode")), few)


def path_lengths(spark, folder):  # noqa: ANN001, ANN201
    """J18 over regions, their nations, and from the first two nations of a region on to the next region: rings, and paths of 4 and 14 edges"""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_regionkey").cast("bigint").alias("r"))
    first = n.withColumn("no", F.row_number().over(Window.partitionBy("r").orderBy("k"))).where("no <= 2")  # 25 nations
    edges = n.select((F.col("k")).alias("id"), (F.col("r") + 100).alias("src"), F.col("k").alias("dst")).unionAll(first.select((F.col("k") + 50).alias("id"), F.col("k").alias("src"), (F.col("r") + 1) % 5 + 100))
    return graph.path_lengths(edges, 100, 102)


def friends_of(spark, folder):  # noqa: ANN001, ANN201
    """Suppliers of a customer's nation by property"""
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    few = c.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)).select("c_custkey", "c_nationkey")
    return few.join(s, few["c_nationkey"] == s["s_nationkey"]).select("c_custkey", "s_suppkey", "s_name")


def department_stats(spark, folder):  # noqa: ANN001, ANN201
    """A08"""
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("mean"), F.max("c_acctbal").alias("top"))


def home_page(spark, folder):  # noqa: ANN001, ANN201
    """Q03, Q04, L02, T01, T25"""
    return listing.page(star.episodes(spark, folder), GROUP, 100)


def home_page_2(spark, folder):  # noqa: ANN001, ANN201
    """Q04, L02"""
    return listing.page(star.episodes(spark, folder), GROUP, 100, 100)


def home_has_more(spark, folder):  # noqa: ANN001, ANN201
    """Q04"""
    return listing.has_more(star.episodes(spark, folder), GROUP, 100, 100)


def entry_navigation(spark, folder):  # noqa: ANN001, ANN201
    """W06, W07"""
    return listing.neighbours(star.episodes(spark, folder))


def entry_positions(spark, folder):  # noqa: ANN001, ANN201
    """Q23"""
    return listing.positions(star.episodes(spark, folder))


def period_bounds(spark, folder):  # noqa: ANN001, ANN201
    """D05-D08, W04, W05"""
    return dates.periods(star.episodes(spark, folder), "group_id", "valid_at", "uuid", F.lit(NOW).cast("timestamp"))


def titles(spark, folder):  # noqa: ANN001, ANN201
    """D03, D14, D01"""
    e = star.episodes(spark, folder)
    return e.select("uuid", dates.entry_title(F.col("valid_at")).alias("title"), dates.score(F.col("valid_at")).alias("score"), dates.week_start(F.col("valid_at")).alias("week"))


def _effects(before: mutations.Graph, after: mutations.Graph) -> DataFrame:
    count = lambda d, n: d.agg(F.count("*").alias(n))
    out = count(before.episodes, "episodes_before")
    for d, n in ((after.episodes, "episodes_after"), (before.entities, "entities_before"), (after.entities, "entities_after"), (before.mentions, "mentions_before"), (after.mentions, "mentions_after")):
        out = out.crossJoin(count(d, n))  # scalars
    return out


def _graph(spark: SparkSession, folder: str) -> mutations.Graph:
    m = star.mentions(spark, folder)
    # Entities of this graph are those mentioned, and every third part besides.
    en = star.entities(spark, folder)
    used = m.select("group_id", F.col("entity_uuid").alias("uuid")).distinct()
    return mutations.Graph(star.episodes(spark, folder), en.join(used, ["group_id", "uuid"], "left_semi"), m)


def delete_episode_effect(spark, folder):  # noqa: ANN001, ANN201
    """All entries of 1995 leave"""
    g = _graph(spark, folder)
    gone = g.episodes.where(F.year("valid_at") == 1995).select("group_id", "uuid")
    return _effects(g, mutations.delete_episodes(g, gone))


def delete_entity_effect(spark, folder):  # noqa: ANN001, ANN201
    """(group_id, uuid, name, deleted_edges)"""
    g = _graph(spark, folder)
    return mutations.deleted_entities(g, g.entities.where("uuid < 10").select("group_id", "uuid"))


def delete_mention_effect(spark, folder):  # noqa: ANN001, ANN201
    """The mentions of low part keys in one journal leave; entities left without any leave too"""
    g = _graph(spark, folder)
    gone = g.mentions.where(F.col("entity_uuid") < 40).where(F.col("group_id") == GROUP).select("group_id", "episode_uuid", "entity_uuid")
    return _effects(g, mutations.delete_mentions(g, gone))


def doomed_stats(spark, folder):  # noqa: ANN001, ANN201
    """Entities that entries of 1995 alone mention"""
    g = _graph(spark, folder)
    gone = g.episodes.where(F.year("valid_at") == 1995).select("group_id", "uuid")
    return mutations.doomed(g, gone).groupBy("group_id").agg(F.count("*").alias("doomed"), F.sum("edges").alias("edges"))


def upsert_entities(spark, folder):  # noqa: ANN001, ANN201
    """New rows replace old ones by key"""
    old = star.entities(spark, folder)
    new = old.where("uuid % 7 = 0").withColumn("name", F.upper("name")).unionAll(old.where("uuid < 5").withColumn("uuid", F.col("uuid") + 1_000_000))
    return mutations.upsert(old, new, ["group_id", "uuid"]).groupBy("group_id", "name").agg(F.count("*").alias("n"), F.sum("uuid").alias("keys"))


def upsert_mentions(spark, folder):  # noqa: ANN001, ANN201
    """Edges need both ends"""
    g = _graph(spark, folder)
    new = g.mentions.where("uuid % 11 = 0").select("group_id", (F.col("uuid") + 10_000_000).alias("uuid"), (F.col("episode_uuid") + 5).alias("episode_uuid"), (F.col("entity_uuid") * 2).alias("entity_uuid"), "pos")
    return mutations.upsert_edges(g, new).groupBy("group_id").agg(F.count("*").alias("n"), F.sum("uuid").alias("keys"))


def self_entity_upsert(spark, folder):  # noqa: ANN001, ANN201
    """What the self entity has stays, what is missing comes"""
    have = table(spark, folder, "entities").where(F.col("uuid") == mutations.SELF_UUID)
    groups_ = table(spark, folder, "episodes").select("group_id").distinct()
    out = mutations.ensure_self(have.groupBy("group_id").agg(F.min_by(F.struct(*have.columns), F.struct(F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp")), F.coalesce("summary", F.lit("")))).alias("x")).select("x.*"), groups_, F.lit("2020-01-01").cast("timestamp"))
    return out.select("group_id", "uuid", "name", "labels", F.coalesce("summary", F.lit("-")).alias("summary"))


def update_effect(spark, folder):  # noqa: ANN001, ANN201
    """(group_id, uuid, name, content_changed)"""
    e = star.episodes(spark, folder)
    patch = e.where("uuid % 10 = 0").select("group_id", "uuid", F.when(F.col("uuid") % 20 == 0, F.lit("new text")).alias("content"), F.lit("renamed").alias("name"), F.lit(None).cast("timestamp").alias("valid_at"))
    return mutations.update(e, patch).select("group_id", "uuid", "name", F.length("content").alias("size"), "content_changed")


QUERIES = {f.__name__: f for f in (
    neighbors_top, neighbors_excluding, cooccurrence_top20, entity_timeline, entity_headers, entry_entities_counts, zero_mention_entities, period_rollup, period_top_names, recent_asof,
    mention_degrees, entity_mention_lists, db_stats, episode_lookup, entities_of_group, relations_by_group, path_lengths, friends_of, department_stats, home_page, home_page_2, home_has_more,
    entry_navigation, entry_positions, period_bounds, titles, delete_episode_effect, delete_entity_effect, delete_mention_effect, doomed_stats, upsert_entities, upsert_mentions, self_entity_upsert, update_effect,
)}

_S = ", ".join(map(str, SOURCES))
_NEIGHBORS = VIEWS + f"""
SELECT b.group_id, b.entity_uuid AS uuid, en.name, count(DISTINCT a.entity_uuid) AS hits, min(ep.valid_at) AS oldest
FROM pairs a JOIN pairs b ON a.group_id = b.group_id AND a.episode_uuid = b.episode_uuid
JOIN ep ON ep.group_id = b.group_id AND ep.uuid = b.episode_uuid JOIN en ON en.group_id = b.group_id AND en.uuid = b.entity_uuid
WHERE a.group_id = '{GROUP}' AND a.entity_uuid IN ({_S}) AND b.entity_uuid NOT IN ({_S}, %s) AND en.name <> '{SELF}'
GROUP BY ALL ORDER BY hits DESC, oldest, b.group_id, uuid LIMIT 20"""
_PAGE = VIEWS + f"SELECT uuid, name, valid_at, split_part(content, '.', 1) || '.' AS preview FROM ep WHERE group_id = '{GROUP}' ORDER BY valid_at DESC, uuid DESC LIMIT 100 OFFSET %d"
_COUNTS = """SELECT (SELECT count(*) FROM ep) AS episodes_before, (SELECT count(*) FROM ep2) AS episodes_after, (SELECT count(*) FROM have) AS entities_before,
  (SELECT count(*) FROM have2) AS entities_after, (SELECT count(*) FROM m) AS mentions_before, (SELECT count(*) FROM m2) AS mentions_after"""
_HAVE = ", have AS (SELECT * FROM en SEMI JOIN m ON en.group_id = m.group_id AND en.uuid = m.entity_uuid)"

ORACLES = {
    "neighbors_top": _NEIGHBORS % -1,
    "neighbors_excluding": _NEIGHBORS % ", ".join(map(str, EXCLUDED)),
    "cooccurrence_top20": VIEWS + f"""SELECT b.entity_uuid AS uuid, en.name, count(*) AS co_count, max_by(ep.content, (ep.valid_at, ep.uuid)) AS sample
FROM pairs a JOIN pairs b ON a.group_id = b.group_id AND a.episode_uuid = b.episode_uuid AND a.entity_uuid <> b.entity_uuid
JOIN ep ON ep.uuid = b.episode_uuid AND ep.group_id = b.group_id JOIN en ON en.group_id = b.group_id AND en.uuid = b.entity_uuid
WHERE a.group_id = '{GROUP}' AND a.entity_uuid = {TARGET} AND en.name <> '{SELF}' GROUP BY ALL ORDER BY co_count DESC, uuid LIMIT 20""",
    "entity_timeline": VIEWS + f"SELECT ep.* FROM ep JOIN m ON ep.group_id = m.group_id AND ep.uuid = m.episode_uuid WHERE m.group_id = '{GROUP}' AND m.entity_uuid = {TARGET}",
    "entity_headers": VIEWS + "SELECT en.group_id, en.uuid, en.name, count(*) AS entry_count, min(valid_at) AS first_mention, max(valid_at) AS last_mention FROM en JOIN m ON en.group_id = m.group_id AND en.uuid = m.entity_uuid JOIN ep ON ep.group_id = m.group_id AND ep.uuid = m.episode_uuid GROUP BY ALL",
    "entry_entities_counts": VIEWS + f"SELECT n.pos, n.uuid, n.name, n.type, count(DISTINCT m.episode_uuid) AS mention_count FROM nodes n LEFT JOIN m ON m.group_id = n.group_id AND m.entity_uuid = n.uuid WHERE n.episode_uuid = {EPISODE} AND n.name <> '{SELF}' GROUP BY ALL",
    "zero_mention_entities": VIEWS + "SELECT group_id, uuid, name FROM en WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.group_id = en.group_id AND m.entity_uuid = en.uuid)",
    "period_rollup": VIEWS + f"""SELECT ep.group_id, count(DISTINCT ep.uuid) AS entry_count, count(n.uuid) AS connection_count FROM ep LEFT JOIN nodes n ON n.group_id = ep.group_id AND n.episode_uuid = ep.uuid AND n.name <> '{SELF}'
WHERE valid_at >= '{START}' AND valid_at < '{END}' GROUP BY ALL""",
    "period_top_names": VIEWS + f""", seen AS (SELECT n.group_id, n.name, n.uuid, n.pos, ep.valid_at, ep.uuid AS e FROM ep JOIN nodes n ON n.group_id = ep.group_id AND n.episode_uuid = ep.uuid WHERE n.name <> '{SELF}' AND valid_at >= '{START}' AND valid_at < '{END}'),
per AS (SELECT group_id, name, count(*) AS frequency, max((valid_at, e, -pos, uuid)) AS newest FROM seen GROUP BY ALL)
SELECT group_id, name, frequency, arg_max_uuid AS uuid, rank FROM (SELECT p.*, (SELECT s.uuid FROM seen s WHERE s.group_id = p.group_id AND s.name = p.name ORDER BY s.valid_at DESC, s.e DESC, s.pos, s.uuid DESC LIMIT 1) AS arg_max_uuid,
  row_number() OVER (PARTITION BY group_id ORDER BY frequency DESC, newest DESC, name) AS rank FROM per p) WHERE rank <= 20""",
    "recent_asof": VIEWS + """, probe AS (SELECT group_id, CAST(t AS TIMESTAMP) AS probe FROM grp, (VALUES ('1995-01-01'), ('1996-02-29'), ('1999-12-31 12:00:00')) x(t))
SELECT group_id, probe, uuid, valid_at, rank FROM (SELECT ep.group_id, probe, uuid, valid_at, row_number() OVER (PARTITION BY ep.group_id, probe ORDER BY valid_at DESC, uuid DESC) AS rank FROM ep JOIN probe ON ep.group_id = probe.group_id AND valid_at <= probe) WHERE rank <= 5""",
    "mention_degrees": VIEWS + "SELECT group_id, entity_uuid AS uuid, count(*) AS degree FROM m GROUP BY ALL",
    "entity_mention_lists": VIEWS + "SELECT group_id, entity_uuid, list_sort(list(DISTINCT episode_uuid)) AS episodes, list_sort(list(uuid)) AS edges FROM m GROUP BY ALL",
    "db_stats": VIEWS + "SELECT (SELECT count(*) FROM ep) AS episodes, (SELECT count(*) FROM en) AS entities",
    "episode_lookup": VIEWS + f"SELECT * FROM ep WHERE uuid = {EPISODE}",
    "entities_of_group": VIEWS + f"SELECT * FROM en WHERE group_id = '{GROUP}' OR name = '{SELF}'",
    "relations_by_group": VIEWS + """, few AS (SELECT * FROM en WHERE type <> 'ECONOMY'), rel AS (SELECT a.group_id, a.episode_uuid AS episode, a.entity_uuid AS source_uuid, b.entity_uuid AS target_uuid FROM m a JOIN m b ON a.group_id = b.group_id AND a.episode_uuid = b.episode_uuid AND b.pos = a.pos + 1)
SELECT rel.*, s.name AS source_name, t.name AS target_name FROM rel JOIN few s ON s.group_id = rel.group_id AND s.uuid = source_uuid JOIN few t ON t.group_id = rel.group_id AND t.uuid = target_uuid""",
    "path_lengths": """WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_regionkey + 100 AS src, n_nationkey AS dst FROM nation UNION ALL SELECT n_nationkey + 50, n_nationkey, (n_regionkey + 1) % 5 + 100 FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 2),
walk(spot, used, length) AS (SELECT dst, [id], 1 FROM e WHERE src = 100 UNION ALL SELECT e.dst, list_append(used, e.id), length + 1 FROM walk JOIN e ON e.src = spot WHERE NOT list_contains(used, e.id))
SELECT length, count(*) AS paths FROM walk WHERE spot = 102 GROUP BY ALL""",
    "friends_of": "SELECT c_custkey, s_suppkey, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000",
    "department_stats": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS mean, max(c_acctbal) AS top FROM customer GROUP BY ALL",
    "home_page": _PAGE % 0,
    "home_page_2": _PAGE % 100,
    "home_has_more": VIEWS + f"SELECT count(*) > 200 AS has_more FROM ep WHERE group_id = '{GROUP}'",
    "entry_navigation": VIEWS + """SELECT group_id, uuid, lag(uuid) OVER w AS newer_uuid, lead(uuid) OVER w AS older_uuid, CAST(valid_at AS DATE) IS DISTINCT FROM CAST(lag(valid_at) OVER w AS DATE) AS new_date
FROM ep WINDOW w AS (PARTITION BY group_id ORDER BY valid_at DESC, uuid DESC)""",
    "entry_positions": VIEWS + "SELECT group_id, uuid, row_number() OVER (PARTITION BY group_id ORDER BY valid_at DESC, uuid DESC) - 1 AS position FROM ep",
    "period_bounds": VIEWS + f""", t AS (SELECT *, date_trunc('week', TIMESTAMP '{NOW}') AS w FROM ep), l AS (SELECT *, CASE WHEN valid_at >= w THEN 'This Week' WHEN valid_at >= w - INTERVAL 7 DAY THEN 'Last Week' ELSE strftime(valid_at, '%B %Y') END AS period FROM t),
g AS (SELECT group_id, period, w, count(*) AS entries, max((valid_at, uuid)) AS newest, max(valid_at) AS top FROM l GROUP BY ALL),
b AS (SELECT *, CASE period WHEN 'This Week' THEN w WHEN 'Last Week' THEN w - INTERVAL 7 DAY ELSE date_trunc('month', top) END AS period_start FROM g)
SELECT group_id, period, CAST(period_start AS TIMESTAMP) AS period_start, CAST(CASE WHEN period IN ('This Week', 'Last Week') THEN period_start + INTERVAL 7 DAY ELSE period_start + INTERVAL 1 MONTH END AS TIMESTAMP) AS period_end, entries,
  coalesce(sum(entries) OVER (PARTITION BY group_id ORDER BY newest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_index FROM b""",
    "titles": VIEWS + "SELECT uuid, strftime(valid_at, '%A %b %-d, %Y') AS title, epoch_us(valid_at) / 1e6 AS score, CAST(date_trunc('week', valid_at) AS TIMESTAMP) AS week FROM ep",
    "delete_episode_effect": VIEWS + _HAVE + """, ep2 AS (SELECT * FROM ep WHERE year(valid_at) <> 1995), m2 AS (SELECT m.* FROM m SEMI JOIN ep2 ON ep2.group_id = m.group_id AND ep2.uuid = m.episode_uuid),
have2 AS (SELECT * FROM have SEMI JOIN m2 ON have.group_id = m2.group_id AND have.uuid = m2.entity_uuid) """ + _COUNTS,
    "delete_entity_effect": VIEWS + "SELECT en.group_id, en.uuid, en.name, count(*) AS deleted_edges FROM en JOIN m ON en.group_id = m.group_id AND en.uuid = m.entity_uuid WHERE en.uuid < 10 GROUP BY ALL",
    "delete_mention_effect": VIEWS + _HAVE + f""", ep2 AS (SELECT * FROM ep), m2 AS (SELECT * FROM m WHERE NOT (group_id = '{GROUP}' AND entity_uuid < 40)),
have2 AS (SELECT * FROM have SEMI JOIN m2 ON have.group_id = m2.group_id AND have.uuid = m2.entity_uuid) """ + _COUNTS,
    "doomed_stats": VIEWS + """, x AS (SELECT m.group_id, m.entity_uuid, bool_and(year(ep.valid_at) = 1995) AS all_gone, count(*) AS edges FROM m JOIN ep ON ep.group_id = m.group_id AND ep.uuid = m.episode_uuid GROUP BY ALL)
SELECT group_id, count(*) AS doomed, sum(edges)::BIGINT AS edges FROM x WHERE all_gone GROUP BY ALL""",
    "upsert_entities": VIEWS + """, new AS (SELECT group_id, uuid, upper(name) AS name FROM en WHERE uuid % 7 = 0 UNION ALL SELECT group_id, uuid + 1000000, name FROM en WHERE uuid < 5),
al AS (SELECT group_id, uuid, name FROM en ANTI JOIN new USING (group_id, uuid) UNION ALL SELECT * FROM new) SELECT group_id, name, count(*) AS n, sum(uuid)::BIGINT AS keys FROM al GROUP BY ALL""",
    "upsert_mentions": VIEWS + _HAVE + """, new AS (SELECT group_id, uuid + 10000000 AS uuid, episode_uuid + 5 AS episode_uuid, entity_uuid * 2 AS entity_uuid FROM m WHERE uuid % 11 = 0),
ok AS (SELECT new.* FROM new SEMI JOIN ep ON ep.group_id = new.group_id AND ep.uuid = new.episode_uuid), ok2 AS (SELECT ok.* FROM ok SEMI JOIN have ON have.group_id = ok.group_id AND have.uuid = ok.entity_uuid),
al AS (SELECT group_id, uuid FROM m UNION ALL SELECT group_id, uuid FROM ok2) SELECT group_id, count(*) AS n, sum(uuid)::BIGINT AS keys FROM al GROUP BY ALL""",
    "self_entity_upsert": """SELECT g.group_id, '11111111-1111-1111-1111-111111111111' AS uuid, 'I' AS name, ['Entity', 'Person'] AS labels, coalesce(nullif(arg_min(coalesce(e.summary, ''), (coalesce(e.created_at, TIMESTAMP '1900-01-01'), coalesce(e.summary, ''))), ''), '-') AS summary
FROM (SELECT DISTINCT group_id FROM episodes) g LEFT JOIN entities e ON e.group_id = g.group_id AND e.uuid = '11111111-1111-1111-1111-111111111111' GROUP BY g.group_id""",
    "update_effect": VIEWS + """SELECT group_id, uuid, CASE WHEN uuid % 10 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN uuid % 20 = 0 THEN 8 ELSE length(content) END AS size, uuid % 20 = 0 AS content_changed FROM ep""",
}
