from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.operators import edges, graph, listing, metrics, mutations, resolve, state


def build(spark, entries):
    """{entry: (date, names)} to tables; an entity's key is its name."""
    ep = [("g", e, datetime.fromisoformat(d), f"text {e}") for e, (d, _) in entries.items()]
    names = sorted({n for _, (_, ns) in entries.items() for n in ns})
    m = [("g", f"{e}-{n}-{i}", e, n) for e, (_, ns) in entries.items() for i, n in enumerate(ns)]
    return (
        spark.createDataFrame(ep, "group_id string, uuid string, valid_at timestamp, content string"),
        spark.createDataFrame([("g", n, n) for n in names] + [("other", n, n) for n in names], "group_id string, uuid string, name string"),
        spark.createDataFrame(m, "group_id string, uuid string, episode_uuid string, entity_uuid string"),
    )


def neighbours(spark, entries, sources, exclude=None, limit=20):
    ep, en, m = build(spark, entries)
    src = spark.createDataFrame([("g", s) for s in sources], "group_id string, entity_uuid string")
    return [(r.uuid, r.hits) for r in graph.neighbors(ep, en, m, src, "I", exclude, limit).collect()]


def test_neighbours(spark):
    assert neighbours(spark, {"1": ("2024-01-01", ["alice", "bob"]), "2": ("2024-01-02", ["carol"])}, ["alice"]) == [("bob", 1)]
    three = {"1": ("2024-01-01", ["alice", "diana"]), "2": ("2024-01-02", ["bob", "diana"]), "3": ("2024-01-03", ["alice", "carol"])}
    assert neighbours(spark, three, ["alice", "bob"]) == [("diana", 2), ("carol", 1)]
    assert neighbours(spark, {"1": ("2024-01-01", ["alice", "bob", "carol", "I"])}, ["alice"], ["bob"]) == [("carol", 1)]
    assert neighbours(spark, {"1": ("2024-01-15", ["alice", "carol"]), "2": ("2025-01-15", ["alice", "bob"])}, ["alice"]) == [("carol", 1), ("bob", 1)]
    assert len(neighbours(spark, {"1": ("2024-01-01", ["s", *map(str, range(10))])}, ["s"], limit=3)) == 3
    assert neighbours(spark, {"1": ("2024-01-01", ["alice"])}, []) == []


def test_periods(spark):
    ep, en, m = build(spark, {"1": ("2025-10-01", ["Alice", "Bob", "I"]), "2": ("2025-10-20", ["Alice", "Carol"]), "3": ("2025-11-01", ["Bob"]), "4": ("2025-10-05", [])})
    nodes = m.join(en, (m.group_id == en.group_id) & (m.entity_uuid == en.uuid)).select(m.group_id, "episode_uuid", F.lit(0).alias("pos"), en.uuid, "name", F.lit("Person").alias("type"))
    a, b = F.lit("2025-10-01").cast("timestamp"), F.lit("2025-11-01").cast("timestamp")
    assert graph.period_rollup(ep, nodes, a, b, "I").first()[1:] == (3, 4)
    assert [(r.name, r.frequency) for r in graph.period_names(ep, nodes, a, b, "I").orderBy("rank").collect()] == [("Alice", 2), ("Carol", 1), ("Bob", 1)]
    assert graph.period_rollup(ep, nodes, b, b, "I").count() == 0


def test_as_of_crosses_empty_months(spark):
    ep, _, _ = build(spark, {str(i): (f"2020-{i:02d}-15", []) for i in (1, 2, 5, 6)})
    probes = spark.createDataFrame([("g", datetime(2020, 4, 1)), ("g", datetime(2020, 6, 20)), ("g", datetime(2019, 1, 1)), ("g", datetime(2020, 5, 15))], "group_id string, at timestamp")
    got = {}
    for r in graph.recent_as_of(ep, probes, 3).orderBy("rank").collect():
        got.setdefault(r.probe.strftime("%m-%d"), []).append(r.uuid)
    assert got == {"04-01": ["2", "1"], "06-20": ["6", "5", "2"], "05-15": ["5", "2", "1"]}


def test_pages_have_no_gaps(spark):
    ep, _, _ = build(spark, {f"{i:02d}": ("2024-01-01" if i % 2 else "2024-02-01", []) for i in range(25)})
    ep = ep.withColumn("name", F.lit("n"))
    seen = [r.uuid for o in range(0, 30, 10) for r in listing.page(ep, "g", 10, o).collect()]
    assert len(seen) == len(set(seen)) == 25
    assert [listing.has_more(ep, "g", 10, o).first()[0] for o in (0, 10, 15, 20)] == [True, True, False, False]
    order = [r.uuid for r in listing.positions(ep).orderBy("position").collect()]
    assert order == seen
    moves = {r.uuid: (r.newer_uuid, r.older_uuid) for r in listing.neighbours(ep).collect()}
    assert all(moves[a][1] == b and moves[b][0] == a for a, b in zip(order, order[1:]))


def test_orphans_after_deletes(spark):
    ep, en, m = build(spark, {"1": ("2024-01-01", ["a", "b"]), "2": ("2024-01-02", ["a"])})
    g = mutations.Graph(ep, en.where("group_id = 'g'"), m)
    key = lambda *k: spark.createDataFrame([("g", x) for x in k], "group_id string, uuid string")
    after = mutations.delete_episodes(g, key("1"))
    assert [r.uuid for r in after.entities.collect()] == ["a"] and after.mentions.count() == 1
    assert mutations.delete_episodes(after, key("2")).entities.count() == 0
    gone = spark.createDataFrame([("g", "2", "b")], "group_id string, episode_uuid string, entity_uuid string")
    assert mutations.delete_mentions(g, gone).entities.count() == 2
    assert {r.uuid: r.deleted_edges for r in mutations.deleted_entities(g, key("a", "zz")).collect()} == {"a": 2}


def test_update_and_missing(spark):
    ep, _, _ = build(spark, {"1": ("2024-01-01", []), "2": ("2024-01-01", [])})
    ep = ep.withColumn("name", F.lit("n"))
    patch = spark.createDataFrame([("g", "1", "new", None, None), ("g", "9", "x", None, None)], "group_id string, uuid string, content string, name string, valid_at timestamp")
    got = {r.uuid: (r.content, r.name, r.content_changed) for r in mutations.update(ep, patch).collect()}
    assert got == {"1": ("new", "n", True), "2": ("text 2", "n", False)}
    assert [r.uuid for r in mutations.missing(ep, patch).collect()] == ["9"]


def test_resolution(spark):
    names = spark.createDataFrame([("g", "e", i, n, 1) for i, n in enumerate(["the park", "Park", "PARK", "Anna", "I", "x", "Annabel Lee of the sea"])], "group_id string, episode_uuid string, pos int, name string, entity_type_id int")
    sup = resolve.suppressed_names(spark.createDataFrame([("g", None, "ANNA"), ("g", "other", "park")], "group_id string, episode_uuid string, name string"))
    left = resolve.clean_batch(resolve.suppress(names, sup))
    assert [r.name for r in left.orderBy("pos").collect()] == ["park", "Annabel Lee of the sea"]
    have = spark.createDataFrame([("g", "1", "PARK", datetime(2020, 1, 1)), ("g", "2", "Park ", datetime(2019, 1, 1)), ("g", "3", "annabel lee of the sea", datetime(2020, 1, 1)), ("h", "4", "park", datetime(2000, 1, 1))], "group_id string, uuid string, name string, created_at timestamp")
    got = {r.provisional_uuid: (r.uuid, r.how) for r in resolve.resolve(have, left.select("group_id", F.col("name").alias("uuid"), "name")).collect()}
    assert got["Annabel Lee of the sea"] == ("3", "similar") and got["park"][0] in ("1", "2")
    found = resolve.candidates(have, left)
    assert {(r.name_lc, r.uuid) for r in found.collect()} == {("park", "1"), ("park", "2"), ("annabel lee of the sea", "3")}


def test_similarity_is_exact(spark):
    import itertools, random

    r = random.Random(4)
    words = ["".join(r.choice("abc ") for _ in range(r.randint(1, 14))) for _ in range(120)]
    rows = spark.createDataFrame([("g", str(i), w, datetime(2020, 1, 1)) for i, w in enumerate(words)], "group_id string, uuid string, name string, created_at timestamp")
    sh = lambda w: {w[i : i + 3] for i in range(max(1, len(w) - 2))}
    sh = lambda w, s=sh: s(" ".join([""] * 0) + __import__("re").sub(r"\s+", " ", w.lower()))
    want = {}
    for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2):
        s = len(sh(a) & sh(b)) / len(sh(a) | sh(b))
        if s >= 0.5:
            want[str(i)] = min(want.get(str(i), (0, "")), (-s, str(j)))
    got = {x.provisional_uuid: (-x.similarity, x.uuid) for x in resolve.similar_matches(rows, rows, 0.5).collect()}
    assert got == want


def test_edges(spark):
    nodes = spark.createDataFrame([("g", "e", i, u, t) for i, (u, t) in enumerate([("a", "Person"), ("b", "Person"), ("c", "Place")])], "group_id string, episode_uuid string, pos int, uuid string, type string")
    rec = spark.createDataFrame([("g", "e", 0, 1, "knows", "f", "", None), ("g", "e", 0, 2, "knows", "f", "", None), ("g", "e", 0, 9, "knows", "f", "", None), ("g", "e", 1, 1, "knows", "f", "", None), ("g", "e", 0, 2, "Visits", "f", "2020-02-01T00:00:00Z", "2020-01-01T00:00:00Z")], "group_id string, episode_uuid string, source_pos int, target_pos int, relation string, fact string, valid_at string, invalid_at string")
    built = edges.build(rec, nodes, edges.rules(spark))
    assert {(r.source_uuid, r.target_uuid, r.name) for r in built.collect()} == {("a", "b", "KNOWS"), ("a", "c", "RELATES_TO")}
    assert edges.all_pairs(nodes).count() == 3
    old = spark.createDataFrame([("g", "a", "b", "KNOWS", "u1", "old fact", ["z"])], "group_id string, source_uuid string, target_uuid string, name string, uuid string, fact string, episodes array<string>")
    got = {(r.target_uuid): (r.uuid, r.fact, r.episodes, r.status) for r in edges.merge(old, built).collect()}
    assert got == {"b": ("u1", "old fact", ["e", "z"], "merged"), "c": (None, "f", ["e"], "new")}
    row = spark.sql("select map('a','1','b','2') o, map('b',cast(null as string),'c','3') n").select(edges.merge_attributes(F.col("o"), F.col("n")).alias("x"))
    assert row.first().x == {"a": "1", "b": "2", "c": "3"}


def test_state(spark):
    ev = [("g", "1", 1, "enqueue"), ("g", "1", 2, "fail"), ("g", "1", 3, "fail"), ("g", "1", 4, "fail"), ("g", "2", 1, "fail"), ("g", "2", 2, "ok"), ("g", "3", 1, "ok"), ("g", "3", 2, "fail")]
    rows = spark.createDataFrame([(g, e, datetime(2024, 1, 1), s, x) for g, e, s, x in ev], "group_id string, episode_uuid string, ts timestamp, seq int, event string")
    s = state.replay(rows)
    assert {r.episode_uuid: (r.status, r.retry_count) for r in s.collect()} == {"1": ("dead", 3), "2": ("done", 0), "3": ("pending_nodes", 1)}
    ep = spark.createDataFrame([("g", "1", datetime(2024, 1, 1)), ("g", "3", datetime(2023, 1, 1))], "group_id string, uuid string, valid_at timestamp")
    none = spark.createDataFrame([], "group_id string, episode_uuid string")
    again = state.revive_dead(s, ep, none)
    assert [r.episode_uuid for r in state.pending(again, ep).collect()] == ["1", "3"]
    assert [r.episode_uuid for r in state.without_entries(s, ep).collect()] == ["2"]
    q = spark.createDataFrame([("g", i, str(i)) for i in range(5)], "group_id string, seq int, entity_uuid string")
    taken, left = state.pop(q, 2)
    assert [r.seq for r in taken.orderBy("seq").collect()] == [0, 1] and left.count() == 3
    control = spark.createDataFrame([("g", None, None, None, None)], "group_id string, active_uuid string, model_state string, inference_enabled boolean, blocked boolean")
    snap = state.snapshot(again, ep, control).first()
    assert (snap.pending_count, snap.model_state, snap.inference_enabled, snap.retry_count) == (2, "idle", True, 0)


def test_metrics(spark):
    e = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", None), ("3", None)], "k string, item string")
    p = spark.createDataFrame([("1", "a"), ("1", "c"), ("1", "c"), ("3", "x")], "k string, item string")
    got = {r.k: (r.correct, r.missing, r.extra, r.f1) for r in metrics.set_scores(e, p, "k", "item").collect()}
    assert got == {"1": (1, 1, 1, 0.5), "2": (0, 0, 0, 1.0), "3": (0, 0, 1, 0.0)}
    assert metrics.mean_score(e.where("false").withColumn("s", F.lit(1.0)), "s").first()[0] == 0.0
    parts = metrics.split_tail(spark.range(25), "id").groupBy("part").count().collect()
    assert dict((r.part, r["count"]) for r in parts) == {"training": 23, "validation": 2}
    with pytest.raises(Exception, match="too few"):
        metrics.split_tail(spark.range(1), "id").collect()
    row = spark.sql("select '{\"score\": 1.7}' a, 'broken' b").select(metrics.judge_score(F.col("a")).alias("a"), metrics.judge_score(F.col("b")).alias("b"))
    assert tuple(row.first()) == (1.0, 0.0)
    facts = [("", "I", "x"), (" the narrator met Bo", "i", "Bo"), ("Bo likes tea, indicating a habit", "Bo", "I"), ("I like tea", "I", "tea"), ("Bo gave me tea", "Bo", "I"), ("the narrator likes tea", "Bo", "tea"), (None, None, None)]
    df = spark.createDataFrame(facts, "f string, a string, b string")
    got = [r[0] for r in df.select(metrics.fact_issues(F.col("f"), F.col("a"), F.col("b"), F.lit(True))).collect()]
    assert got == [["empty"], ["third person"], ["no first person", "analysis"], [], [], [], ["empty"]]


def test_panel(spark):
    walks = {
        "a": [("show", "pending_nodes", None, None), ("status_pending_edges_or_done", "pending_edges", None, None), ("status_pending_edges_or_done", "done", None, True)],
        "b": [("show", None, False, None), ("cache_empty", None, None, None), ("inference_enabled", "done", None, True), ("user_deleted_entity", None, None, False)],
        "c": [("hide", None, None, None), ("cache_entities_found", None, None, None), ("user_deleted_entity", None, None, True), ("episode_closed", None, None, None), ("show", None, None, None)],
        "d": [("inference_disabled", None, None, None), ("show", None, None, None), ("status_pending_nodes", None, None, None), ("unheard of", None, None, None)],
    }
    rows = [(k, i, *e) for k, events in walks.items() for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "key string, seq int, event string, status string, enabled boolean, present boolean")
    got = {r.key: (r.state, r.status) for r in state.panel_states(df).collect()}
    assert got == {"a": ("ready_entities", "done"), "b": ("empty_idle", None), "c": ("ready_entities", None), "d": ("disabled", None)}


def test_hot_keys_join(spark):
    from marginalia.operators.skew import salted_lookup

    facts = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(0, 4500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = salted_lookup(facts, lookup, ["k"], hot_rows=100)
    assert got.count() == 4500 and got.where("w <> 2 * k").count() == 0
    assert salted_lookup(facts, lookup, ["k"], "left", hot_rows=100).count() == 5000


def test_paths_of_any_length(spark):
    chain = [(i, i, i + 1) for i in range(8)]
    paths = lambda edges, a, b: sorted(tuple(r) for r in graph.path_lengths(spark.createDataFrame(edges, "id int, src int, dst int"), a, b).collect())
    # A parallel edge, a ring (1 to 4 and back), a dead end.
    assert paths([*chain, (50, 0, 1), (51, 4, 1), (52, 1, 4), (53, 3, 99)], 0, 8) == [(6, 2), (8, 2), (10, 4)]
    assert paths([(None, 1, None)], 1, 2) == []
