import json
import zipfile

from pyspark.sql import functions as F

from marginalia.sources import importing
from marginalia.sources.snapshot import SnapshotStore
from marginalia.streaming import queue


def test_files(spark, tmp_path):
    (tmp_path / "2024-03-05.txt").write_text("hello")
    (tmp_path / "note with space.md").write_text("dated by change")
    (tmp_path / "blank.txt").write_text("  \n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "rich.rtf").write_text(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \b bold\b0\par next " + chr(92) + "u8364?}")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / ".dir").mkdir()
    (tmp_path / ".dir" / "a.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.TXT").write_text("deep")
    (tmp_path / "link.txt").symlink_to(tmp_path / "2024-03-05.txt")
    rows = {r.path.rsplit("/", 1)[1]: r for r in importing.read_files(spark, str(tmp_path), date_format="%Y-%m-%d", zone="Europe/Berlin").collect()}
    assert set(rows) == {"2024-03-05.txt", "note with space.md", "bad.txt", "rich.rtf", "deep.TXT"}
    assert str(rows["2024-03-05.txt"].entry_time) == "2024-03-04 23:00:00" and rows["2024-03-05.txt"].warning is None
    assert rows["note with space.md"].warning and rows["bad.txt"].error and rows["bad.txt"].content is None
    assert rows["rich.rtf"].content == "Café bold\nnext €"
    assert importing.rtf_text(r"{\rtf1{\*\generator X;}a\uc2\u8364 ??b\{\}\\\'e9\~\emdash c{\info{\title no}}\line d\bin3 {{{e}") == "a€b{}\\é\u00a0—c\nde"
    assert len(importing.list_files(str(tmp_path), [".txt"], recursive=False)) == 3
    assert importing.read_files(spark, str(tmp_path / "sub" / "none")).count() == 0


def test_dayone(spark, tmp_path):
    entries = {"entries": [{"uuid": "6F30404AB159433D8C9AF57052E4F3B6", "text": r"Wow\! ![](dayone-moment://1)", "creationDate": "2024-01-01T10:00:00Z", "timeZone": "Europe/Paris"}, {"uuid": "A" * 32, "text": " ", "creationDate": "2024-01-01T10:00:00Z"}, {"uuid": "B" * 32, "text": "b", "creationDate": "2024-01-02T10:00:00Z", "timeZone": "No/Where"}]}
    plain, packed = tmp_path / "j.json", tmp_path / "j.zip"
    plain.write_text(json.dumps(entries))
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("Journal.json", plain.read_text())
    for path in (plain, packed):
        rows = importing.read_dayone(spark, str(path), ["Europe/Paris"]).orderBy("entry_time").collect()
        assert [(r.content.strip(), r.zone, r.uuid) for r in rows] == [("Wow!", "Europe/Paris", "6F30404A-B159-433D-8C9A-F57052E4F3B6"), ("b", "UTC", "BBBBBBBB-BBBB-BBBB-BBBB-BBBBBBBBBBBB")]


def test_xml(spark, tmp_path):
    f = tmp_path / "blog.xml"
    f.write_text("<Blog><post>early</post><date>05,March,2024</date><post>one & two\x01</post><post> </post><post>three &lt;3</post><date>06,March,2024</date><post/><post>four caf&#233; &#x20AC; &amp;#233;</post></Blog>")
    rows = importing.read_xml(spark, str(f), "Europe/Berlin").orderBy("entry_time", "content").collect()
    assert [(r.content, str(r.entry_time)) for r in rows] == [("one & two", "2024-03-04 23:00:00"), ("three <3", "2024-03-04 23:00:00"), ("four café € &#233;", "2024-03-05 23:00:00")]
    assert len({r.uuid for r in rows}) == 3


def test_load(spark):
    have = spark.createDataFrame([("j", "1", "n", "c", None)], "group_id string, uuid string, name string, content string, valid_at timestamp")
    new = spark.sql("select * from values ('x', timestamp'2024-11-05', '1'), ('y', timestamp'2024-11-05', '2'), ('y', timestamp'2024-11-06', '2'), (' ', timestamp'2024-11-05', '3') as t(content, entry_time, uuid)")
    after, report = importing.load_entries(have, new, "j")
    assert tuple(report.first()) == (1, 2, 1) and after.count() == 2
    assert after.where("uuid = '2'").first().name == "Tuesday Nov 5, 2024"
    assert tuple(importing.load_entries(have, new, "j", dry_run=True)[1].first()) == (2, 1, 1)
    assert tuple(importing.load_entries(after, new, "j")[1].first()) == (0, 3, 1)
    bare = spark.sql("select * from values ('x', timestamp'2024-11-05', string(null)), ('x', timestamp'2024-11-05', null), ('z', null, null) as t(content, entry_time, uuid)")
    once, report = importing.load_entries(have, bare, "j")
    assert tuple(report.first()) == (3, 0, 0) and once.where("uuid IS NULL").count() == 0 and once.select("uuid").distinct().count() == 4
    assert tuple(importing.load_entries(once, bare, "j")[1].first()) == (0, 3, 0)


def test_java_pattern():
    assert importing.java_pattern("%Y-%m-%d") == "yyyy-MM-dd"
    assert importing.java_pattern("day %d") == "'d''a''y' dd"


def test_snapshots(spark, tmp_path, monkeypatch):
    from marginalia.sources import snapshot

    store = SnapshotStore(spark, str(tmp_path))
    assert store.version("t") is None and store.batch() is None
    store.write("t", spark.createDataFrame([("007", 1)], "group_id string, x int"), "1")
    store.write("t", spark.createDataFrame([("007", 2), ("2024", 3)], "group_id string, x int"), "2")
    assert store.write("t", spark.createDataFrame([("g", 9)], "group_id string, x int"), "2") is False
    assert sorted(tuple(r) for r in store.read("t").collect()) == [("007", 2), ("2024", 3)]
    monkeypatch.setattr(snapshot, "FOLDERS", 2)
    for n in (3, 4, 5):  # a new column, folders put together
        store.commit(str(n), more={"t": spark.createDataFrame([("g", n, "y")], "group_id string, x int, y string"), "u": spark.createDataFrame([], "z int")})
    assert store.read("t").columns == ["group_id", "x", "y"] and sorted(r.x for r in store.read("t").collect()) == [2, 3, 3, 4, 5] and store.read("u").count() == 0
    store.reset({"u": spark.createDataFrame([(1,)], "z int")}, "6")
    assert store.read("t").count() == 0 and store.read("u").count() == 1


def test_ingest_survives_a_failure_between_tables(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    schema = "group_id string, uuid string, content string"
    linked = lambda new: {"mentions": new.select("group_id", F.col("uuid").alias("episode_uuid"), F.length("content").alias("n"))}
    broken = lambda new: {"mentions": new.select(F.raise_error(F.lit("lost")).alias("group_id"))}
    first = spark.createDataFrame([("007", "1", "a"), ("007", "1", "b"), ("007", None, "c"), ("h", "1", "ddd")], schema)
    try:
        queue.ingest(store, broken)(first, 0)
    except Exception as problem:
        assert "lost" in str(problem)
    assert store.batch() is None
    for number, batch in ((0, first), (0, first), (1, spark.createDataFrame([("007", "1", "zz"), ("007", "2", "ee")], schema)), (2, spark.createDataFrame([], schema))):
        queue.ingest(store, linked)(batch, number)
    assert sorted(tuple(r) for r in store.read("episodes").collect()) == [("007", "1", "a"), ("007", "2", "ee"), ("h", "1", "ddd")]
    assert sorted(tuple(r) for r in store.read("mentions").collect()) == [("007", "1", 1), ("007", "2", 2), ("h", "1", 3)]


def test_stream_equals_batch(spark, tmp_path):
    from marginalia.operators.state import replay

    schema = "group_id string, episode_uuid string, ts timestamp, seq int, event string"
    rows = [("g", str(i % 5), f"2024-01-01 00:00:{i:02d}", i, ["enqueue", "fail", "fail", "ok", "fail", "fail", "fail"][i * 3 % 7]) for i in range(40)]
    everything = spark.createDataFrame(rows, "group_id string, episode_uuid string, ts string, seq int, event string").withColumn("ts", F.col("ts").cast("timestamp"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for part in range(2):
        everything.where((F.col("seq") >= part * 20) & (F.col("seq") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        queue.run_to_end(queue.retry_states(stream), queue.keep_latest(store, "state"), str(tmp_path / "ck"))
    want = {(r.episode_uuid, r.status, r.retry_count) for r in replay(everything).collect()}
    assert {(r.episode_uuid, r.status, r.retry_count) for r in queue.latest(store, "state").collect()} == want
