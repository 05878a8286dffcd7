import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import names as N
from marginalia.session import Scratch

PEOPLE = {
    "ann": ["Elizabeth Zinquar", "Betty Zinquar", "Zinquar, Elizabeth", "elizabeth zinquar", "Elizabteh Zinquar", "E. Zinquar", "Elizabeth S. Zinquar", "Elizabeth Zinquar's", "ElizabethZinquar"],
    "kla": ["Klaus Zinquar", "Klaus  Zinquar", "K. Zinquar"],
    "hud": ["Christopher Hudkelpra", "Dr. Hudkelpra", "Hudkelpra Christopher", "Christopher Hudklepra", "Chr. Hudkelpra"],
    "ren": ["René Taslem", "Rene Taslem", "René"],
}
THINGS = {
    "pool": ["Amber Swimming Pool", "the Amber Swimming Pool", "Swimming Pool, Amber", "Amber Swimmming Pool"],
    "club": ["Juniper Terrace Cycling Club", "J.T.C.C.", "Juniper Terrace", "JUNIPER TERRACE CYCLING CLUB"],
    "mus": ["Aspen Museum", "Aspen Mus."],
}
LONE = ["Zinquar", "Mary Other", "Damson Swimming Pool"]


def frame(spark):
    rows = [("g", n, 1) for ns in PEOPLE.values() for n in ns] + [("g", n, 2) for ns in THINGS.values() for n in ns]
    rows += [("g", "Zinquar", 1), ("g", "Mary Other", 1), ("g", "Damson Swimming Pool", 2), ("h", "Klaus Zinquar", 1)]
    rows += [("g", n, 1) for n in (None, "", " ", "x", "I", "living room", "attic")] + [("g", "bouldering", 4), ("g", "boulderin", 4), (None, "Klaus Zinquar", 1), ("g", "Klaus Zinquar", None), ("g", "y" * 5000, 1)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "group_id string, name string, entity_type_id int, scope string")


def test_variants(spark):
    got = {tuple(r) for r in N.variant_pairs(N.link_names(frame(spark))).collect()}
    want = {("g", a, b) for ns in [*PEOPLE.values(), *THINGS.values()] for a in ns for b in ns if a < b}
    assert got == want


def test_empty(spark):
    assert N.variant_pairs(N.link_names(frame(spark).limit(0))).count() == 0


@pytest.mark.parametrize(("cell", "block"), [(10, 2000), (10_000, 2000), (30, 20)])
def test_radius_join_is_complete(spark, monkeypatch, cell, block):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PIVOTS", 6)
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randint(3, 8))) for _ in range(150)} | {"".join(r.choice("abcdefghijkl") for _ in range(r.randint(20, 26))) for _ in range(60)}
    words |= {w[:4] + r.choice("xyz") + w[5:-1] for w in list(words) if len(w) > 15}  # two edits
    df = spark.createDataFrame([("s", w) for w in words] + [("t", w) for w in list(words)[:20]], "scope string, text string")
    rows = N.radius_join(df, Scratch(spark, "test")).collect()
    pairs = df.alias("p").join(df.alias("q"), F.expr("p.scope = q.scope AND p.text < q.text AND levenshtein(p.text, q.text) <= 2"))
    want = {tuple(x) for x in pairs.selectExpr("p.scope", "p.text", "q.text", "levenshtein(p.text, q.text)").collect()}
    assert {tuple(x) for x in rows} == want and len(rows) == len(want)


def test_slips(spark):
    yes = [("abcde", "abxde"), ("abcde", "abdce"), ("abcde", "bacde"), ("gregory jasigvenor", "gregori jasigvenar"), ("cordelia bartholomew", "cordelia barthalamew")]
    no = [("abcde", "axcye"), ("abcdefgh", "axcyefgh"), ("maria kelmunda", "marta felmunda"), ("anna kelmir lane", "anna kolmar lane")]
    pairs = [(x, y, True) for x, y in yes] + [(x, y, False) for x, y in no]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("d", F.levenshtein("a", "b"))
    whole = {(r.a, r.b): r.got for r in df.select("*", N.slip("a", "b", "d", F.lit(True)).alias("got")).collect()}
    assert [whole[x] for x in yes] == [True] * 5 and whole[no[0]] is whole[no[1]] is whole[no[3]] is False
    assert whole[no[2]] is True  # one slip in each of two words of a long text
    words = [r.got for r in df.where("a NOT LIKE '% %'").select(N.slip("a", "b", "d", F.lit(False)).alias("got")).collect()]
    assert words == [True, True, True, False, False]


@pytest.mark.parametrize("spellings", [("Quentin Jasgarfen", "Quentin G. Jasgarfen", "Quentin K. Jasgarfen"), ("Bartholomew Kel", "Barthalamew Kel"), ("Saint Winifred's Observatory", "Saint Winifred's Obsarvatery")])
def test_initials_and_two_slips_in_a_long_word(spark, spellings):
    rows = spark.createDataFrame([("g", n, 2 if "Saint" in n else 1) for n in spellings], "group_id string, name string, entity_type_id int")
    assert {tuple(r[1:]) for r in N.variant_pairs(N.link_names(rows)).collect()} == {(a, b) for a in spellings for b in spellings if a < b}


@pytest.mark.parametrize("spellings", [("ZULEIKA KORTORQUAR", "Zuleika Kortorqar"), ("ULRICH DRAHUD", "Ulrixh Drahud"), ("Heron Station", "Heorn Station"), ("Westering Bookshop", "Westernig Bookshop")])
def test_slip_in_letters_that_sound_alike(spark, spellings):
    kind = 2 if spellings[0].split()[-1].lower() in N.THINGS else 1
    rows = spark.createDataFrame([("g", n, kind) for n in spellings], "group_id string, name string, entity_type_id int")
    assert [sorted(r[1:]) for r in N.variant_pairs(N.link_names(rows)).collect()] == [sorted(spellings)]


@pytest.mark.parametrize("spellings", [("Greg0ry Jasigven", "Gregory Jasigvrn"), ("Gregroy Jasigven", "Gregory Jasigvrn"), ("Garnet Railway Brdg", "Garnet Railway Bridge"), ("Garmet Railwya Bridge", "Garnet Railway Bridge")])
def test_two_slips_in_two_words(spark, spellings):
    kind = 2 if "Garnet Railway Bridge" in spellings else 1
    rows = spark.createDataFrame([("g", n, kind) for n in (*spellings, "Maria Kelmun", "Marta Felmut")], "group_id string, name string, entity_type_id int")
    assert [sorted(r[1:]) for r in N.variant_pairs(N.link_names(rows)).collect()] == [sorted(spellings)]


def test_bare_words():
    assert N.spelled_out("brdg") == "bridge" and N.spelled_out("bridge") == "bridge" and N.spelled_out("brk") == "brk"
