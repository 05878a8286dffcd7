import pytest
from pyspark.sql import functions as F

from marginalia.llm.mix import HELD, mixture, shares

SCHEMA = "doc bigint, tokens bigint, source string, text string"
TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("none", 0.05, 4)]


def docs(spark):
    words = {"a": "apple pear plum", "b": "iron steel zinc", "c": "sea lake pond"}
    rows = [(i, 10 + i % 7, s, f"{words[s]} {i % 5}") for i, s in enumerate("a" * 600 + "b" * 300 + "c" * 40)]
    rows += [(5000 + i, 12, None, "steel zinc iron") for i in range(30)] + [(9000, 0, "a", ""), (9001, None, "a", None), (9002, 5, "other", "pond lake sea")]
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_are_reached(spark):
    mixed = mixture(docs(spark), TARGETS)
    assert mixed.where("copies > rate + 1 OR copies < 0").count() == 0
    got = {r.source: r for r in shares(mixed, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")).collect()}
    for s, share, cap in TARGETS[:3]:
        assert got[s].reached_share == pytest.approx(share / 0.95, abs=0.02) and got[s].most_copies <= cap
    assert got["none"].reached_share == 0 and got["none"].texts == 0
    by_word = {r.doc: r.member_of for r in mixed.where("doc >= 5000").collect()}
    assert set(by_word) == {*range(5000, 5030), 9002} and {by_word[d] for d in range(5000, 5030)} == {"b"} and by_word[9002] == "c"


def test_nothing_to_mix(spark):
    assert mixture(docs(spark).where("source = 'zzz'"), TARGETS).count() == 0


def test_held_texts_count_in_the_end(spark):
    held = spark.range(1000, 2000).where(F.pmod(F.xxhash64("id"), F.lit(HELD)) == 0).first().id
    rows = [(i, 10, "a", "apple pear plum") for i in range(200)] + [(held, 10, "b", "iron steel zinc"), (5000, 10, None, "zinc iron steel " * 6)]
    mixed = mixture(spark.createDataFrame(rows, SCHEMA), [("a", 0.5, 1), ("b", 0.5, 5)])
    assert mixed.where("doc = 5000").first().member_of == "b"
