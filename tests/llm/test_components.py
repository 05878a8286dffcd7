import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import components as C
from marginalia.llm.components import canonical_uuid, connected_components, match_groups

U = "6f30404a-b159-433d-8c9a-f57052e4f3b6"


@pytest.mark.parametrize("text", [U, U.upper(), f" {U}\t", f"{{{U}}}", f"urn:uuid:{U}", U.replace("-", "")])
def test_notations(spark, text):
    assert spark.range(1).select(canonical_uuid(F.lit(text)).alias("x")).first().x == U


@pytest.mark.parametrize("text", ["", " ", "abc", U[:-1], U + "0", None])
def test_no_uuid(spark, text):
    assert spark.range(1).select(canonical_uuid(F.lit(text).cast("string")).alias("x")).first().x is None


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in links:
        if s and a and b and a != b:
            ra, rb = find((s, a)), find((s, b))
            parent[max(ra, rb)] = min(ra, rb)
    return {(s, a, find((s, a))[1]) for s, a in parent}


def solve(spark, links):
    rows = spark.createDataFrame(links, "g string, a string, b string").withColumn("v", F.lit("clash"))
    return {tuple(r) for r in connected_components(rows, "g", "a", "b").collect()}


def shapes():
    r = random.Random(2)
    chain = [("g", f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    ring = [("g", f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    star = [("h", "s", f"s{i}") for i in range(40)]
    dense = [("h", f"d{i}", f"d{j}") for i in range(6) for j in range(i)]
    lasso = [("g", "l0", "l1"), ("g", "l1", "l2"), ("g", "l2", "l0"), ("g", "l2", "l3"), ("g", "l3", "l4")]
    loose = [("k", f"x{r.randrange(80)}", f"x{r.randrange(80)}") for _ in range(90)]
    odd = [("g", None, "c000"), (None, "a", "b"), ("g", "self", "self"), ("g", "c001", "c000"), ("g", "c000", "c001")]
    return chain + ring + star + dense + lasso + loose + odd


def test_all_shapes_against_brute_force(spark):
    assert solve(spark, shapes()) == brute(shapes())


def test_core_solver(spark):
    r = random.Random(9)
    links = [("g", f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(200)]
    assert solve(spark, links) == brute(links)


def test_empty(spark):
    assert solve(spark, []) == set() and solve(spark, [("g", "a", "a"), ("g", None, "b")]) == set()


def test_same_uuid_in_two_journals(spark):
    a, b, c = (U[:-1] + x for x in "123")
    pairs = spark.createDataFrame([("g", a.upper(), b, None), ("h", a, c, 0.5), ("g", a, "", 0.1)], "group_id string, node_uuid string, canonical_uuid string, similarity double")
    maps = spark.createDataFrame([("g", {b: c, c: c}), ("g", None), ("g", {})], "group_id string, uuid_map map<string,string>")
    assert {tuple(x) for x in match_groups(pairs, maps).collect()} == {("g", a, a), ("g", b, a), ("g", c, a), ("h", a, a), ("h", c, a)}


def test_keys_that_collide_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(C, "KEY_BITS", 12)
    links = [("g", f"{c:03d}-{i}", f"{c:03d}-{i + 1}") for c in range(80) for i in range(3)]
    got = C.connected_components(spark.createDataFrame(links, "g string, a string, b string"), "g", "a", "b").collect()
    assert {(r.id, r.root_id) for r in got} == {(f"{c:03d}-{i}", f"{c:03d}-0") for c in range(80) for i in range(4)}
