import numpy as np
from pyspark.sql import functions as F

from marginalia.operators.search import cosine_top
from marginalia.plans.entries import cosine_topk
from marginalia.session import table


def nearest(vectors, queries, k):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in vectors.items() if v and np.linalg.norm(v) > 0}
    best = {q: sorted((-round(float((unit[q] * u).sum()), 12), i) for i, u in unit.items() if i != q)[:k] for q in queries if q in unit}
    return {(q, i, round(-s, 5)) for q, found in best.items() for s, i in found}


def test_cosine_topk_against_brute_force(spark, data):
    vectors = {r.vec_id: r.embedding for r in table(spark, data, "embeddings").collect()}
    got = {(r["query"], r.vec_id, r.similarity) for r in cosine_topk(spark, data).collect()}
    assert got == nearest(vectors, [i for i in vectors if i % 50 == 0], 5) and len({q for q, _, _ in got}) == 10


def test_ties_go_to_the_smaller_key(spark):
    vectors = {i: [1.0, 2.0, 3.0] for i in range(40, 0, -1)} | {0: [3.0, 2.0, 1.0], 41: [0.0, 0.0, 0.0], 42: [], 43: None}
    rows = spark.createDataFrame(list(vectors.items()), "id bigint, v array<float>").coalesce(1)
    got = cosine_top(rows.where("id IN (0, 7, 41, 42, 43)"), rows, "id", "v", 3).withColumn("similarity", F.round("similarity", 5))
    assert {tuple(r) for r in got.collect()} == nearest(vectors, [0, 7], 3)
