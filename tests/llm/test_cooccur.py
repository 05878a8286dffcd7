import itertools
import math
import random
from collections import Counter

import pytest

from marginalia.llm import cooccur

SCHEMA = "g string, e string, x string, item string, n bigint"


def brute(rows, least):
    sets = {}
    for g, e, x in {r[:3] for r in rows if None not in r[:3]}:
        sets.setdefault((g, e), set()).add(x)
    single, double, total = Counter(), Counter(), Counter()
    for (g, _), xs in sets.items():
        total[g] += 1
        single.update((g, x) for x in xs)
        double.update((g, a, b) for a, b in itertools.combinations(sorted(xs), 2))
    return {k: (n, single[k[0], k[1]], single[k[0], k[2]], total[k[0]]) for k, n in double.items() if n >= least}


def rows_of(seed, baskets, most):
    r = random.Random(seed)
    rows = [(f"g{b % 2}", f"e{b}", f"x{r.randrange(25)}", "clash", 1) for b in range(baskets) for _ in range(r.randint(1, most))]
    return rows + rows[:20] + [("g0", None, "x1", "", 0), ("g0", "e1", None, "", 0), (None, "e1", "x1", "", 0)]


@pytest.mark.parametrize("least", [1, 5])
@pytest.mark.parametrize("block", [4, 256])
def test_against_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(cooccur, "BLOCK", block)
    monkeypatch.setattr(cooccur, "GIANT", 8)
    monkeypatch.setattr(cooccur, "HOT", 5 if block == 4 else 200_000)  # stripes of hot items in more segments
    rows = rows_of(3, 60, 14)
    got = cooccur.cooccurrence(spark.createDataFrame(rows, SCHEMA), "g", "e", "x", least).collect()
    assert {(r.g, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == brute(rows, least)
    for r in got:
        assert r.lift == pytest.approx(r.n_ab * r.n / (r.n_a * r.n_b))


def test_likelihood_ratio(spark):
    rows = [("g", f"e{i}", x, "", 0) for i in range(20) for x in (["a", "b"] if i < 8 else ["a"] if i < 10 else ["c"])]
    got = {(r.item_a, r.item_b): r.llr for r in cooccur.cooccurrence(spark.createDataFrame(rows, SCHEMA), "g", "e", "x").collect()}
    k = [[8, 2], [0, 10]]
    want = 2 * sum(k[i][j] * math.log(k[i][j] * 20 / (sum(k[i]) * (k[0][j] + k[1][j]))) for i in (0, 1) for j in (0, 1) if k[i][j])
    assert got == {("a", "b"): pytest.approx(want)}


def test_empty(spark):
    assert cooccur.cooccurrence(spark.createDataFrame([], SCHEMA), "g", "e", "x", 5).count() == 0
