import itertools
from collections import Counter

from hypothesis import given, settings, strategies as st

from marginalia.llm.pack import fullest, pack, plan_patterns
from marginalia.llm.tokens import encoder, token_count


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=6), st.integers(20, 40))
def test_fullest_is_optimal(counts, capacity):
    chosen = fullest(counts, capacity)
    assert all(n <= counts[s] for s, n in chosen.items()) and chosen[max(counts)] >= 1
    rest = Counter(counts)
    rest[max(counts)] -= 1
    best = max(sum(s * n for s, n in zip(rest, take)) for take in itertools.product(*(range(n + 1) for n in rest.values())) if sum(s * n for s, n in zip(rest, take)) <= capacity - max(counts))
    assert sum(s * n for s, n in chosen.items()) == max(counts) + best


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_patterns_use_every_item_once(counts):
    used = Counter()
    for pattern, times in plan_patterns(counts, 30):
        assert sum(s * n for s, n in pattern.items()) <= 30
        for s, n in pattern.items():
            used[s] += n * times
    assert used == Counter(counts)


def test_table(spark):
    sizes = [0, None, 3, 3, 7, 10, 25, 10, 4, 6, 1, 1]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)] + [(None, 3, "")], "doc_id bigint, tokens bigint, container_no string")
    rows = pack(df, "doc_id", "tokens", "box", 10).collect()
    load = Counter()
    for r in rows:
        load[r.container_no] += r.tokens
    assert max(load.values()) <= 10 and sum(load.values()) == sum(s for s in sizes if s)
    assert len({c for c, n in load.items() if n}) == 7  # 70 tokens, no better is possible
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
    assert sorted(per[6]) == [(0, 10), (10, 20), (20, 25)] and per[0] == [(0, 0)] and 1 not in per
    assert all(sorted(p)[-1][1] == sizes[d] for d, p in per.items())
    assert pack(df.limit(0), "doc_id", "tokens", "box", 10).count() == 0


def test_one_size_shared_by_all(spark):
    df = spark.range(1000).selectExpr("id doc_id", "4L tokens")
    rows = pack(df, "doc_id", "tokens", "box", 10).groupBy("container_no").count().collect()
    assert Counter(r["count"] for r in rows) == {2: 500}


def test_tokens(spark):
    texts = ["", "Hello world", "<|endoftext|> é 漢字 😀", None, "a" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", token_count(df["t"]).alias("n")).collect()}
    assert got == {i: None if t is None else len(encoder().encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(encoder().decode(encoder().encode_ordinary(t)) == t for t in texts if t)
