"""Pairwise matches to groups: peel leaves, compress chains by list ranking, solve the core, restore the labels.

Vertices are pairs (scope, id) written into one 64-bit key; of vertices that share a hash all but one get another, so keys are
unique at any size. An edge joins two vertices of one scope. Each round

1. strips vertices of degree one (degrees are aggregated map-side before the shuffle, so a hub with a third of all
   edges is one partial aggregate a task);
2. ranks chains of degree-two vertices by pointer doubling over both directions and replaces each chain by one edge
   between its ends.

Rounds go on until one changes nothing: what is left has only vertices of degree three and more, and ends of chains smaller
than both neighbours. This core is solved by alternating large-star and small-star steps. Stripped vertices then get the label of what they hang on, newest round first.
Nothing but counts reaches the driver. Rounds are written to the shared checkpoint folder.

Defined results: null ends and self links are ignored; repeated links count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import salted_lookup
from ..session import Scratch

#: Bits of a vertex key; fewer only in tests.
KEY_BITS = 64
#: Rows of one key from which a join is salted.
HOT = 200_000


def canonical_uuid(text: Column) -> Column:
    """A uuid in any notation (upper case, braces, urn, no hyphens, blanks around it) as lower-case 8-4-4-4-12, else null."""
    bare = F.lower(F.regexp_replace(text, F.lit(r"(?iU)^\s+(?:urn:uuid:)?|^urn:uuid:|\s+$|[{}()-]"), F.lit("")))
    parts = lambda x: F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    # Bound once: as a lambda variable the cleaned text is not computed again for each of its parts.
    return F.get(F.transform(F.array(bare), lambda x: F.when(x.rlike("^[0-9a-f]{32}$"), parts(x))), F.lit(0))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("v"), F.col("w").alias("n")).unionAll(edges.select(F.col("w").alias("v"), F.col("u").alias("n")))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("w")]


def _strip(edges: DataFrame, disk: Scratch) -> tuple[DataFrame, DataFrame]:
    """(removed(v, parent), edges left). Of an edge between two leaves, the larger vertex is removed."""
    ends = _both_ways(edges).groupBy("v").agg(F.count("*").alias("deg"), F.min("n").alias("n"))
    leaves = disk.save(ends.where("deg = 1").select("v", "n"))
    smaller = leaves.where("v < n").select("v", "n")
    alone = leaves.where("v > n").select(F.col("n").alias("v"), F.col("v").alias("n"))
    kept = smaller.join(alone, ["v", "n"], "left_semi")
    removed = leaves.join(kept, ["v", "n"], "left_anti").select("v", F.col("n").alias("parent"))
    gone = leaves.select(*_ordered(F.col("v"), F.col("n")))
    return removed, edges.join(gone, ["u", "w"], "left_anti")


def _compress(edges: DataFrame, disk: Scratch) -> tuple[DataFrame | None, DataFrame]:
    """(removed(v, parent), edges left) after replacing chains of degree-two vertices by edges between their ends.

    A degree-two vertex smaller than both neighbours stays as an end, so closed chains have ends too; ids are hashes, so
    ends are dense in random chains, and pointer doubling covers long monotone ones: either way a chain of length L
    is gone after order log L passes. The state is one row a direction through a chain vertex: (v, came from, jump).
    """
    around = _both_ways(edges).groupBy("v").agg(F.count("*").alias("deg"), F.min("n").alias("a"), F.max("n").alias("b"))
    chain = disk.save(around.where("deg = 2 AND v > a").select("v", "a", "b"))
    if chain.isEmpty():
        return None, edges
    ways = F.array(F.struct(F.col("a").alias("prev"), F.col("b").alias("nxt")), F.struct(F.col("b").alias("prev"), F.col("a").alias("nxt")))
    steps = chain.select("v", F.explode(ways).alias("s")).select("v", "s.prev", "s.nxt")
    # The way (prev, v) leads to (v, nxt) and ends there if nxt is no chain vertex.
    inner = chain.select(F.col("v").alias("nxt"), F.lit(True).alias("more"))
    state = disk.save(steps.join(inner, "nxt", "left").select("v", "prev", F.col("v").alias("jv"), F.col("nxt").alias("jn"), F.coalesce("more", F.lit(False)).alias("more")))
    while not state.where("more").isEmpty():
        ahead = state.select(F.col("prev").alias("jv"), F.col("v").alias("jn"), F.col("jv").alias("jv2"), F.col("jn").alias("jn2"), F.col("more").alias("more2"))
        moved = state.where("more").join(ahead, ["jv", "jn"]).select("v", "prev", F.col("jv2").alias("jv"), F.col("jn2").alias("jn"), F.col("more2").alias("more"))
        state = disk.save(state.where("NOT more").unionAll(moved))
    ends = disk.save(state.groupBy("v").agg(F.min("jn").alias("u"), F.max("jn").alias("w")))
    bridges = ends.where("u <> w").select("u", "w").distinct()
    through = chain.select(F.explode(F.array(F.struct(*_ordered(F.col("v"), F.col("a"))), F.struct(*_ordered(F.col("v"), F.col("b"))))).alias("e")).select("e.u", "e.w")
    rest = edges.join(through, ["u", "w"], "left_anti")
    return ends.select("v", F.col("u").alias("parent")), rest.unionAll(bridges).distinct()


def _core(edges: DataFrame, disk: Scratch) -> DataFrame:
    """(v, root) by alternating large-star and small-star steps, until the edge set is a star forest and stays the same."""
    before = None
    while True:
        both = _both_ways(edges)
        least = both.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
        large = disk.save(salted_lookup(both.where("n > v"), least, ["v"]).select(*_ordered(F.col("n"), F.col("m"))).where("u <> w").distinct())
        low = large.groupBy("w").agg(F.min("u").alias("m"))
        small = salted_lookup(large, low, ["w"]).select(*_ordered(F.col("u"), F.col("m"))).unionAll(low.select(F.col("m").alias("u"), "w"))
        edges = disk.save(small.where("u <> w").distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("w").alias("v"), F.col("u").alias("root"))
        before = mark


def _key(*parts: Column) -> Column:
    key = F.xxhash64(*parts)
    return key if KEY_BITS == 64 else F.pmod(key, F.lit(1 << KEY_BITS))


def _keyed(pairs: DataFrame, disk: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``pairs(s, a, b)`` with the keys ka and kb of their ends, vertices (v, s, id)), each vertex with a key of its own.

    Vertices whose key another one has are drawn again; at 64 bits they are a handful among billions, mostly none.
    """
    pairs = disk.save(pairs.withColumns({"ka": _key("s", "a"), "kb": _key("s", "b")}))
    seed = 0
    while True:
        ends = F.explode(F.array(F.struct(F.col("ka").alias("v"), "s", F.col("a").alias("id")), F.struct(F.col("kb").alias("v"), "s", F.col("b").alias("id"))))
        names = pairs.select(ends.alias("x")).select("x.*")
        held = names.groupBy("v").agg(F.min(F.struct("s", "id")).alias("x"), F.max(F.struct("s", "id")).alias("y"))
        held = disk.save(held)
        shared = held.where("x <> y").select("v", "x")
        if shared.isEmpty():
            return pairs, held.select("v", "x.s", "x.id")
        seed += 1
        again = names.distinct().join(shared, "v").where(F.struct("s", "id") != F.col("x")).select("s", "id", _key("s", "id", F.lit(seed)).alias("k"))
        again = disk.save(again)
        for end in ("a", "b"):
            new = again.select("s", F.col("id").alias(end), F.col("k").alias("_k"))
            pairs = pairs.join(new, ["s", end], "left").withColumn(f"k{end}", F.coalesce("_k", f"k{end}")).drop("_k")
        pairs = disk.save(pairs)


def connected_components(links: DataFrame, scope: str, left: str, right: str) -> DataFrame:
    """(scope, id, root_id) for every id linked to another one; root_id is the smallest id of its group in its scope.

    ``links`` may have further columns and any number of copies of a link in either direction. Ids are strings; a
    vertex is its (scope, id) pair, held as a 64-bit key during the rounds.
    """
    disk = Scratch(links.sparkSession, "components")
    clean = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(scope).isNotNull() & (F.col(left) != F.col(right)))
    pairs = clean.select(F.col(scope).alias("s"), F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
    pairs, names = _keyed(pairs, disk)
    edges = disk.save(pairs.select(*_ordered(F.col("ka"), F.col("kb"))).distinct())
    count, removed = edges.count(), []
    while count:
        for step in (_strip, _compress):
            gone, edges = step(edges, disk)
            if gone is not None:
                removed.append(gone)
                edges = disk.save(edges)
        now = edges.count()
        if now == count:
            break
        count = now
    roots = _core(edges, disk) if count else None
    # Salted look-ups only where some vertex is hot: one number decides, taken over all edges.
    top = pairs.select(F.explode(F.array("ka", "kb")).alias("v")).groupBy("v").count().agg(F.max("count")).first()[0] or 0
    lookup = salted_lookup if top > HOT else lambda facts, found, keys: facts.join(found, keys)

    gone = None
    for part in removed:
        gone = part.select("v") if gone is None else gone.unionAll(part.select("v"))
    labels = names.select("v", F.col("v").alias("root"))
    if gone is not None:
        labels = labels.join(gone, "v", "left_anti")
    if roots is not None:
        labels = labels.join(roots.withColumnRenamed("root", "core"), "v", "left").select("v", F.coalesce("core", "root").alias("root"))
    labels = disk.save(labels)
    for part in reversed(removed):
        hung = lookup(part.withColumnRenamed("v", "child"), labels.withColumnRenamed("v", "parent"), ["parent"])
        labels = disk.save(labels.unionAll(hung.select(F.col("child").alias("v"), "root")))

    named = names.join(labels, "v").select("s", "id", "root")
    smallest = named.groupBy("root").agg(F.min("id").alias("root_id"))
    out = disk.save(salted_lookup(named, smallest, ["root"]).select(F.col("s").alias(scope), "id", "root_id"), keep=True)
    disk.clean()
    return out


def match_groups(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """(group_id, uuid, root_uuid) over ``duplicate_pairs`` rows and the entries of ``uuid_map``, all uuids canonical."""
    from_pairs = pairs.select("group_id", canonical_uuid(F.col("node_uuid")).alias("a"), canonical_uuid(F.col("canonical_uuid")).alias("b"))
    from_maps = maps.select("group_id", F.explode("uuid_map").alias("k", "m")).select("group_id", canonical_uuid(F.col("k")).alias("a"), canonical_uuid(F.col("m")).alias("b"))
    out = connected_components(from_pairs.unionByName(from_maps), "group_id", "a", "b")
    return out.select("group_id", F.col("id").alias("uuid"), F.col("root_id").alias("root_uuid"))
