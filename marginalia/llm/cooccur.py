"""Items that appear together: stripes and a log-likelihood ratio.

Each basket sends every item the list of its later neighbours; a task merges these lists into one associative array
(a stripe) per item before anything is shuffled, and the stripes of one item are merged by key afterwards. A stripe is
cut into segments by a hash of the neighbour, so the stripe of an item found in a third of all baskets is spread over
many tasks and no task holds an unbounded array.

Defined results: null items or baskets are ignored, repeated rows count once, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import salted_lookup
from ..session import Scratch

#: Segments a stripe is cut into, by a hash of the neighbour; an item in more than ``HOT`` baskets gets as many more as it is hotter.
SEGMENTS, HOT = 8, 200_000
#: Items counted as hot at most: with more of them, only those above a share of 1 / ``HOT_ITEMS`` of all rows are.
HOT_ITEMS = 10_000
#: Items of one block of a basket; a larger basket is handled as pairs of blocks.
BLOCK = 256
#: A basket above this size may be left out of pair building and be looked up instead (see ``cooccurrence``).
GIANT = 2_000
STRIPE = "scope string, item string, segment int, neighbours array<string>, counts array<bigint>"


def _blocks(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scope, left items, right items): each unordered pair of a basket lies in exactly one row (left < right).

    Items get a block number by hash, so a basket of any size is rows of at most a few blocks and never one long list.
    Baskets of one block stay whole.
    """
    sized = salted_lookup(sets, sizes, ["scope", "basket"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    parts = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    # Block b meets blocks 0..b: its list is sent once for each partner.
    partner = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    )
    spread = parts.select("scope", "basket", "item", "block", F.explode(partner).alias("p")).select("scope", "basket", "item", "block", "p.lo", "p.hi")
    return spread.groupBy("scope", "basket", "lo", "hi").agg(
        F.sort_array(F.collect_list(F.when(F.col("block") == F.col("lo"), F.col("item")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("block") == F.col("hi"), F.col("item")))).alias("b"),
    )


def _pairs_of(frame: pd.DataFrame) -> pd.DataFrame:
    """Every (scope, item, neighbour) of a batch of block rows with how often it occurs in the batch."""
    scope, left, right = [], [], []
    for s, lo, hi, a, b in zip(frame["scope"], frame["lo"], frame["hi"], frame["a"], frame["b"], strict=True):
        if lo == hi:
            if len(a) < 2:
                continue
            i, j = np.triu_indices(len(a), 1)
            x, y = np.asarray(a, object)[i], np.asarray(a, object)[j]
        else:
            if not len(a) or not len(b):
                continue
            x, y = np.repeat(np.asarray(a, object), len(b)), np.tile(np.asarray(b, object), len(a))
            swap = x > y
            x, y = np.where(swap, y, x), np.where(swap, x, y)
        left.append(x), right.append(y), scope.append(np.full(len(x), s, object))
    if not left:
        return pd.DataFrame({"scope": [], "item": [], "neighbour": [], "count": []})
    pairs = pd.DataFrame({"scope": np.concatenate(scope), "item": np.concatenate(left), "neighbour": np.concatenate(right)})
    return pairs.groupby(["scope", "item", "neighbour"], sort=False).size().rename("count").reset_index()


def _as_stripes(pairs: pd.DataFrame, hot: dict[tuple[str, str], int]) -> pd.DataFrame:
    segments = np.uint64(SEGMENTS)
    if hot:
        segments = np.array([hot.get(k, SEGMENTS) for k in zip(pairs["scope"], pairs["item"], strict=True)], np.uint64)
    segment = (pd.util.hash_array(pairs["neighbour"].to_numpy(object)) % segments).astype("int32")
    grouped = pairs.assign(segment=segment).groupby(["scope", "item", "segment"], sort=False)
    return grouped.agg(neighbours=("neighbour", list), counts=("count", list)).reset_index()


def _stripes(blocks: DataFrame, hot: dict[tuple[str, str], int]) -> DataFrame:
    """Stripes of the block rows, one a task for each (scope, item, segment); ``hot`` has the segments of hot items."""
    shared = blocks.sparkSession.sparkContext.broadcast(hot)  # HOT_ITEMS entries at most

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            pairs = _pairs_of(frame)
            if len(pairs):
                yield _as_stripes(pairs, shared.value)

    return blocks.mapInPandas(partial, STRIPE)


def _merge_stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum the stripes of a partition sorted by key; at most one key is carried from batch to batch."""
    held: pd.DataFrame | None = None
    keys = ["scope", "item", "segment"]
    for frame in batches:
        long = frame.explode(["neighbours", "counts"])
        if held is not None:
            long = pd.concat([held, long])
        total = long.astype({"counts": "int64"}).groupby([*keys, "neighbours"], sort=False)["counts"].sum().reset_index()
        last = frame[keys].iloc[-1]
        open_key = (total["scope"] == last["scope"]) & (total["item"] == last["item"]) & (total["segment"] == last["segment"])
        held = total[open_key]
        yield _done(total[~open_key])
    if held is not None:
        yield _done(held)


def _done(total: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"scope": total["scope"], "item_a": total["item"], "item_b": total["neighbours"], "n_ab": total["counts"]})


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's G2 of the two-by-two table of baskets with and without either item."""
    k11, k12, k21, k22 = (x.cast("double") for x in (n_ab, n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab))
    rows = _xlogx(k11 + k12) + _xlogx(k21 + k22)
    cols = _xlogx(k11 + k21) + _xlogx(k12 + k22)
    cells = _xlogx(k11) + _xlogx(k12) + _xlogx(k21) + _xlogx(k22)
    return F.greatest(F.lit(0.0), 2 * (cells + _xlogx(n.cast("double")) - rows - cols))


def cooccurrence(rows: DataFrame, scope: str, basket: str, item: str, min_count: int = 1) -> DataFrame:
    """(scope, item_a, item_b, n_ab, n_a, n_b, n, lift, llr) of each pair of items in at least ``min_count`` common baskets.

    Counts are of distinct baskets within the scope. Items in fewer than ``min_count`` baskets cannot form such a pair
    and leave before pairs are built, which loses nothing; all counts still refer to all rows.

    A pair in k = ``min_count`` baskets is in at least one basket besides the k - 1 largest of its scope. Those of them
    above ``GIANT`` items therefore build no pairs: the pairs of the other baskets look up which giants hold both items.
    """
    sets = rows.select(F.col(scope).alias("scope"), F.col(basket).alias("basket"), F.col(item).alias("item"))
    disk = Scratch(rows.sparkSession, "cooccurrence")
    sets = disk.save(sets.where("scope IS NOT NULL AND basket IS NOT NULL AND item IS NOT NULL").distinct(), keep=True)
    items = disk.save(sets.groupBy("scope", "item").agg(F.count("*").alias("n_item")), keep=True)
    totals = disk.save(sets.select("scope", "basket").distinct().groupBy("scope").agg(F.count("*").alias("n")), keep=True)
    kept = sets if min_count <= 1 else salted_lookup(sets, items.where(F.col("n_item") >= min_count), ["scope", "item"]).drop("n_item")
    kept = disk.save(kept, keep=True)
    sizes = disk.save(kept.groupBy("scope", "basket").agg(F.count("*").alias("size")), keep=True)
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("size"), "basket"))
    giants = disk.save(sizes.where(F.col("size") > GIANT).withColumn("rank", rank).where(F.col("rank") < min_count).select("scope", "basket"), keep=True)
    some = not giants.isEmpty()
    built = kept.join(giants, ["scope", "basket"], "left_anti") if some else kept
    limit = max(HOT, -(-sets.count() // HOT_ITEMS))
    hottest = items.where(F.col("n_item") > limit).collect()  # HOT_ITEMS rows at most
    stripes = _stripes(_blocks(built, sizes), {(r["scope"], r["item"]): SEGMENTS * -(-r["n_item"] // limit) for r in hottest})
    keyed = stripes.repartition("scope", "item", "segment").sortWithinPartitions("scope", "item", "segment")
    pairs = keyed.mapInPandas(_merge_stripes, "scope string, item_a string, item_b string, n_ab bigint")
    if some:
        inside = salted_lookup(kept, giants.withColumn("giant", F.lit(True)), ["scope", "basket"]).groupBy("scope", "item").agg(F.collect_set("basket").alias("held"))
        for side in ("a", "b"):
            pairs = salted_lookup(pairs, inside.select("scope", F.col("item").alias(f"item_{side}"), F.col("held").alias(f"held_{side}")), ["scope", f"item_{side}"], "left")
        common = F.coalesce(F.size(F.array_intersect("held_a", "held_b")), F.lit(0))
        pairs = pairs.select("scope", "item_a", "item_b", (F.col("n_ab") + F.greatest(common, F.lit(0))).alias("n_ab"))
    # Written once, so the look-ups below (and their counts of hot keys) do not run the stripes again.
    pairs = disk.save(pairs.where(F.col("n_ab") >= min_count), keep=True)
    counted = salted_lookup(pairs, items.select("scope", F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), ["scope", "item_a"])
    counted = salted_lookup(counted, items.select("scope", F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), ["scope", "item_b"])
    counted = salted_lookup(counted, totals, ["scope"])
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    llr = log_likelihood_ratio(*(F.col(c) for c in ("n_ab", "n_a", "n_b", "n")))
    return counted.select(F.col("scope").alias(scope), "item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), llr.alias("llr"))
