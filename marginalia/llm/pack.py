"""Filling containers of fixed capacity: minimum bin slack over the histogram of sizes.

What matters for packing is how many items there are of each size, and sizes are bounded by the capacity. The
histogram (at most ``capacity`` numbers, aggregated map-side) goes to the driver; there the largest remaining size is fixed and
a bitset subset-sum over the remaining sizes finds the fullest combination with it, which is removed as often as the
counts allow. The plan is a list of patterns; items get their place by their rank among the items of their size, computed with
hashed sub-groups so that a size shared by a third of all items is not ranked in one task.

Defined results: null texts have no size and are left out; items of size 0 go to container 0; an item larger than the
capacity is divided into full pieces and a rest, nothing else is divided.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch

#: Items of one size ranked in one task at most, about; sizes with more are ranked in hash groups side by side.
GROUP_ROWS = 100_000
PLACES = "container_kind string, container_no bigint, {key} {type}, piece_no int, token_start bigint, token_end bigint, tokens bigint"


def fullest(counts: dict[int, int], capacity: int) -> Counter:
    """The fullest combination of available sizes that holds the largest one: {size: times}.

    Bit s of a number stands for "s can be reached". Sizes join from large to small, each in powers of two of its count;
    the numbers after each step are kept to trace the combination back. It stops as soon as the container is full.
    """
    largest = max(counts)
    room, chosen = capacity - largest, Counter({largest: 1})
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for size in sorted(counts, reverse=True):
        left = min(counts[size] - (size == largest), room // size)
        block = 1
        while left > 0:
            take = min(block, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left, block = left - take, block * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[size] += take
            at -= size * take
    return chosen


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern {size: times}, containers filled that way)]; together they use every item exactly once."""
    left, out = {s: c for s, c in counts.items() if c > 0 and 0 < s <= capacity}, []
    while left:
        pattern = fullest(left, capacity)
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((dict(pattern), times))
    return out


def _ranges(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each size the rows (first rank, first container, items a container), ordered by rank."""
    used, rows, container = Counter(), {}, 0
    for pattern, times in patterns:
        for size, n in pattern.items():
            rows.setdefault(size, []).append((used[size], container, n))
            used[size] += n * times
        container += times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def pack(items: DataFrame, key: str, size: str, kind: str, capacity: int) -> DataFrame:
    """(container_kind, container_no, key, piece_no, token_start, token_end, tokens), one row a placed item or piece.

    ``key`` must be unique; other columns of ``items`` are not read. ``items`` is read twice (histogram, placing), so pass
    a written table where the sizes are expensive.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rows = items.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_size")).where("_key IS NOT NULL AND _size IS NOT NULL AND _size >= 0")
    pieces = F.when(F.col("_size") <= capacity, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_size") - 1) / capacity).cast("bigint")))
    rows = rows.select("_key", "_size", F.explode(pieces).alias("_no"))
    rows = rows.select("_key", "_no", (F.col("_no") * capacity).alias("_at"), F.least(F.col("_size") - F.col("_no") * capacity, F.lit(capacity)).alias("_part"))
    histogram = {int(r["_part"]): int(r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    groups = max(32, -(-max(histogram.values(), default=0) // GROUP_ROWS))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_key", "_no"), F.lit(groups)).cast("int"))
    per_group = rows.groupBy("_part", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_part").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_group.select("_part", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    places = rows.sparkSession.sparkContext.broadcast(_ranges(plan_patterns(histogram, capacity)))

    within = F.row_number().over(Window.partitionBy("_part", "_group").orderBy("_key", "_no")) - 1
    ranked = rows.withColumn("_in", within).join(offsets, ["_part", "_group"]).select("_key", "_no", "_at", "_part", (F.col("_in") + F.col("_before")).alias("_rank"))
    schema = PLACES.format(key=key, type=rows.schema["_key"].dataType.simpleString())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = places.value
        for frame in batches:
            number = np.zeros(len(frame), np.int64)
            parts, ranks = frame["_part"].to_numpy(), frame["_rank"].to_numpy()
            for part in np.unique(parts[parts > 0]):
                at, rows_of = np.flatnonzero(parts == part), table[int(part)]
                r = rows_of[np.searchsorted(rows_of[:, 0], ranks[at], "right") - 1]
                number[at] = r[:, 1] + (ranks[at] - r[:, 0]) // r[:, 2]
            yield pd.DataFrame({
                "container_kind": kind, "container_no": number, key: frame["_key"], "piece_no": frame["_no"].astype("int32"),
                "token_start": frame["_at"], "token_end": frame["_at"] + parts, "tokens": parts,
            })

    return ranked.mapInPandas(place, schema)


def pack_all(items: DataFrame, key: str, size: str, specs: DataFrame) -> DataFrame:
    """``pack`` for each (container_kind, capacity_tokens) of a small table of container kinds."""
    out = None
    for spec in specs.where("container_kind IS NOT NULL AND capacity_tokens > 0").distinct().orderBy("capacity_tokens").collect():
        part = pack(items, key, size, spec["container_kind"], spec["capacity_tokens"])
        out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("no kind of container is given")
    return out


def sized_table(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once, so that token counts are computed once."""
    return Scratch(rows.sparkSession, label).save(rows, keep=True)
