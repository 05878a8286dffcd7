"""Extensions: word search with BM25 scores, and nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import search_tokens


def bm25(rows: DataFrame, key: str, text: str, words: list[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the best ``limit`` rows for some words. Only rows with one of the words are exploded and shuffled."""
    tokens = F.transform(search_tokens(F.col(text)), lambda w: F.lower(w))
    docs = rows.select(key, tokens.alias("w")).withColumn("size", F.size("w"))
    total = docs.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    hits = docs.select(key, "size", F.explode(F.array_intersect("w", F.array(*[F.lit(w.lower()) for w in words]))).alias("word"), "w")
    hits = hits.select(key, "size", "word", F.size(F.filter("w", lambda x: x == F.col("word"))).alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))  # one row a wanted word
    scored = hits.join(F.broadcast(df), "word").crossJoin(total)  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return scored.groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def cosine_top(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 512) -> DataFrame:
    """(query, key, similarity): the ``k`` nearest rows of each query, itself excluded. Zero, empty and null vectors have no neighbours.

    Queries travel in blocks; each task scores a batch against a block as one matrix product and keeps ``k`` a query.
    """
    numbered = queries.select(F.col(key).alias("query"), F.col(vector).alias("q")).where(F.size("q") > 0)
    parts = max(1, -(-numbered.count() // block))
    blocks = numbered.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(parts))).groupBy("block").agg(F.collect_list(F.struct("query", "q")).alias("qs"))
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for part in blocks.toLocalIterator():  # a block at a time
        ids = [x["query"] for x in part["qs"]]
        unit = np.array([x["q"] for x in part["qs"]], np.float64)
        length = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.where(length > 0, unit / np.maximum(length, 1e-30), np.nan)

        def score(batches: Iterator[pd.DataFrame], ids: list = ids, unit: np.ndarray = unit) -> Iterator[pd.DataFrame]:
            for frame in batches:
                good = frame[[v is not None and len(v) == unit.shape[1] for v in frame["v"]]]
                if good.empty:
                    continue
                m = np.array(good["v"].to_list(), np.float64)
                size = np.linalg.norm(m, axis=1)
                # Equal vectors may differ in the last bits by their place in the product.
                sims = np.where(size > 0, np.round(unit @ (m / np.maximum(size, 1e-30)[:, None]).T, 12), -np.inf)
                found = []
                keys = good["k"].to_numpy()
                order = np.argsort(keys, kind="stable")  # equal similarities by key, as in the end
                for i, q in enumerate(ids):
                    for j in order[np.argsort(-sims[i][order], kind="stable")][: k + 1]:
                        if keys[j] != q and np.isfinite(sims[i, j]):
                            found.append((q, keys[j], float(sims[i, j])))
                yield pd.DataFrame(found, columns=["query", key, "similarity"])

        scored = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(score, f"query {kind}, {key} {kind}, similarity double")
        out = scored if out is None else out.unionAll(scored)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query {kind}, {key} {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return out.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
