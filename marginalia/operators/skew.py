"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def salted_lookup(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = 200_000) -> DataFrame:
    """Join many ``facts`` to at most one ``lookup`` row a key where one key may hold a third of all facts.

    Keys with more than ``hot_rows`` facts are found by a pre-aggregated count (there can be no more than rows / ``hot_rows``
    of them). Such a key gets one salt for each ``hot_rows`` facts, its lookup row is copied once a salt, and only its facts
    are spread over the salts, by a hash of the row: a task that is run again puts every row where it was. Equal rows
    stay together; callers count copies before. Keys are compared null-unsafely: a fact with a null key finds nothing.
    """
    hot = facts.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    hashed = [c for c, kind in facts.dtypes if "map<" not in kind and "variant" not in kind]
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*hashed, F.lit("salt")), F.col("_salts"))).otherwise(F.lit(0))
    spread = facts.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")
