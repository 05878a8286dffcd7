"""Quality of extraction against a gold standard, and counters of stages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F


def entity_key(name: Column, type_id: Column) -> Column:
    return F.concat(F.lower(name), F.lit("|"), type_id.cast("string"))


def relation_key(source: Column, target: Column, relation: Column) -> Column:
    return F.concat_ws("|", F.lower(source), F.lower(target), F.upper(relation))


def set_scores(expected: DataFrame, predicted: DataFrame, key: str, item: str) -> DataFrame:
    """(key, correct, missing, extra, precision, recall, f1) over distinct items; nothing expected scores 1 if nothing is predicted, else 0."""
    e = expected.select(key, item).where(F.col(item).isNotNull()).distinct().withColumn("_e", F.lit(1))
    p = predicted.select(key, item).where(F.col(item).isNotNull()).distinct().withColumn("_p", F.lit(1))
    keys = expected.select(key).union(predicted.select(key)).distinct()
    per = keys.join(e.join(p, [key, item], "full"), key, "left").groupBy(key).agg(
        F.sum(F.when(F.col("_e").isNotNull() & F.col("_p").isNotNull(), 1).otherwise(0)).alias("correct"),
        F.sum(F.when(F.col("_e").isNotNull() & F.col("_p").isNull(), 1).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("_e").isNull() & F.col("_p").isNotNull(), 1).otherwise(0)).alias("extra"),
    )
    c, want, got = F.col("correct"), F.col("correct") + F.col("missing"), F.col("correct") + F.col("extra")
    none = want == 0
    empty = F.when(got == 0, 1.0).otherwise(0.0)
    part = lambda x: F.when(none, empty).otherwise(F.coalesce(F.try_divide(c, x), F.lit(0.0)))
    return per.withColumn("precision", part(got)).withColumn("recall", part(want)).withColumn("f1", F.when(none, empty).otherwise(F.coalesce(F.try_divide(2.0 * c, want + got), F.lit(0.0))))


def attribute_match(expected: Column, predicted: Column) -> Column:
    """Share of expected keys with the same value (blanks and case ignored); 1 where nothing is expected."""
    plain = lambda v: F.lower(F.trim(v))
    keys = F.map_keys(expected)
    hits = F.size(F.filter(keys, lambda k: plain(F.try_element_at(expected, k)).eqNullSafe(plain(F.try_element_at(predicted, k)))))
    return F.when(F.size(keys) == 0, 1.0).otherwise(hits / F.size(keys))


def fact_issues(fact: Column, source: Column, target: Column, has_self: Column) -> Column:
    """What is wrong with the fact of a relation: empty (then nothing else), the author in the third person or without the first
    person where the author is an end, analysis instead of a fact. ``has_self``: the author is among the names of the entry."""
    # The phrases that count.
    person, first, analysis = "the narrator", [" i ", " my ", " me "], ["indicating a", "suggesting that"]
    text = F.coalesce(F.trim(fact), F.lit(""))
    lower = F.lower(text)
    any_of = lambda phrases: reduce(or_, [F.contains(lower, F.lit(x)) for x in phrases])
    involved = has_self & ((F.lower(F.coalesce(source, F.lit(""))) == "i") | (F.lower(F.coalesce(target, F.lit(""))) == "i"))
    third = F.contains(lower, F.lit(person))
    tests = [
        (text == "", "empty"), ((text != "") & involved & third, "third person"), ((text != "") & involved & ~third & ~any_of(first) & ~text.startswith("I "), "no first person"),
        (any_of(analysis), "analysis"),
    ]
    return F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda x: x.isNotNull())


def judge_score(text: Column) -> Column:
    """The score of a judge's JSON answer within 0 and 1; 0 for a broken answer."""
    value = F.try_variant_get(F.try_parse_json(text), "$.score", "double") if hasattr(F, "try_variant_get") else F.get_json_object(text, "$.score").try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def mean_score(rows: DataFrame, score: str) -> DataFrame:
    """One row (mean_score, n); 0 for no rows."""
    return rows.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"), F.count("*").alias("n"))


def split_tail(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``part``: the last tenth (1 to 3 rows) is validation, the rest training; one row or none is an error.

    For sets of examples; the rank runs over the examples, not over data.
    """
    total = rows.agg(F.count("*").alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(order))).crossJoin(total)  # one number
    size = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("_n") / 10)))
    part = F.when(F.col("_n") <= 1, F.raise_error(F.lit("too few examples to split"))).when(F.col("_r") > F.col("_n") - size, "validation").otherwise("training")
    return ranked.withColumn("part", part).drop("_n", "_r")


def coverage(rows: DataFrame, labels: str, wanted: list[str]) -> DataFrame:
    """One row (have, lacking): label sets over all rows against those wanted."""
    have = rows.select(F.explode(labels).alias("x")).distinct().agg(F.sort_array(F.collect_list("x")).alias("have"))
    return have.select("have", F.array_except(F.array(*[F.lit(w) for w in wanted]), "have").alias("lacking"))


def stage_counts(rows: DataFrame, kind: str, skipped: Column) -> DataFrame:
    """(type, processed, skipped) of a stage."""
    return rows.groupBy(F.col(kind).alias("type")).agg(F.sum((~skipped).cast("int")).alias("processed"), F.sum(skipped.cast("int")).alias("skipped"))


def summary_stats(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row (processed, mean_length, truncated); the mean is rounded half to even."""
    return rows.agg(F.count("*").alias("processed"), F.bround(F.coalesce(F.avg(F.length(after)), F.lit(0.0)), 2).alias("mean_length"), F.coalesce(F.sum((F.length(after) < F.length(before)).cast("int")), F.lit(0)).alias("truncated"))
