"""Mixing sources to target shares of the total size.

1. Soft membership: every text gets posteriors over the sources from a naive Bayes classifier over hashed words, whose
   counts cover all labelled texts and whose temperature is fitted on rows held out of the counts; afterwards they are
   counted too. A label is evidence, not certainty: it is believed with the weight ``TRUST``, the classifier with the rest.
2. Rates: nonnegative repetition rates, at most the cap of the text, by projected gradient on the squared distance between
   expected tokens a source and their targets. The projection is lazy: the sum of all steps of a text is its posteriors
   times one number a source, so a step is one aggregate over the texts and nothing is rewritten.
3. Copies: the whole part of the rate, and one more for the texts first in hash order until the source's tokens are
   reached; found from one histogram of bounded size.

The total is the largest at which every source that has texts can reach its share. Sources without texts cannot; their share
is reported as 0 and the others keep their proportions. Null and empty texts and texts of no size are left out. A text
whose source is null or not among the targets is judged by the classifier alone; its cap is that of its likeliest source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch

#: Hash buckets of words, buckets of the rounding histogram, steps of the gradient at most, relative distance that ends them; ``shares`` tells what is left.
WORDS, SLICES, STEPS, TOLERANCE = 4096, 4096, 60, 1e-5
#: Weight of a label against the classifier.
TRUST = 0.98
#: Share (one in so many) of labelled texts held out for the temperature, and the temperatures tried.
HELD, TEMPERATURES = 10, [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0]


def _word_ids(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int"))


def posteriors(docs: DataFrame, sources: list[str]) -> DataFrame:
    """``docs(doc, tokens, source, text)`` to (doc, tokens, source, p): p has one probability a source."""
    k = len(sources)
    known = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    rows = docs.withColumn("label", F.when(F.coalesce(known, F.lit(0)) > 0, (known - 1).cast("int"))).withColumn("held", F.pmod(F.xxhash64("doc"), F.lit(HELD)) == 0)
    temperature = 1.0

    def model(words: pd.DataFrame, texts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(priors, log shares of the words) from counts (label, held, w, count) and (label, held, count)."""
        counts, sizes = np.ones((k, WORDS)), np.zeros(k)
        np.add.at(counts, (words["label"].to_numpy(int), words["w"].to_numpy(int)), words["count"].to_numpy(float))
        np.add.at(sizes, texts["label"].to_numpy(int), texts["count"].to_numpy(float))
        with np.errstate(divide="ignore"):  # a source without texts keeps no probability
            priors = np.log(sizes / max(sizes.sum(), 1)) if sizes.any() else np.zeros(k)
        return priors, np.log(counts / counts.sum(1, keepdims=True))

    labelled = rows.where("label IS NOT NULL")
    words = labelled.select("label", "held", F.explode(_word_ids(F.col("text"))).alias("w")).groupBy("label", "held", "w").count().toPandas()  # 2 * sources * WORDS rows at most
    texts = labelled.groupBy("label", "held").count().toPandas()
    fitted, whole = model(words[~words["held"]], texts[~texts["held"]]), model(words, texts)
    context = docs.sparkSession.sparkContext
    shared, final = context.broadcast(fitted), context.broadcast(whole)

    def scored(part: DataFrame, counted: Broadcast) -> DataFrame:
        def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            logs = np.ascontiguousarray(counted.value[1].T)
            for frame in batches:
                lengths = frame["ids"].map(len).to_numpy()
                e = np.zeros((len(frame), k))
                if lengths.any():
                    some = np.flatnonzero(lengths)
                    starts = np.concatenate(([0], np.cumsum(lengths[some])[:-1]))
                    e[some] = np.add.reduceat(logs[np.concatenate(frame["ids"].to_numpy()[some]).astype(np.int64)], starts, axis=0)
                yield pd.DataFrame({"doc": frame["doc"], "label": frame["label"], "tokens": frame["tokens"], "source": frame["source"], "e": list(e)})

        schema = f"doc {docs.schema['doc'].dataType.simpleString()}, label int, tokens bigint, source string, e array<double>"
        return part.select("doc", "label", "tokens", "source", _word_ids(F.col("text")).alias("ids")).mapInPandas(evidence, schema)

    if fitted[1].any():
        def loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            prior, _ = shared.value
            for frame in batches:
                frame = frame[np.isfinite(prior[frame["label"].to_numpy(int)])]  # of sources that the counts know
                e, y = np.stack(frame["e"].to_list()) if len(frame) else np.zeros((0, k)), frame["label"].to_numpy(int)
                out = []
                for t in TEMPERATURES:
                    x = e / t + prior
                    x = x - x.max(1, keepdims=True) if len(x) else x
                    out.append(float((np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]).sum()))
                yield pd.DataFrame({"t": TEMPERATURES, "loss": out})

        tried = scored(rows.where("label IS NOT NULL AND held"), shared).mapInPandas(loss, "t double, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).toPandas()
        temperature = float(tried.sort_values(["loss", "t"])["t"].iloc[0]) if len(tried) else 1.0

    def soften(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior, _ = final.value
        for frame in batches:
            if len(frame):
                x = np.stack(frame["e"].to_list()) / temperature + prior
                p = np.exp(x - x.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                label = frame["label"].fillna(-1).to_numpy(int)
                known = label >= 0
                p[known] *= 1 - TRUST
                p[np.flatnonzero(known), label[known]] += TRUST
                yield pd.DataFrame({"doc": frame["doc"], "tokens": frame["tokens"], "source": frame["source"], "p": list(p)})

    return scored(rows, final).mapInPandas(soften, f"doc {docs.schema['doc'].dataType.simpleString()}, tokens bigint, source string, p array<double>")


def _sums(rows: DataFrame, *weights: Column, k: int) -> list[np.ndarray]:
    """Of each weight, its sums over the texts times their posteriors."""
    row = rows.agg(*[F.sum(w * F.col("p")[i]).alias(f"s{n}_{i}") for n, w in enumerate(weights) for i in range(k)]).first()
    return list(np.array([float(x or 0) for x in row]).reshape(len(weights), k))


def mixture(docs: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """(doc, source, member_of, tokens, p, rate, copies) of ``docs(doc, tokens, source, text)``; ``doc`` is unique.

    ``targets`` are (source, share, repetitions allowed). ``member_of`` is the likeliest source, which counts for the cap.
    """
    targets = sorted(targets)
    k, names = len(targets), [t[0] for t in targets]
    share, caps = np.array([t[1] for t in targets], float), [t[2] for t in targets]
    disk = Scratch(docs.sparkSession, "mixture")
    usable = docs.where("doc IS NOT NULL AND text IS NOT NULL AND tokens > 0")
    rows = posteriors(usable, names)
    top = F.array_position("p", F.array_max("p")).cast("int")
    cap = F.get(F.array(*[F.lit(float(c)) for c in caps]), top - 1)
    rows = disk.save(rows.select("*", F.get(F.array(*[F.lit(n) for n in names]), top - 1).alias("member_of"), cap.alias("cap")))

    tokens = F.col("tokens").cast("double")
    room, weight = _sums(rows, tokens * F.col("cap"), tokens, k=k)  # tokens each source can give, and has
    members = [r[0] for r in rows.select("member_of").distinct().collect()]  # k names at most
    have = (room > 0) & (share > 0) & np.isin(np.array(names), members)
    if not have.any():
        return rows.select("doc", "source", "member_of", "tokens", "p", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).limit(0)
    # Posteriors leak a little between sources, so the largest total leaves that little free.
    goal = np.where(have, share * (room[have] / share[have]).min() * TRUST, 0.0)
    lam, rate = np.zeros(k), None
    for _ in range(STEPS):
        way = sum((F.col("p")[i] * float(lam[i]) for i in range(k)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.least(F.col("cap"), way))
        total, free = _sums(rows, rate * tokens, F.when((way >= 0) & (way < F.col("cap")), tokens).otherwise(0.0), k=k)
        if np.abs(total - goal).max() <= TOLERANCE * goal.sum():
            break
        # The step in the metric of the token sizes that can still move.
        lam = lam + np.where(weight > 0, (goal - total) / np.maximum(np.maximum(free, 0.02 * weight), 1e-9), 0.0)
    current = rows.withColumn("r", rate)

    # Rounding: the threshold of each source on hash / fraction at which its tokens are reached.
    unit = F.pmod(F.xxhash64("doc", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fraction = F.col("r") - F.floor("r")
    rank = F.when(fraction > 1e-9, F.least(F.lit(SLICES - 1), F.floor(F.try_divide(unit, fraction) * (SLICES / 4)))).cast("int")
    rounded = current.select("*", F.floor("r").cast("int").alias("base"), rank.alias("slice"))
    hist = rounded.groupBy("member_of", "slice").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("base")).alias("base"), F.sum(F.col("tokens") * F.col("r")).alias("want")).toPandas()  # sources * SLICES rows at most
    limits = {}
    for name, part in hist.groupby("member_of"):
        lack = float(part["want"].sum() - part["base"].sum())
        parts = part.dropna(subset=["slice"]).sort_values("slice")
        reached = np.concatenate(([0.0], parts["t"].astype(float).cumsum()))
        best = int(np.abs(reached - lack).argmin())
        limits[name] = int(parts["slice"].iloc[best - 1]) if best else -1
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    extra = F.when(F.col("slice") <= F.try_element_at(limit, F.col("member_of")), 1).otherwise(0)
    return rounded.select("doc", "source", "member_of", "tokens", "p", F.col("r").alias("rate"), F.least(F.col("base") + extra, F.col("cap").cast("int")).alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, texts_used, tokens_available, tokens_used, reached_share, labelled_share, expected_share, most_copies) per target.

    ``reached_share`` counts a text for the source it is a member of, ``labelled_share`` for the source it names, whether a
    target or not, ``expected_share`` for all sources by its posteriors, as the fit does before copies are rounded.
    """
    per = mixed.groupBy(F.col("member_of").alias("source")).agg(
        F.count("*").alias("texts"), F.sum((F.col("copies") > 0).cast("bigint")).alias("texts_used"), F.sum("tokens").alias("tokens_available"),
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"),
    )
    named = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("_named"))
    order = [r[0] for r in targets.select("source").orderBy("source").collect()]  # the targets, as ``p`` has them
    soft = mixed.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.get("p", F.lit(i))).alias(f"_{i}") for i in range(len(order))])
    soft = soft.select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"_{i}").alias("_soft")) for i, s in enumerate(order)])).alias("x")).select("x.*")
    total = per.agg(F.sum("tokens_used").alias("_all")).crossJoin(soft.agg(F.sum("_soft").alias("_whole")))  # one row
    out = targets.join(per, "source", "left").join(named, "source", "left").join(soft, "source", "left").crossJoin(total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda c, whole, name: F.round(F.coalesce(F.try_divide(c, whole), F.lit(0.0)), 6).alias(name)
    return out.select(
        "source", "target_share", "max_repeats", zero("texts"), zero("texts_used"), zero("tokens_available"), zero("tokens_used"), share("tokens_used", "_all", "reached_share"),
        share("_named", "_all", "labelled_share"), share("_soft", "_whole", "expected_share"), zero("most_copies"),
    )
