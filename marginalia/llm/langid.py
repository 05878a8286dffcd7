"""Language of each text and of each passage of a text in several languages.

Model: sparse multinomial logistic regression on TF-IDF character n-grams (n = 1..4, hashed), trained with
follow-the-regularised-leader and elastic-net penalties, then temperature calibration on held-out rows. It is fitted on a
bounded sample of labelled rows (``SAMPLE_PER_LANGUAGE`` texts a language, whole texts); document frequencies cover all
texts. Labels are noisy: after a first fit, sample rows the model firmly contradicts leave and the fit is repeated.

Application: a text is cut into units at sentence and line ends, units are scored in one pass over the n-grams, and
the best path through the units pays a price for each change of language; runs under ``MIN_PASSAGE`` characters join a neighbour.

Defined results: null, empty texts and texts with fewer than ``MIN_LETTERS`` letters have no language (no passage).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LANGUAGES = ["de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru", "sv"]
# Three-letter codes and names of the languages, lower case.
NAMES = {
    "de": ["deu", "ger", "german", "deutsch"], "en": ["eng", "english"], "es": ["spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fra", "fre", "french", "français", "francais"], "it": ["ita", "italian", "italiano"], "nl": ["nld", "dut", "dutch", "nederlands"],
    "pl": ["pol", "polish", "polski"], "pt": ["por", "portuguese", "português", "portugues"], "ru": ["rus", "russian", "русский"],
    "sv": ["swe", "swedish", "svenska"],
}
ORDERS, BITS = (1, 2, 3, 4), 17
#: Labelled texts a language in the training sample: the bound on what is collected for fitting.
SAMPLE_PER_LANGUAGE = 500
#: Units a sample text gives at most to training, spread evenly over the whole text.
UNITS_PER_TEXT = 12
MIN_PASSAGE, MIN_LETTERS = 60, 8
#: Price, in log probability, of a change of language between two units.
SWITCH = 4.0
#: Epochs of the fits that clean the training rows before the final one.
CLEANING = (1, 2)
#: Log odds by which the model must contradict a label before the label counts as wrong.
CONTRADICTION = 1.0

_BREAK = re.compile(r"(?:[.!?…;:]+[\"'»”’)\]]*\s+|\s*\n\s*|\s{2,}|\s+[–—|]\s+)")

_LINK = re.compile(r"https?://[^\s/]*(?:/[^\s/]*(?=/))*/?|\bwww\.\S+")


def _fold_table() -> np.ndarray:
    """Code point to lower-case letter, everything that is no letter to a blank."""
    out = np.full(65536, 32, np.uint32)
    for i in range(65536):
        ch = chr(i)
        if ch.isalpha() or unicodedata.category(ch) == "Mn":
            low = ch.lower()
            out[i] = ord(low[0])
        elif ch in "'’":
            out[i] = 39
    return out


FOLD = _fold_table()


def label_code(label: Column) -> Column:
    """The two-letter code a label names in any notation (case, region, three letters, name), else null."""
    bare = F.lower(F.trim(F.regexp_replace(label, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))))
    base = F.regexp_extract(bare, r"^([^\s_(,;-]+)", 1)
    forms = F.create_map(*[F.lit(x) for code, names in NAMES.items() for form in [code, *names] for x in (form, code)])
    return F.try_element_at(forms, base)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the kept characters, their hashed n-grams as rows of an array (characters, orders)).

    Runs of characters that are no letters count as one blank. An n-gram starts at its character; those running over the
    end or made of a blank alone get the slot 0, whose weight stays 0.
    """
    text = _LINK.sub(lambda m: " " * len(m[0]), text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(points < 65536, FOLD[np.minimum(points, 65535)], 32).astype(np.uint64)
    blank = folded == 32
    keep = np.flatnonzero(~(blank & np.concatenate(([False], blank[:-1]))))
    chars = folded[keep]
    size, out = len(chars), np.zeros((len(keep), len(ORDERS)), np.int64)
    key = np.zeros(size, np.uint64)
    for column, order in enumerate(ORDERS):
        if size < order:
            break
        part = chars[order - 1 :]
        key = key[: size - order + 1] * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(order)
        mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[: size - order + 1, column] = ((mixed >> np.uint64(64 - BITS)).astype(np.int64)) | 1
    out[chars == 32, 0] = 0
    return keep, out


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of consecutive sentences or lines that hold a letter; the first letter starts the unit."""
    cuts, start = [], 0
    for m in _BREAK.finditer(text):
        cuts.append((start, m.end()))
        start = m.end()
    cuts.append((start, len(text)))
    out = []
    for a, b in cuts:
        while b - a > 400:  # no natural end: cut at a blank
            at = text.rfind(" ", a, a + 300) + 1
            at = at if at > a else a + 300
            out.append((a, at))
            a = at
        out.append((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in out:
        first = next((i for i in range(a, b) if text[i].isalpha()), None)
        if first is not None:
            merged.append((first, b))
    return merged


def plain_spelling(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@dataclass
class LanguageModel:
    """Weights already multiplied by the inverse document frequencies: (2 ** BITS, languages)."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (sums / np.sqrt(np.maximum(counts, 1))[:, None] + self.bias) / self.temperature

    def score(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Log probabilities (spans, languages)."""
        keep, ids = grams(text)
        total = np.concatenate((np.zeros((1, len(LANGUAGES)), np.float64), np.cumsum(self.weights[ids].sum(1, dtype=np.float64), 0)))
        seen = np.concatenate(([0], np.cumsum((ids > 0).sum(1))))
        edges = np.searchsorted(keep, np.asarray(spans))
        sums, counts = total[edges[:, 1]] - total[edges[:, 0]], seen[edges[:, 1]] - seen[edges[:, 0]]
        return _log_softmax(self.logits(sums, counts))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = grams(text)[1].ravel()
    ids, tf = np.unique(ids[ids > 0], return_counts=True)
    return ids, (tf * idf[ids] / np.sqrt(max(tf.sum(), 1))).astype(np.float32)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.005, l2: float = 1e-3, batch: int = 64, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on the multinomial loss, elastic net by ``l1`` and ``l2``; returns (weights, bias)."""
    k, size = len(LANGUAGES), 1 << BITS
    z, n = np.zeros((size + 1, k), np.float32), np.zeros((size + 1, k), np.float32)  # the last slot is the bias

    def weight(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)).astype(np.float32)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        permuted = order.permutation(len(rows))
        for at in range(0, len(permuted), batch):
            chosen = permuted[at : at + batch]
            ids = np.concatenate([np.append(rows[i][0], size) for i in chosen])
            values = np.concatenate([np.append(rows[i][1], np.float32(1)) for i in chosen])
            lengths = np.array([len(rows[i][0]) + 1 for i in chosen])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            slots, inverse = np.unique(ids, return_inverse=True)
            w = weight(slots)
            p = np.exp(_log_softmax(np.add.reduceat(w[inverse] * values[:, None], starts, axis=0)))
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            each = np.repeat(p, lengths, axis=0) * values[:, None]
            by_slot = np.argsort(inverse, kind="stable")
            first = np.searchsorted(inverse[by_slot], np.arange(len(slots)))
            g = np.add.reduceat(each[by_slot], first, axis=0).astype(np.float32)
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - sigma * w
            n[slots] += g * g
    w = weight(np.arange(size + 1))
    return w[:size], w[size]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least held-out log loss, by a search over a grid."""
    grid = np.geomspace(0.2, 5, 40)
    loss = [-_log_softmax(logits / t)[np.arange(len(labels)), labels].mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(documents holding each hashed n-gram, documents) over all texts; at most 2 ** BITS numbers reach the driver.

    Each task adds up its texts before anything is shuffled; the partial vectors meet in chunks of 1,024 slots.
    """
    chunk = 1024

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = np.zeros(1 << BITS, np.int64), 0
        for frame in batches:
            for body in frame["_t"]:
                ids = np.unique(grams(body)[1])
                counts[ids] += 1
                seen += 1
        if seen:
            counts[0] = seen
            yield pd.DataFrame({"slot": np.arange(0, 1 << BITS, chunk), "counts": list(counts.reshape(-1, chunk))})

    parts = df.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull()).mapInPandas(partial, "slot int, counts array<bigint>")
    sums = parts.select("slot", F.posexplode("counts").alias("i", "c")).groupBy((F.col("slot") + F.col("i")).alias("slot")).agg(F.sum("c").alias("c")).where("c > 0")
    out = np.zeros(1 << BITS, np.int64)
    got = sums.toPandas()
    out[got["slot"]] = got["c"]
    return out, int(out[0])


def fit(df: DataFrame, text: str, label: str, key: str, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of labelled rows chosen by a hash of their key. An empty sample gives an indifferent model."""
    found, total = document_frequencies(df, text)
    idf = np.log((1 + total) / (1 + found)).astype(np.float32) + 1
    idf[0] = 0
    known = df.select(F.col(text).alias("text"), label_code(F.col(label)).alias("code"), F.xxhash64(F.col(key)).alias("h")).where("code IS NOT NULL AND length(text) >= 20")
    # Two-stage top-k: each task offers its best rows, so no language is sorted in one task.
    local = Window.partitionBy("code", "part").orderBy("h")
    offered = known.select("code", "h", F.spark_partition_id().alias("part")).withColumn("r", F.row_number().over(local)).where(F.col("r") <= per_language)
    chosen = offered.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h"))).where(F.col("r") <= per_language).select("code", "h")
    sample = known.join(F.broadcast(chosen), ["code", "h"]).toPandas()  # at most per_language * languages keys
    if sample.empty:
        return LanguageModel(np.zeros((1 << BITS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32))
    sample = sample.sort_values("h").reset_index(drop=True)
    rows, labels, owner = [], [], []
    for i, (body, code) in enumerate(zip(sample["text"], sample["code"], strict=True)):
        spans = units(body)
        for j in np.unique(np.linspace(0, len(spans) - 1, UNITS_PER_TEXT).astype(int)) if spans else ():
            piece = body[spans[j][0] : spans[j][1]]
            variants = {piece, plain_spelling(piece)}
            for variant in sorted(variants):
                rows.append(_features(variant, idf))
                labels.append(LANGUAGES.index(code))
                owner.append(i)
    labels, owner = np.array(labels), np.array(owner)
    held = owner % 5 == 0

    def logits(w: np.ndarray, b: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.array([(w[rows[i][0]] * rows[i][1][:, None]).sum(0) + b for i in np.flatnonzero(which)]).reshape(-1, len(LANGUAGES))

    agreed = np.full(len(rows), True)
    lp = np.zeros((len(rows), len(LANGUAGES)))
    for epochs in CLEANING:  # each half is judged by a model of the other half, so no row vouches for itself
        for half in (0, 1):
            train, judged = np.flatnonzero(agreed & (owner % 2 == half)), owner % 2 != half
            w, b = fit_ftrl([rows[i] for i in train], labels[train], epochs=epochs)
            lp[judged] = _log_softmax(logits(w, b, judged))
        whole = np.zeros((len(sample), len(LANGUAGES)))
        np.add.at(whole, owner, lp)
        agreed = (whole.argmax(1)[owner] == labels) & (lp[np.arange(len(rows)), labels] > lp.max(1) - CONTRADICTION)
    train = np.flatnonzero(agreed & ~held)
    w, b = fit_ftrl([rows[i] for i in train], labels[train])
    test = agreed & held
    temperature = calibrate(logits(w, b, test), labels[test]) if test.any() else 1.0
    return LanguageModel((w * idf[:, None]).astype(np.float32), b, temperature)


def passages(text: str, model: LanguageModel) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the passages of a text; one passage where it keeps to one language."""
    if text is None:
        return []
    spans = units(text)
    if not spans or sum(c.isalpha() for c in text) < MIN_LETTERS:
        return []
    lp = model.score(text, [*spans, (spans[0][0], spans[-1][1])])
    unit, whole = lp[:-1], lp[-1]
    best = unit.argmax(1)
    path = best if (best == best[0]).all() else _best_path(unit)
    runs = [[spans[0][0], spans[0][1], int(path[0]), 0, 1]]
    for i in range(1, len(spans)):
        if path[i] == runs[-1][2]:
            runs[-1][1], runs[-1][4] = spans[i][1], i + 1
        else:
            runs.append([*spans[i], int(path[i]), i, i + 1])
    # A run under the least length joins the longer neighbour; the shortest first, so that what grows may stay.
    while len(runs) > 1:
        k = min(range(len(runs)), key=lambda i: runs[i][1] - runs[i][0])
        if len(text[runs[k][0] : runs[k][1]].rstrip(" \t\r\n–—|>-")) >= MIN_PASSAGE:
            break
        near = [i for i in (k - 1, k + 1) if 0 <= i < len(runs)]
        to = max(near, key=lambda i: runs[i][1] - runs[i][0])
        lang = runs[to][2]
        a, b = min(k, to), max(k, to)
        runs[a : b + 1] = [[runs[a][0], runs[b][1], lang, runs[a][3], runs[b][4]]]
        i = 1
        while i < len(runs):
            if runs[i][2] == runs[i - 1][2]:
                runs[i - 1 : i + 1] = [[runs[i - 1][0], runs[i][1], runs[i][2], runs[i - 1][3], runs[i][4]]]
            else:
                i += 1
    if len(runs) == 1:
        k = int(whole.argmax())
        return [(0, len(text), LANGUAGES[k], float(np.exp(whole[k])))]
    scores = np.exp(model.score(text, [(r[0], r[1]) for r in runs]))
    return [(0 if i == 0 else r[0], r[1], LANGUAGES[r[2]], float(scores[i, r[2]])) for i, r in enumerate(runs)]


def _best_path(lp: np.ndarray) -> np.ndarray:
    score, back = lp[0].copy(), np.zeros(lp.shape, np.int64)
    for i in range(1, len(lp)):
        top = int(score.argmax())
        stay = score >= score[top] - SWITCH
        back[i] = np.where(stay, np.arange(lp.shape[1]), top)
        score = np.where(stay, score, score[top] - SWITCH) + lp[i]
    path = np.empty(len(lp), np.int64)
    path[-1] = score.argmax()
    for i in range(len(lp) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def identify(df: DataFrame, text: str, label: str, key: str, model: LanguageModel) -> DataFrame:
    """(key, label_code, passages, seg_no, seg_start, seg_end, lang, confidence, label_log_odds), one row a passage.

    ``label_log_odds`` is the model's log odds of its language against the labelled one (null without a label).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows of ten numbers, whatever the data
    rows = df.select(F.col(key).alias("_key"), label_code(F.col(label)).alias("label_code"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    key_type = rows.schema["_key"].dataType.simpleString()
    schema = f"{key} {key_type}, label_code string, passages int, seg_no int, seg_start bigint, seg_end bigint, lang string, confidence double, label_log_odds double"
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for frame in batches:
            out = []
            for k, code, body in zip(frame["_key"], frame["label_code"], frame["_text"], strict=True):
                parts = passages(body, found)
                odds = None
                if len(parts) == 1 and code in LANGUAGES:
                    lp = found.score(body, [(0, len(body))])[0]
                    odds = float(lp.max() - lp[LANGUAGES.index(code)])
                out += [(k, code, len(parts), i, a, b, lang, p, odds) for i, (a, b, lang, p) in enumerate(parts)]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(apply, schema)
