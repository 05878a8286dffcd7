"""Personal information inside free text: a character-level bidirectional LSTM with CRF transitions, in numpy.

Training: on a bounded sample of entries (``SAMPLE_TEXTS``), person names are those extracted from the same entry and
the other kinds are marked loosely by shape (``pii_forms``); where a bare number may be either of two kinds, its window
leaves. A copy of each text has other names and other values in place of its own, drawn from many countries' formats,
and sentences made round such values stand between its sentences: the network learns form and context, not a list.
Halfway, windows in which it firmly finds a name that no label knows leave too. Weights are stored in the shared folder
under a hash of what they were fitted on, and loaded where they are there.

Application: overlapping windows are scored, the scores of characters seen by two windows are averaged with weights
falling to the window's edge, and one Viterbi path over the whole text decides kind and boundaries. An exact check
follows: spans are widened to whole words, trimmed, and dropped where they lack what their kind must contain. No format
rule is consulted when a text is read.

Defined results: null or empty text has no span; whole texts of any length are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir
from .pii_forms import STREETS_EN, Forms, Span, loose_marks

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, CHARS, CLASSES = 56, 192, 8
#: Entries in the training sample, characters of them at most, windows one entry gives at most, training window, batch, epochs, step.
SAMPLE_TEXTS, SAMPLE_CHARS, PER_TEXT, LENGTH, BATCH, EPOCHS, RATE = 1600, 2_000_000, 4, 128, 12, 12, 0.008
#: Parts of the windows fitted at once, and rounds of an epoch after which they are averaged.
WORKERS, ROUNDS = 6, 2
#: Window and overlap when reading whole texts; windows scored at once.
WINDOW, OVERLAP, AT_ONCE = 320, 48, 384

TITLE = re.compile(r"^(?:(?:dr|prof|mr|mrs|ms|miss|herr|frau|sir|sra?|señora?|mme|mlle|m|dott|sig)\b\.?\s+)+", re.I)
#: Last words of an address that keep their point.
POINTED = {w for w in STREETS_EN if w.endswith(".")}
POSSESSIVE = re.compile(r"['’]s?$")


def name_spans(text: str, names: list[str]) -> list[Span]:
    """Where names of the entry stand, without title and possessive; the longest first."""
    cores = {POSSESSIVE.sub("", TITLE.sub("", n.strip())).strip(" ,.") for n in names if n}
    cores = sorted((c for c in cores if len(c) >= 2 and c not in ("I", "Me", "My")), key=lambda c: (-len(c), c))
    out: list[Span] = []
    for core in cores:
        for m in re.finditer(rf"(?<!\w){re.escape(core)}(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b, _ in out):
                end = m.end() + (1 if re.search(r"(?:^|\s)\w$", core) and text[m.end() : m.end() + 1] == "." else 0)
                out.append((m.start(), end, "person_name"))
    return out


def encode(text: str) -> np.ndarray:
    """A number a character: its id and its class in one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = np.where(points < 128, points, 128 + points % (CHARS - 128)).astype(np.int32)
    return ids * CLASSES + _CLASS[np.minimum(points, len(_CLASS) - 1)]


def _class_table() -> np.ndarray:
    out = np.zeros(0x3000, np.int32)
    for i in range(len(out)):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c == "\n" else 5 if c.isspace() else 6 if c.isalpha() else 7
    return out


_CLASS = _class_table()
PAD = 10 * CLASSES + 4


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a] = k
        out[a + 1 : b] = k + 1
    return out


@dataclass
class Tagger:
    """Both directions stacked in the first axis: input tables, recurrent weights, output, transitions."""

    chars: np.ndarray
    classes: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    NAMES = ("chars", "classes", "recurrent", "out", "bias", "moves")

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        r, h = np.random.default_rng(seed), HIDDEN
        chars = r.normal(0, 0.15, (2, CHARS, 4 * h))
        classes = r.normal(0, 0.15, (2, CLASSES, 4 * h))
        classes[:, :, h : 2 * h] += 1.0  # forget gates start open
        return cls(*(x.astype(np.float32) for x in (chars, classes, r.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)), r.normal(0, 0.2, (2, h, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)))))

    def table(self) -> np.ndarray:
        """Inputs to the gates of both directions for every number of ``encode``, times ``_FACTOR``."""
        whole = (self.chars[:, :, None, :] + self.classes[:, None, :, :]).reshape(2, CHARS * CLASSES, -1)
        return whole * _FACTOR

    def forward(self, codes: np.ndarray, keep: bool = False, table: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """Scores (time, batch, tags) of codes (batch, time); gates in the order in, forget, out, new.

        All gates come from one logistic function s(x) = 1 / (1 + exp(-x)), as tanh(x) = 2 s(2x) - 1.
        """
        batch, steps = codes.shape
        h = HIDDEN
        table = self.table() if table is None else table
        recurrent = self.recurrent * _FACTOR
        turned = np.stack([codes.T, codes.T[::-1]])
        hidden, cell = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32)
        states, kept = np.empty((2, steps, batch, h), np.float32), []
        for t in range(steps):
            gates = np.matmul(hidden, recurrent)
            gates[0] += table[0].take(turned[0, t], 0)
            gates[1] += table[1].take(turned[1, t], 0)
            _logistic(gates)
            new = gates[:, :, 3 * h :]
            new *= 2
            new -= 1
            before = cell
            cell = gates[:, :, h : 2 * h] * before
            cell += gates[:, :, :h] * new
            squashed = cell * np.float32(-2)
            _logistic(squashed)
            squashed *= 2
            squashed -= 1
            if keep:
                kept.append((hidden, before, gates, squashed))
            hidden = gates[:, :, 2 * h : 3 * h] * squashed
            states[0, t], states[1, steps - 1 - t] = hidden[0], hidden[1]
        scores = states[0] @ self.out[0] + states[1] @ self.out[1] + self.bias
        return scores, [states, kept]

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a character of the tag paths, and its gradients."""
        scores, (states, kept) = self.forward(codes, keep=True)
        steps, batch, h = len(scores), scores.shape[1], HIDDEN
        loss, d_scores, d_moves = _crf(scores, self.moves, tags.T)
        scale = np.float32(1 / (steps * batch))
        d_scores, d_moves = (d_scores * scale).astype(np.float32), (d_moves * scale).astype(np.float32)
        g = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        g["moves"], g["bias"] = d_moves, d_scores.sum((0, 1))
        flat = d_scores.reshape(-1, TAGS)
        for d in (0, 1):
            g["out"][d] = states[d].reshape(-1, h).T @ flat
        d_states = np.stack([d_scores @ self.out[0].T, (d_scores @ self.out[1].T)[::-1]])
        d_hidden, d_cell = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32)
        back = np.ascontiguousarray(self.recurrent.transpose(0, 2, 1))
        d_all = np.empty((2, steps, batch, 4 * h), np.float32)
        before_all = np.empty((2, steps, batch, h), np.float32)
        for t in range(steps - 1, -1, -1):
            hidden, before, gates, squashed = kept[t]
            d_hidden += d_states[:, t]
            gi, gf, go, gn = (gates[:, :, k * h : (k + 1) * h] for k in range(4))
            d_cell += d_hidden * go * (1 - squashed * squashed)
            d_gates = d_all[:, t]
            d_gates[:, :, :h] = d_cell * gn * gi * (1 - gi)
            d_gates[:, :, h : 2 * h] = d_cell * before * gf * (1 - gf)
            d_gates[:, :, 2 * h : 3 * h] = d_hidden * squashed * go * (1 - go)
            d_gates[:, :, 3 * h :] = d_cell * gi * (1 - gn * gn)
            before_all[:, t] = hidden
            d_hidden = np.matmul(d_gates, back)
            d_cell = d_cell * gf
        for d in (0, 1):
            rows = (codes.T if d == 0 else codes.T[::-1]).ravel()
            moved = d_all[d].reshape(-1, 4 * h)
            g["recurrent"][d] = before_all[d].reshape(-1, h).T @ moved
            by_code = _scatter(rows, moved)
            whole = np.zeros((CHARS * CLASSES, 4 * h), np.float32)
            whole[by_code[0]] = by_code[1]
            whole = whole.reshape(CHARS, CLASSES, 4 * h)
            g["chars"][d], g["classes"][d] = whole.sum(1), whole.sum(0)
        return loss * float(scale), g


@dataclass
class Adam:
    """Steps done and the moments of the gradients."""

    steps: int
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tagger: Tagger) -> Adam:
        return cls(0, *({m: np.zeros_like(getattr(tagger, m)) for m in Tagger.NAMES} for _ in range(2)))

    def step(self, tagger: Tagger, g: dict[str, np.ndarray], rate: float) -> Adam:
        """Moves the weights and gives the new moments; gradients are clipped to norm 1."""
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        t = self.steps + 1
        first = {m: 0.9 * self.first[m] + 0.1 * clip * x for m, x in g.items()}
        second = {m: 0.99 * self.second[m] + 0.01 * (clip * x) ** 2 for m, x in g.items()}
        for m in g:
            getattr(tagger, m)[...] -= rate * (first[m] / (1 - 0.9**t)) / (np.sqrt(second[m] / (1 - 0.99**t)) + 1e-7)
        return Adam(t, first, second)


#: Factor of the gates' inputs, for ``_logistic`` takes -x, and 2x where a tanh is wanted.
_FACTOR = np.repeat(np.array([-1.0, -1.0, -1.0, -2.0], np.float32), HIDDEN)


def _logistic(x: np.ndarray) -> None:
    """1 / (1 + exp(x)) in place; a large x gives 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different rows, sums of the values at them)."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
    return sorted_rows[starts], np.add.reduceat(values[order], starts, axis=0)


def _crf(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood summed over paths, and gradients, by the forward-backward recursions with scaling."""
    steps, batch, k = scores.shape
    top = scores.max(2, keepdims=True)
    unary, pair = np.exp((scores - top).astype(np.float64)), np.exp(moves.astype(np.float64))
    alpha, norm = np.empty((steps, batch, k)), np.empty((steps, batch))
    for t in range(steps):
        a = unary[t] if t == 0 else (alpha[t - 1] @ pair) * unary[t]
        norm[t] = a.sum(1)
        alpha[t] = a / norm[t][:, None]
    beta, d_moves = np.ones((batch, k)), np.zeros((k, k))
    marginal = np.empty((steps, batch, k))
    for t in range(steps - 1, -1, -1):
        marginal[t] = alpha[t] * beta
        if t:
            b = beta * unary[t] / norm[t][:, None]
            d_moves += pair * (alpha[t - 1].T @ b)
            beta = b @ pair.T
    tags = tags.astype(np.int64)
    here = np.take_along_axis(scores, tags[:, :, None], 2).sum()
    log_z = np.log(norm).sum() + top.sum()
    path = moves[tags[:-1], tags[1:]].sum()
    np.subtract.at(d_moves, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    marginal[np.arange(steps)[:, None], np.arange(batch)[None, :], tags] -= 1
    return float(log_z - here - path), marginal, d_moves


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tag paths (batch, time) of padded scores (batch, time, tags)."""
    batch, steps, k = scores.shape
    best, back = scores[:, 0].copy(), np.zeros((steps, batch, k), np.int8)
    for t in range(1, steps):
        live = np.count_nonzero(lengths > t)  # rows come longest first
        step = best[:live, :, None] + moves
        back[t, :live] = step.argmax(1)
        best[:live] = step.max(1) + scores[:live, t]
    path = np.zeros((batch, steps), np.int64)
    last = best.argmax(1)
    rows = np.arange(batch)
    at = last.copy()
    for t in range(steps - 1, -1, -1):
        on = lengths > t
        path[on, t] = at[on]
        if t:
            moved = back[t, rows, at]
            at = np.where(on, moved, at)
    return path


def _windows(texts: list[str], spans: list[list[Span]], unsure: list[list[tuple[int, int]]], r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags) of windows of one length, the last of a text padded with line ends."""
    codes, tags = [], []
    for text, marked, open_ in zip(texts, spans, unsure, strict=True):
        if not text:
            continue
        c, y = encode(text), tags_of(len(text), marked)
        starts = np.unique(np.linspace(0, max(0, len(text) - LENGTH), max(1, -(-len(text) // (LENGTH - 20)))).astype(int))
        starts = [s for s in starts if not any(a < s + LENGTH and s < b for a, b in open_)]
        if len(starts) > PER_TEXT:  # windows with spans first, the rest at random
            rich = [s for s in starts if y[s : s + LENGTH].any()]
            poor = [s for s in starts if not y[s : s + LENGTH].any()]
            starts = [*r.permutation(rich)[: PER_TEXT - 1].astype(int), *r.permutation(poor)[:1].astype(int)]
        for s in starts:
            pad = max(0, s + LENGTH - len(text))
            codes.append(np.pad(c[s : s + LENGTH], (0, pad), constant_values=PAD))
            tags.append(np.pad(y[s : s + LENGTH], (0, pad)))
    return (np.stack(codes).astype(np.int16), np.stack(tags).astype(np.int8)) if codes else (np.zeros((0, LENGTH), np.int16), np.zeros((0, LENGTH), np.int8))


def train(texts: list[str], spans: list[list[Span]], unsure: list[list[tuple[int, int]]] | None = None, epochs: int | None = None, seed: int = 5, workers: int = WORKERS, each=map) -> Tagger:  # noqa: ANN001
    """Fit on labelled texts: rounds of steps on ``workers`` parts of the windows, after each of which weights and moments are averaged.

    ``each`` applies a function to a few arguments, in this process or on the cluster. Halfway, windows where the
    network firmly sees a name without a label leave.
    """
    r, epochs = np.random.default_rng(seed), epochs or EPOCHS
    codes, tags = _windows(texts, spans, unsure or [[] for _ in texts], r)
    tagger = Tagger.fresh()
    if not len(codes):
        return tagger
    rounds, kept, state = epochs * ROUNDS, np.arange(len(codes)), Adam.fresh(tagger)
    for n in range(rounds):
        if n == rounds // 2 and epochs > 3:
            kept = kept[~_contradicted(tagger, codes, tags)]
        if n % ROUNDS == 0:
            order = r.permutation(kept)
        share = order[n % ROUNDS :: ROUNDS]
        work = [(tagger, state, codes[share[w::workers]], tags[share[w::workers]], n / rounds, (n + 1) / rounds) for w in range(workers) if len(share[w::workers])]
        done = list(each(_round, work))
        tagger = Tagger(*(np.mean([getattr(t, m) for t, _ in done], 0, dtype=np.float32) for m in Tagger.NAMES))
        state = Adam(done[0][1].steps, *({m: np.mean([getattr(s, x)[m] for _, s in done], 0, dtype=np.float32) for m in Tagger.NAMES} for x in ("first", "second")))
    return tagger


def _round(work: tuple) -> tuple[Tagger, Adam]:
    """One pass over a part of the windows; ``begun`` and ``ended`` are the share of the training done before and after."""
    tagger, state, codes, tags, begun, ended = work
    tagger = Tagger(*(getattr(tagger, m).copy() for m in Tagger.NAMES))
    steps = range(0, len(codes), BATCH)
    for a in steps:
        _, g = tagger.gradients(codes[a : a + BATCH], tags[a : a + BATCH])
        done = begun + (ended - begun) * a / len(codes)
        state = state.step(tagger, g, RATE * min(1.0, 0.1 + done * 20) * max(0.04, 1 - 0.96 * done))
    return tagger, state


def _contradicted(tagger: Tagger, codes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which windows have a stretch that the best path calls a name and the labels call nothing, inside the window."""
    name = 1 + 2 * KINDS.index("person_name")
    out = np.zeros(len(codes), bool)
    for a in range(0, len(codes), AT_ONCE):
        part, y = codes[a : a + AT_ONCE], tags[a : a + AT_ONCE]
        scores, _ = tagger.forward(part)
        path = viterbi(scores.transpose(1, 0, 2), tagger.moves, np.full(len(part), LENGTH))
        seen = (path >= name) & (path <= name + 1) & (y == 0)
        seen[:, :12] = seen[:, -12:] = False  # cut words at the edges say nothing
        out[a : a + AT_ONCE] = seen.sum(1) >= 3
    return out


def score_texts(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Scores (characters, tags) of whole texts: overlapping windows, averaged where two meet."""
    coded, jobs, table = [encode(t) for t in texts], [], tagger.table()
    for k, t in enumerate(texts):
        for s in range(0, max(1, len(t) - OVERLAP), WINDOW - OVERLAP):
            jobs.append((k, s, min(WINDOW, len(t) - s)))
    jobs.sort(key=lambda j: -j[2])
    sums = [np.zeros((len(t), TAGS), np.float32) for t in texts]
    weights = [np.zeros(len(t), np.float32) for t in texts]
    ramp = np.minimum(np.arange(1, WINDOW + 1), OVERLAP).astype(np.float32) / OVERLAP
    for a in range(0, len(jobs), AT_ONCE):
        part = jobs[a : a + AT_ONCE]
        steps = part[0][2]
        if not steps:
            break
        codes = np.full((len(part), steps), PAD, np.int32)
        for row, (k, s, n) in enumerate(part):
            codes[row, :n] = coded[k][s : s + n]
        scores, _ = tagger.forward(codes, table=table)
        for row, (k, s, n) in enumerate(part):
            w = np.ones(n, np.float32)
            if s:
                w = np.minimum(w, ramp[:n])
            if s + n < len(texts[k]):
                w = np.minimum(w, ramp[:n][::-1])
            sums[k][s : s + n] += scores[:n, row] * w[:, None]
            weights[k][s : s + n] += w
    return [s / np.maximum(w, 1e-6)[:, None] for s, w in zip(sums, weights, strict=True)]


def find_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """The checked spans of each text."""
    out: list[list[Span]] = []
    for text, path in zip(texts, best_paths(tagger, score_texts(tagger, texts)), strict=True):
        out.append(check_spans(text, _raw_spans(path)) if path.any() else [])
    return out


def best_paths(tagger: Tagger, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best tag path of each text from its (characters, tags) scores.

    Where the score of no tag beats that of the others by more than two moves can ever return, the best path has no tag
    there; only the stretches between such places are decoded, which gives the same path.
    """
    moves = tagger.moves
    through = (moves[:, :, None] + moves[None, :, :]).max(1) - (moves[:, :1] + moves[:1, :])  # best by any tag against no tag
    margin = max(float(through.max()), float((moves - moves[:, :1]).max()), float((moves - moves[:1, :]).max()), 0.0)
    paths, jobs = [np.zeros(len(s), np.int64) for s in scores], []
    for k, s in enumerate(scores):
        open_ = np.concatenate(([False], s[:, 0] - s[:, 1:].max(1, initial=-np.inf) <= margin, [False]))
        turns = np.flatnonzero(open_[1:] != open_[:-1])
        # A decided place at either side fixes what the stretch starts from and leads to.
        jobs += [(k, max(0, a - 1), min(len(s), b + 1)) for a, b in zip(turns[::2], turns[1::2], strict=True)]
    jobs.sort(key=lambda j: j[1] - j[2])
    at = 0
    while at < len(jobs):
        longest = jobs[at][2] - jobs[at][1]
        part = jobs[at : at + max(1, min(512, 4_000_000 // (longest * TAGS)))]
        at += len(part)
        lengths = np.array([b - a for _, a, b in part])
        padded = np.zeros((len(part), longest, TAGS), np.float32)
        for row, (k, a, b) in enumerate(part):
            padded[row, : b - a] = scores[k][a:b]
        for (k, a, b), path in zip(part, viterbi(padded, moves, lengths), strict=True):
            paths[k][a:b] = path[: b - a]
    return paths


def _raw_spans(path: np.ndarray) -> list[Span]:
    kinds = np.where(path > 0, (path + 1) // 2, 0)
    begins = np.flatnonzero((kinds > 0) & (np.concatenate(([0], kinds[:-1])) != kinds) | (path % 2 == 1))
    out = []
    for a in begins:
        b = a + 1
        while b < len(path) and kinds[b] == kinds[a] and path[b] % 2 == 0:
            b += 1
        out.append((int(a), int(b), KINDS[kinds[a] - 1]))
    return out


def check_spans(text: str, raw: list[Span]) -> list[Span]:
    """Whole words, trimmed ends, and the least content of the kind; kind and place are the network's."""
    out: list[Span] = []
    for a, b, kind in raw:
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        if kind == "person_name":
            title = TITLE.match(text[a:b])
            a += title.end() if title else 0
            core = POSSESSIVE.sub("", text[a:b])
            b = a + len(core)
            if re.search(r"(?:^|\s)\w$", text[a:b]) and text[b : b + 1] == ".":  # the point of an initial
                b += 1
            while a < b and not text[a].isalpha():
                a += 1
            while a < b and not (text[b - 1].isalnum() or (text[b - 1] == "." and b - a >= 2 and not text[b - 3 : b - 2].isalpha())):
                b -= 1
        else:
            while a < b and text[a] in " \t\r\n,;:":
                a += 1
            while a < b and text[b - 1] in " \t\r\n,;:":
                b -= 1
            if kind in ("street_address", "email", "phone") and text[a:b].endswith(".") and text[a:b].split()[-1] not in POINTED:
                b -= 1
            # A bracket that opens or closes outside belongs to the sentence.
            if a < b and text[b - 1] == ")" and "(" not in text[a:b]:
                b -= 1
            if a < b and text[a] == "(" and ")" not in text[a:b]:
                a += 1
        body = text[a:b]
        digits = sum(c.isdigit() for c in body)
        good = {
            "email": bool(re.search(r"@|\bat\b|\bdot\b", body, re.I)), "phone": digits >= 7, "id_number": digits >= 6,
            "street_address": digits >= 1 and any(c.isalpha() for c in body), "person_name": 2 <= len(body) <= 120 and body[0].isalpha() and "\n" not in body,
        }[kind]
        if good and kind == "person_name" and out and out[-1][2] == kind and out[-1][1] < a and not text[out[-1][1] : a].strip() and "\n" not in text[out[-1][1] : a]:
            out[-1] = (out[-1][0], b, kind)  # given name and surname with only blanks between
        elif good and not any(x < b and a < y for x, y, _ in out):
            out.append((a, b, kind))
    return out


def labelled_sample(entries: DataFrame, names: DataFrame, key: list[str], text: str, limit: int = SAMPLE_TEXTS) -> tuple[list[str], list[list[Span]], list[list[tuple[int, int]]]]:
    """(texts, spans, unsure passages) of at most ``limit`` entries chosen by a hash of their text, and their changed copies.

    ``names(*key, name)`` are the person names extracted from an entry. Of a longer text, a stretch of equal share is
    used, so that what the driver holds is bounded by ``SAMPLE_CHARS`` (training only; reading takes whole texts).
    """
    rows = entries.select(*key, F.col(text).alias("_text")).where("length(_text) >= 10").dropDuplicates(key)
    sample = rows.withColumn("h", F.xxhash64("_text")).orderBy("h", *key).limit(limit)  # top-k, not a sort
    most = max(LENGTH, SAMPLE_CHARS // max(1, limit))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("_text") - most)) + 1
    sample = sample.withColumn("_text", F.when(F.length("_text") > most, F.substring("_text", at.cast("int"), F.lit(most))).otherwise(F.col("_text")))
    listed = sample.join(names.where("name IS NOT NULL"), key, "left").groupBy(*key, "_text", "h").agg(F.sort_array(F.collect_set("name")).alias("names"))
    pdf = listed.toPandas().sort_values(["h", *key])
    return label_texts(pdf["_text"].tolist(), [list(x) for x in pdf["names"]])


def person_names(extracted: DataFrame) -> DataFrame:
    """(group_id, uuid, name) of ``extracted(group_id, episode_uuid, name, entity_type_id)``: the names that most valid types of the journal call a person's."""
    typed = extracted.where("name IS NOT NULL AND entity_type_id BETWEEN 1 AND 4")
    persons = typed.groupBy("group_id", "name").agg(F.avg((F.col("entity_type_id") == 1).cast("int")).alias("share")).where("share >= 0.5")
    places = extracted.where("name IS NOT NULL").select("group_id", F.col("episode_uuid").alias("uuid"), "name").distinct()
    return places.join(persons.select("group_id", "name"), ["group_id", "name"], "left_semi").select("group_id", "uuid", "name")


def label_texts(bodies: list[str], names: list[list[str]], seed: int = 11, forms: Forms | None = None) -> tuple[list[str], list[list[Span]], list[list[tuple[int, int]]]]:
    """(texts, spans, unsure passages): the texts as they are, and each once more with names and values exchanged and made passages between its sentences."""
    texts, spans, unsure = [], [], []
    for body, own in zip(bodies, names, strict=True):
        marked, open_ = loose_marks(body)
        marked += [s for s in name_spans(body, own) if not any(a < s[1] and s[0] < b for a, b, _ in marked)]
        texts.append(body)
        spans.append(sorted(marked))
        unsure.append(open_)
    pool = [t[a:b] for t, marked in zip(texts, spans, strict=True) for a, b, k in marked if k == "person_name"]
    r, forms = np.random.default_rng(seed), forms or Forms(seed)
    for t, marked, open_ in list(zip(texts, spans, unsure, strict=True)):
        if open_:
            continue
        new, moved, at = "", [], 0
        cuts = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)|\n+", t) if not any(a < m.end() and m.start() < b for a, b, _ in marked)]
        chosen = set(r.permutation(cuts)[: 2 + len(t) // 200]) if cuts else {len(t)}
        for a, b, k in sorted([*marked, *((int(c), int(c), "") for c in chosen)]):
            new += t[at:a]
            if not k:
                passage, inside = forms.passage()
                lead = " " if new and not new[-1].isspace() else ""
                moved += [(len(new) + len(lead) + x, len(new) + len(lead) + y, kind) for x, y, kind in inside]
                new += lead + passage + forms.pick([" ", " ", ". ", "\n"])
            else:
                piece = (_another(pool, r) if pool else t[a:b]) if k == "person_name" else forms.value(k)
                moved.append((len(new), len(new) + len(piece), k))
                new += piece
            at = b
        texts.append(new + t[at:])
        spans.append(moved)
        unsure.append([])
    return texts, spans, unsure


def _another(pool: list[str], r: np.random.Generator) -> str:
    """A name from the pool, at times joined from two of them, so that names are new but formed alike."""
    one, two = (pool[int(r.integers(len(pool)))] for _ in range(2))
    if r.random() < 0.5 and " " in one and " " in two and "," not in one + two:
        return f"{one.split()[0]} {two.split()[-1]}"
    return one


def fitted(spark: SparkSession, texts: list[str], spans: list[list[Span]], unsure: list[list[tuple[int, int]]]) -> Tagger:
    """A tagger fitted on the rows, from the shared folder where one fitted on the same rows with the same parameters is there."""
    settings = (HIDDEN, CHARS, CLASSES, PER_TEXT, LENGTH, BATCH, EPOCHS, RATE, WORKERS, ROUNDS)
    digest = hashlib.sha256(repr((settings, texts, spans, unsure)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pii-weights/{digest}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        row = spark.read.parquet(path).first()
        return Tagger(*(np.frombuffer(row[n], np.float32).reshape(getattr(Tagger.fresh(), n).shape).copy() for n in Tagger.NAMES))
    # At most WORKERS rows: the parts of a round, fitted on the executors.
    tagger = train(texts, spans, unsure, each=lambda f, work: spark.sparkContext.parallelize(work, len(work)).map(f).collect())
    spark.createDataFrame([tuple(getattr(tagger, n).astype(np.float32).tobytes() for n in Tagger.NAMES)], ", ".join(f"{n} binary" for n in Tagger.NAMES)).coalesce(1).write.mode("overwrite").parquet(path)
    return tagger


def detect(df: DataFrame, keys: list[str], text: str, tagger: Tagger) -> DataFrame:
    """(*keys, kind, start_pos, end_pos) of each passage; each distinct (keys, text) is read once."""
    shared = df.sparkSession.sparkContext.broadcast(tagger)  # a fixed number of weights
    rows = df.select(*keys, F.col(text).alias("_text")).where("_text IS NOT NULL AND _text <> ''").distinct()
    rows = rows.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism * 4))  # Python work, spread evenly whatever the files
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", kind string, start_pos bigint, end_pos bigint"
    columns = [*keys, "kind", "start_pos", "end_pos"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for a in range(0, len(frame), 2000):
                part = frame.iloc[a : a + 2000]
                found = find_spans(shared.value, part["_text"].tolist())
                yield pd.DataFrame([(*key, kind, x, y) for key, spans in zip(part[keys].itertuples(index=False), found, strict=True) for x, y, kind in spans], columns=columns)

    return rows.mapInPandas(read, schema)


def redact(df: DataFrame, keys: list[str], text: str, found: DataFrame) -> DataFrame:
    """(*keys, text) with ``[KIND]`` in place of each passage of ``found(*keys, kind, start_pos, end_pos)``; the rest unchanged."""
    marks = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("_marks"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))
    body = F.col(text)
    cut = lambda acc, m: F.struct(m["end_pos"].alias("at"), F.concat(acc["done"], F.substring(body, (acc["at"] + 1).cast("int"), (m["start_pos"] - acc["at"]).cast("int")), F.lit("["), F.upper(m["kind"]), F.lit("]")).alias("done"))
    whole = F.aggregate(F.coalesce("_marks", F.array().cast(marks.schema["_marks"].dataType)), zero, cut, lambda acc: F.concat(acc["done"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    return df.select(*keys, text).distinct().join(marks, keys, "left").select(*keys, whole.alias(text))
