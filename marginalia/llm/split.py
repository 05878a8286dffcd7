"""Oversized texts cut at natural boundaries, with overlap.

A recursive hierarchy of separators: sections (heading lines), paragraphs (blank lines), lines, sentences, words,
characters. A text is split by the coarsest separator that occurs; units still too large are split by the next one;
the units are then packed greedily into pieces up to the limit. Every piece after the first starts with the last
``overlap`` characters of the one before, so new text per piece is at most ``limit - overlap``; dropping that overlap from
each piece and joining them gives the text back exactly. Lengths are Unicode code points.

Short texts never leave the JVM; only those above the limit pass through Python, a row at a time within Arrow batches.
Defined results: null gives no piece; an empty text gives one empty piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Abbreviations whose point ends no sentence, in the languages of the texts; single letters neither.
ABBREVIATED = "Dr Mr Mrs Ms Prof St Sr Sra Jr Mme Mlle Hr Fr Nr No Abs Art bzw ca evtl ggf usw vgl vs etc approx dept est fig vol ed eds al cf pp ex env av bd tel ul ok nr str tzn np mw bl dvs".split()
_UNENDED = "".join(rf"(?<!\b{w})" for w in ABBREVIATED) + r"(?<!\b[A-Za-zÀ-Þ])"
#: Ends of units, coarsest first: what is matched stays with the unit before (a heading starts the unit after it).
SEPARATORS = [
    ("section", re.compile(r"\n(?=#{1,6} )")),
    ("paragraph", re.compile(r"(?:\r?\n[ \t]*){2,}")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(rf"(?:(?:{_UNENDED}\.|[!?…]|\.{{2,}})[.!?…]*[\"'»”’)\]]*\s+)|[。！？]+[\"'»”’」』)\]]*\s*")),
    ("word", re.compile(r"\s+")),
]


def _ends(text: str, start: int, end: int, level: int) -> list[int]:
    return [m.end() for m in SEPARATORS[level][1].finditer(text, start, end) if m.end() < end] + [end]


def _units(text: str, start: int, end: int, room: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """(end of the unit, level of its boundary) of consecutive units no longer than ``room``."""
    if level == len(SEPARATORS):
        for stop in range(start + room, end + room, room):
            yield min(stop, end), level
        return
    for stop in _ends(text, start, end, level):
        if stop - start > room:
            yield from _units(text, start, stop, room, level + 1)
        elif stop > start:
            yield stop, level
        start = stop


def split_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of ``text``; each start but the first lies ``overlap`` before the last end."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), "whole")]
    names = [*(name for name, _ in SEPARATORS), "character"]
    pieces, begin, stop, how = [], 0, 0, "whole"
    for end, level in _units(text, 0, len(text), limit - overlap):
        if end - begin > limit:
            pieces.append((begin, stop, how))
            begin = max(0, stop - overlap)
        stop, how = end, names[level]
    return [*pieces, (begin, stop, "end")]


def split_texts(df: DataFrame, text: str, keys: list[str], limit: int = 10_000, overlap: int = 200) -> DataFrame:
    """(*keys, piece_no, start_pos, end_pos, overlap_chars, boundary, piece), one row a piece.

    ``boundary`` tells what the piece ends at. Distinct rows: a text imported twice under one key gives its pieces once.
    Extra columns of ``df`` are not read.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    whole = rows.where(F.length("_text") <= limit).select(
        *keys, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_pos"), F.length("_text").cast("bigint").alias("end_pos"),
        F.lit(0).cast("bigint").alias("overlap_chars"), F.lit("whole").alias("boundary"), F.col("_text").alias("piece"),
    )
    schema = whole.schema

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                *key, body = row
                points = split_points(body, limit, overlap)
                lengths = [0, *(a[1] - b[0] for a, b in zip(points, points[1:], strict=False))]
                yield pd.DataFrame(
                    [(*key, i, a, b, o, how, body[a:b]) for i, ((a, b, how), o) in enumerate(zip(points, lengths, strict=True))], columns=schema.names
                )

    return whole.unionAll(rows.where(F.length("_text") > limit).mapInPandas(cut, schema))
