"""Readers of journal exports and the idempotent load.

All readers give ``(content, entry_time, uuid, error, warning)``; ``load_entries`` decides what is new. Nothing is gathered on the driver but
the list of paths where links must be told from files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.dates import xml_date
from ..functions.text import content_error, hyphenate_uuid, name_uuid, strip, unescape_dayone

DAYONE = T.StructType([T.StructField("entries", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("uuid", "text", "creationDate", "timeZone")])))])
#: strptime codes and their counterparts.
DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%B": "MMMM", "%b": "MMM", "%y": "yy", "%j": "DDD", "%p": "a", "%I": "hh", "%A": "EEEE", "%a": "EEE"}
# Fixed values of the rich-text format: destinations that show nothing, and control words that stand for a character.
UNSHOWN = set("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote themedata colorschememapping datastore listtable listoverridetable rsidtbl generator xmlnstbl fldinst object filetbl".split())
SIGNS = {
    "par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "\u2014", "endash": "\u2013", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d",
    "bullet": "\u2022", "emspace": "\u2003", "enspace": "\u2002", "~": "\u00a0", "_": "\u2011", "-": "", "{": "{", "}": "}", "\\": "\\", "\n": "\n", "\r": "\n",
}


def list_files(directory: str, extensions: list[str], recursive: bool = True) -> list[str]:
    """Sorted paths of regular files, neither links nor hidden below the directory, with one of the extensions (case ignored)."""
    base, wanted = Path(directory), {e.lower() for e in extensions}
    found = base.rglob("*") if recursive else base.glob("*")
    visible = (p for p in found if not any(part.startswith(".") for part in p.relative_to(base).parts))
    return sorted(str(p) for p in visible if p.is_file() and not p.is_symlink() and p.suffix.lower() in wanted)


class _Rtf:
    """A reader of rich text, after the format's description: groups nest and inherit whether they are shown and how many
    characters stand in for a Unicode one."""

    def __init__(self, data: str) -> None:
        self.data, self.at, self.out = data, 0, []
        self.shown, self.fallback, self.page, self.groups, self.owed = True, 1, "cp1252", [], 0

    def text(self) -> str:
        while self.at < len(self.data):
            c = self.data[self.at]
            self.at += 1
            if c == "{":
                self.groups.append((self.shown, self.fallback))
                self.owed = 0
            elif c == "}":
                self.shown, self.fallback = self.groups.pop() if self.groups else (True, 1)
                self.owed = 0
            elif c == "\\":
                self.control()
            elif c not in "\r\n":
                self.show(c)
        return "".join(self.out)

    def show(self, piece: str) -> None:
        if self.owed:
            self.owed -= 1
        elif self.shown:
            self.out.append(piece)

    def control(self) -> None:
        start = self.at
        while self.at < len(self.data) and "a" <= self.data[self.at] <= "z":
            self.at += 1
        word = self.data[start : self.at]
        if not word:
            self.symbol()
            return
        start = self.at
        if self.data[start : start + 1] == "-":
            self.at += 1
        while self.at < len(self.data) and self.data[self.at].isdecimal():
            self.at += 1
        digits = self.data[start : self.at]
        number = int(digits) if digits not in ("", "-") else None
        if self.data[self.at : self.at + 1] == " ":
            self.at += 1
        if word == "bin":
            self.at += max(0, number or 0)
        elif word == "uc" and number is not None:
            self.fallback = max(0, number)
        elif word == "ansicpg" and number:
            self.page = f"cp{number}"
        elif word == "u" and number is not None:
            self.show(chr(number % 65536))
            self.owed = self.fallback
        elif word in UNSHOWN:
            self.shown = False
        elif word in SIGNS:
            self.show(SIGNS[word])

    def symbol(self) -> None:
        sign = self.data[self.at : self.at + 1]
        self.at += 1
        if sign == "'":
            code = self.data[self.at : self.at + 2]
            self.at += 2
            try:
                self.show(bytes.fromhex(code).decode(self.page, "replace"))
            except (ValueError, LookupError):
                self.show("\ufffd")
        elif sign == "*":  # what a reader need not know
            self.shown = False
        elif sign in SIGNS:
            self.show(SIGNS[sign])


def rtf_text(data: str) -> str:
    """The plain text of a rich-text file; a broken file gives what can be read."""
    return _Rtf(data).text()


def _decode(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    texts, errors = [], []
    for name, data in zip(path, content, strict=True):
        try:
            text = bytes(data).decode("utf-8")
            texts.append(rtf_text(text) if name.lower().endswith(".rtf") else text)
            errors.append(None)
        except UnicodeDecodeError as problem:
            texts.append(None)
            errors.append(f"not UTF-8: {problem.reason}")
    return pd.DataFrame({"content": texts, "error": errors})


def java_pattern(code: str) -> str:
    """A strptime format as the pattern of the session's parser."""
    out, at = [], 0
    for m in re.finditer(r"%[A-Za-z%]", code):
        lit = code[at : m.start()]
        out.append("".join(f"'{c}'" if c.isalpha() else c for c in lit))
        out.append(DATE_CODES.get(m[0], m[0][1:]))
        at = m.end()
    return "".join(out) + "".join(f"'{c}'" if c.isalpha() else c for c in code[at:])


def read_files(spark: SparkSession, directory: str, extensions: list[str] = (".txt", ".text", ".md", ".markdown", ".rtf"), date_format: str | None = None, zone: str = "UTC", recursive: bool = True) -> DataFrame:
    """Text and rich-text files: date from the file name if ``date_format`` fits, else the time the file was changed (with a warning)."""
    paths = list_files(directory, list(extensions), recursive)
    empty = "content string, entry_time timestamp, uuid string, error string, warning string, path string"
    if not paths:
        return spark.createDataFrame([], empty)
    raw = spark.read.format("binaryFile").load(paths)
    decode = F.pandas_udf("content string, error string")(_decode)
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^file:/*", "/")
    rows = raw.select(path.alias("path"), "modificationTime", decode("path", "content").alias("x"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = F.to_utc_timestamp(F.try_to_timestamp(stem, F.lit(java_pattern(date_format))), zone) if date_format else F.lit(None).cast("timestamp")
    rows = rows.select("path", "modificationTime", F.col("x.content").alias("content"), F.col("x.error").alias("error"), named.alias("named"))
    warning = F.when(F.lit(date_format is not None) & F.col("named").isNull(), "no date in the file name")
    out = rows.select("content", F.coalesce("named", "modificationTime").alias("entry_time"), name_uuid(F.concat(F.lit("files:"), "path")).alias("uuid"), "error", warning.alias("warning"), "path")
    return out.where(F.col("error").isNotNull() | (strip(F.col("content")) != ""))


def read_dayone(spark: SparkSession, path: str, zones: list[str]) -> DataFrame:
    """A Day One export (JSON, or a zip holding one): (content, entry_time, zone, uuid)."""
    if path.lower().endswith(".zip"):
        def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = []
                for data in frame["content"]:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        names = [n for n in z.namelist() if n.lower().endswith(".json")]
                        texts += [z.read(names[0]).decode("utf-8")] if names else []
                yield pd.DataFrame({"value": texts})

        text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
        raw = text.select(F.from_json("value", DAYONE).alias("x")).select("x.entries")
    else:
        raw = spark.read.schema(DAYONE).json(path, multiLine=True)
    e = raw.select(F.explode("entries").alias("e")).select("e.*")
    zone = F.when(F.col("timeZone").isin(zones), F.col("timeZone")).otherwise("UTC").alias("zone")
    out = e.select(unescape_dayone(F.col("text")).alias("content"), F.try_to_timestamp("creationDate").alias("entry_time"), zone, hyphenate_uuid(F.col("uuid")).alias("uuid"))
    return out.where(strip(F.col("content")) != "")


def sanitize_xml(text: Column) -> Column:
    """Without control characters, bare ampersands escaped."""
    # The two patterns.
    plain = F.regexp_replace(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit(""))
    return F.regexp_replace(plain, F.lit(r"&(?!(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);)"), F.lit("&amp;"))


def unescape_xml(text: Column) -> Column:
    """Numeric references and the five named entities as characters, in one pass from left to right, so that nothing is decoded twice."""
    # The named entities.
    named = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#[0-9]{1,7};|&#x[0-9a-fA-F]{1,6};|&(?:lt|gt|quot|apos|amp);|[^&]+|&"), F.lit(0))

    def plain(piece: Column) -> Column:
        code = F.when(piece.rlike("^&#[0-9]+;$"), F.regexp_extract(piece, "([0-9]+)", 1).cast("int")).when(piece.rlike("^&#x[0-9a-fA-F]+;$"), F.conv(F.regexp_extract(piece, "x([0-9a-fA-F]+)", 1), 16, 10).cast("int"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        bytes_ = F.unhex(F.lpad(F.hex(code), 8, "0"))
        out = F.when(valid, F.decode(bytes_, "UTF-32"))
        for name, char in named.items():
            out = F.coalesce(out, F.when(piece == f"&{name};", F.lit(char)))
        return F.coalesce(out, piece)

    return F.array_join(F.transform(pieces, plain), "")


def posts_of(texts: DataFrame, zone: str = "UTC") -> DataFrame:
    """(path, content, entry_time, uuid) from ``texts(path, value)``: dates carry forward to the posts after them.

    Posts before any date and blank ones leave; the running number in the uuid counts kept posts. Order is that of the
    document, so the windows run inside one file.
    """
    tags = F.regexp_extract_all(sanitize_xml(F.col("value")), F.lit(r"(?s)<(date|post)>(.*?)</\1>"), F.lit(0))
    rows = texts.select("path", F.posexplode(tags).alias("pos", "tag"))
    body = strip(unescape_xml(F.regexp_extract("tag", r"(?s)^<(?:date|post)>(.*)</(?:date|post)>$", 1)))
    rows = rows.select("path", "pos", F.col("tag").startswith("<date>").alias("is_date"), body.alias("body"))
    so_far = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.last(F.when(F.col("is_date"), xml_date(F.col("body"), zone)), ignorenulls=True).over(so_far))
    kept = rows.where(~F.col("is_date") & (F.col("body") != "") & F.col("at").isNotNull())
    number = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    return kept.select("path", F.col("body").alias("content"), F.col("at").alias("entry_time"), name_uuid(F.concat(F.lit("xml:"), "path", F.lit(":"), number.cast("string"))).alias("uuid"))


def read_xml(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """A blog export of <date> and <post> elements."""
    whole = spark.read.text(path, wholetext=True)
    return posts_of(whole.select(F.col("_metadata.file_path").alias("path"), "value"), zone)


def load_entries(existing: DataFrame, incoming: DataFrame, group: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries after the load, one row (imported, skipped, refused)).

    Rows of ``incoming(content, entry_time, uuid)`` whose uuid the journal has are skipped; of copies inside one batch
    the first is imported and the rest skipped, while a dry run counts them all as imported. Refused: empty, NUL, too long.
    Rows without a uuid get one.
    """
    rows = incoming.withColumn("problem", content_error(F.col("content"))).withColumn("group_id", F.lit(group))
    # Rows without a uuid get one made of journal, text, time and the number among equal rows: the same when loaded again.
    number = F.row_number().over(Window.partitionBy("content", "entry_time").orderBy(F.lit(1)))
    made = name_uuid(F.concat_ws("|", F.lit("entry"), F.lit(group), F.coalesce(F.col("entry_time").cast("string"), F.lit("")), F.col("_n").cast("string"), F.coalesce("content", F.lit(""))))
    bare = rows.where("uuid IS NULL").withColumn("_n", number).withColumn("uuid", made).drop("_n")
    rows = rows.where("uuid IS NOT NULL").unionByName(bare)
    have = existing.where(F.col("group_id") == group).select("uuid").distinct().withColumn("_have", F.lit(True))
    copy = F.row_number().over(Window.partitionBy("uuid").orderBy("entry_time", "content"))
    marked = rows.join(have, "uuid", "left").withColumn("_copy", F.lit(1) if dry_run else copy)
    status = F.when(F.col("problem").isNotNull(), "refused").when(F.col("_have") | (F.col("_copy") > 1), "skipped").otherwise("imported")
    marked = marked.withColumn("status", status)
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0)).alias(s)
    report = marked.agg(count("imported"), count("skipped"), count("refused"))
    if dry_run:
        return existing, report
    new = marked.where("status = 'imported'").select("group_id", "uuid", F.date_format("entry_time", "EEEE MMM d, yyyy").alias("name"), "content", F.col("entry_time").alias("valid_at"))
    return existing.unionByName(new, allowMissingColumns=True), report


def gold_examples(spark: SparkSession, path: str) -> DataFrame:
    """(example, text, name, entity_type_id) of a JSON list of labelled examples."""
    schema = "episode_content string, expected_entities array<struct<name:string, entity_type_id:int>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("example", F.xxhash64("episode_content"))
    return rows.select("example", F.col("episode_content").alias("text"), F.explode_outer("expected_entities").alias("e")).select("example", "text", "e.name", "e.entity_type_id")
