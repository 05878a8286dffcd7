"""Scalar text functions as Column expressions; null in gives null out unless stated.

Patterns carry ``(?U)`` so that letters, blanks and word edges mean the same as in Unicode text everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Pronouns of the author, entity types, generic rooms and areas, stop words, escaped punctuation.
SELF_NAMES = ["i", "me", "my", "mine", "myself"]
ENTITY_TYPES = {1: "Person", 2: "Place", 3: "Group", 4: "Activity"}
GENERIC_PLACES = r"(?iU)^(?:(?:living|bed|bath|dining|laundry)\s*room|room|balcony|patio|porch|deck|basement|garage|attic)$"
STOP_WORDS = """a is the an and are as at be but by for if in into it no not of on or such that their then there these they
this to was will with""".split()
SEARCH_PUNCTUATION = ",.<>{}[]\"':;!@#$%^&*()-+=~?"

_EDGES = r"(?U)^\s+|\s+$"
_HEADERS = r"(?mU)^#+\s+.*$"


def strip(c: Column) -> Column:
    """Remove Unicode blanks at both ends."""
    return F.regexp_replace(c, F.lit(_EDGES), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(c, F.lit(r"(?U)\s+"), F.lit(" ")))


def _quoted(name: Column) -> Column:
    """``name`` as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def mention_pattern(name: Column) -> Column:
    """Whole-word, case-insensitive, with an optional possessive."""
    return F.concat(F.lit(r"(?iU)\b"), _quoted(name), F.lit(r"(?:['’]s)?\b"))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut_words(c: Column, limit: int) -> Column:
    """The first ``limit`` characters up to the last space among them, with dots; all of them where there is no space."""
    head = F.substring(c, 1, limit)
    return F.concat(F.regexp_replace(head, F.lit(r"(?s) [^ ]*$"), F.lit("")), F.lit("..."))


def preview(snippet: Column, limit: int = 80) -> Column:
    """One line for a listing: a leading level-one heading, else the first sentence, else a cut with dots ("" for null)."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(snippet, F.lit("")), F.lit("\r"), F.lit("")), F.lit(r"(?U)^\s+"), F.lit(""))

    def build(t: Column) -> Column:
        heading = t.startswith("# ")
        title = strip(F.regexp_extract(t, r"(?s)^# ([^\n]*)", 1))
        flat = strip(F.translate(t, "\n", " "))
        sentence = F.regexp_extract(flat, r"(?s)^[^.!?]*[.!?]", 0)
        picked = F.when(heading, title).when(sentence != "", strip(sentence)).otherwise(flat)
        open_end = ~heading & (sentence == "") & (F.length(strip(t)) >= limit)

        def finish(p: Column) -> Column:
            long = F.length(p) > limit
            head = F.when(long, F.regexp_replace(F.substring(p, 1, limit), F.lit(r"(?U)\s+$"), F.lit(""))).otherwise(p)
            dotted = F.concat(F.regexp_replace(head, F.lit(r"[.!? ]+$"), F.lit("")), F.lit("..."))
            return F.when((long | open_end) & ~head.endswith("..."), dotted).otherwise(head)

        return F.when(t == "", "").otherwise(_let(picked, finish))

    return _let(text, build)


def truncate_quote(content: Column, limit: int = 220) -> Column:
    """Without heading lines: the first sentence if it fits, else the whole if it fits, else a cut at a word ("" for null)."""
    bare = strip(F.regexp_replace(F.coalesce(content, F.lit("")), F.lit(_HEADERS), F.lit("")))

    def build(t: Column) -> Column:
        sentence = F.regexp_extract(t, r"(?s)^[^.!?]*[.!?]", 0)
        fits = (sentence != "") & (F.length(sentence) <= limit)
        return F.when(t == "", "").when(fits, sentence).when(F.length(t) <= limit, t).otherwise(_cut_words(t, limit))

    return _let(bare, build)


def entity_snippet(content: Column, name: Column, limit: int = 220) -> Column:
    """The words around the first mention of ``name``, dots where text is left out; ``truncate_quote`` without a mention."""
    clean = squeeze(F.regexp_replace(content, F.lit(_HEADERS), F.lit("")))

    def build(t: Column) -> Column:
        found = F.regexp_substr(t, mention_pattern(name))
        begin = F.regexp_instr(t, mention_pattern(name)) - 1
        size = F.length(found)
        room = F.floor((F.lit(limit) - size) / 2)
        low, high = F.greatest(F.lit(0), begin - room).cast("int"), F.least(F.length(t), begin + size + room).cast("int")
        space = F.locate(" ", F.substring(t, low + 1, begin - low))
        a = F.when((low > 0) & (space > 0), low + space).otherwise(low)
        tail = F.substring(t, begin + size + 1, high - begin - size)
        last = F.length(tail) - F.locate(" ", F.reverse(tail))
        b = F.when((high < F.length(t)) & F.contains(tail, F.lit(" ")), begin + size + last).otherwise(high)
        quote = F.concat(F.when(a > 0, "...").otherwise(""), strip(F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))), F.when(b < F.length(t), "...").otherwise(""))
        return F.when(t == "", "").when(begin < 0, truncate_quote(content, limit)).otherwise(quote)

    missing = F.coalesce(content, F.lit("")) == ""
    return F.when(missing | name.isNull() | (name == ""), truncate_quote(content, limit)).otherwise(_let(clean, build))


def entity_sentences(content: Column, name: Column, most: int = 3, target: int = 220) -> Column:
    """Up to ``most`` sentences that mention ``name``, short ones padded with what follows up to ``target`` (an array, empty for null)."""
    clean = squeeze(F.regexp_replace(F.coalesce(content, F.lit("")), F.lit(_HEADERS), F.lit("")))
    bare = lambda s: F.regexp_replace(strip(s), F.lit(r"^[^a-zA-Z]+"), F.lit(""))

    def build(parts: Column) -> Column:
        def padded(i: Column) -> Column:
            rest = F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0)))
            grow = lambda acc, s: F.when((F.length(acc) < target) & (bare(s) != ""), F.concat(acc, F.lit(" "), bare(s))).otherwise(acc)
            own = bare(F.get(parts, i))
            full = F.when(F.length(own) >= target, own).otherwise(F.aggregate(rest, own, grow))
            return F.when((F.length(own) < target) & (F.length(full) > target), _cut_words(full, target)).otherwise(full)

        hit = lambda i: F.regexp_like(F.get(parts, i), mention_pattern(name)) & (F.length(bare(F.get(parts, i))) > 10)
        places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), hit)
        return F.transform(F.slice(places, 1, most), padded)

    found = _let(F.split(clean, r"(?U)(?<=[.!?])\s+"), build)
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(found)


def token_estimate(text: Column) -> Column:
    """Mean of characters / 4 and words * 1.33, cut to a whole number."""
    words = F.size(F.filter(F.split(squeeze(text), " "), lambda w: w != ""))
    return (((F.length(text) / 4) + words * 1.33) / 2).cast("int")


def _short_title(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit), F.lit(r"[.!? ]+$"), F.lit("")), F.lit("...")))


def content_title(content: Column, limit: int = 50) -> Column:
    """The first heading with text, else the first line with text, else "Untitled"."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), strip), lambda s: s != "")
    headings = F.filter(F.transform(F.filter(lines, lambda s: s.startswith("# ")), lambda s: strip(F.substring(s, 3, 1_000_000))), lambda s: s != "")
    return F.coalesce(_short_title(F.get(headings, F.lit(0)), limit), _short_title(F.get(lines, F.lit(0)), limit), F.lit("Untitled"))


def display_title(shown: Column, name: Column, content: Column, limit: int = 50) -> Column:
    """Preview, else name, else a title from the content, cut with dots."""
    source = strip(F.coalesce(F.nullif(shown, F.lit("")), F.nullif(name, F.lit(""))))
    head = F.regexp_replace(F.substring(source, 1, limit), F.lit(r"(?U)\s+$"), F.lit(""))
    cut = F.when(head.endswith("..."), head).otherwise(F.concat(F.regexp_replace(head, F.lit(r"[.!? ]+$"), F.lit("")), F.lit("...")))
    return F.when(source.isNull(), content_title(content, limit)).when(F.length(source) <= limit, source).otherwise(cut)


def link_entities(content: Column, entities: Column, min_mentions: int = 1, exclude: list[str] | None = None) -> Column:
    """``[text](entity://uuid)`` around mentions. ``entities``: array of struct(name, uuid, mention_count), longest names first.

    Text in brackets or links stays as it is; a missing count passes; names under two characters are skipped.
    """
    kept = F.filter(entities, lambda e: (F.length(e["name"]) >= 2) & (F.coalesce(e["mention_count"], F.lit(min_mentions)) >= min_mentions) & ~e["uuid"].isin(exclude or [""]))
    indexed = F.transform(kept, lambda e, i: F.struct((-F.length(e["name"])).alias("k"), i.alias("i"), e["name"].alias("name"), e["uuid"].alias("uuid")))
    # Fixed value: the pattern round a name.
    around = lambda e: F.concat(F.lit(r"(?iU)(?<![\[/])\b("), _quoted(e["name"]), F.lit(r"(?:'s|')?)\b(?![\](])"))
    step = lambda acc, e: F.regexp_replace(acc, around(e), F.concat(F.lit("[$1](entity://"), e["uuid"], F.lit(")")))
    return F.aggregate(F.array_sort(F.coalesce(indexed, F.array().cast("array<struct<k:int,i:int,name:string,uuid:string>>"))), content, step)


def emphasize_rich(content: Column, text: Column) -> Column:
    """Console markup escaped, then ``[bold]`` around mentions of at least two characters."""
    # The patterns of markup and mention.
    escaped = F.regexp_replace(content, F.lit(r"(\\*)(\[[a-zA-Z#/@][^\[\]]*?\])"), F.lit(r"$1$1\\$2"))
    bold = F.regexp_replace(escaped, F.concat(F.lit(r"(?iU)\b("), _quoted(text), F.lit(r"(?:'s|')?)\b")), F.lit("[bold]$1[/bold]"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 2, escaped).otherwise(bold)


def emphasize_markdown(content: Column, text: Column) -> Column:
    """``**`` around mentions that are neither bold nor linked yet."""
    # Fixed value: the pattern round a mention.
    around = F.concat(F.lit(r"(?iU)(?<!\*\*)(?<![\[/])\b("), _quoted(text), F.lit(r"(?:'s|')?)\b(?!\*\*)(?!\])"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 2, content).otherwise(F.regexp_replace(content, around, F.lit("**$1**")))


def search_text(query: Column) -> Column:
    """Punctuation that means something to a search engine as blanks."""
    return squeeze(F.translate(query, SEARCH_PUNCTUATION, " " * len(SEARCH_PUNCTUATION)))


def search_tokens(query: Column) -> Column:
    """The words of a query without stop words, in order."""
    return F.filter(F.split(search_text(query), " "), lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS))


def search_query(query: Column, groups: list[str] | None = None, most: int = 128) -> Column:
    """Words joined by or, with a group filter before; "" when too long or nothing is left."""
    scope = f"(@group_id:{'|'.join(groups)})" if groups else ""
    words = F.array_join(search_tokens(query), " | ")
    long = F.size(F.split(words, " ")) + len(scope.split(" ")) >= most
    body = F.concat(F.lit(scope + " " if scope else ""), F.lit("("), words, F.lit(")"))
    return F.when(long, "").when(words == "", scope).otherwise(body)


def clean_entity_name(name: Column) -> Column:
    """Without a leading lower-case article; null for generic rooms, areas and names under two characters."""
    bare = strip(F.regexp_replace(strip(name), F.lit(r"(?U)^the\s+"), F.lit("")))
    generic = lambda c: c.rlike(GENERIC_PLACES)
    return F.when(~generic(strip(name)) & ~generic(bare) & (F.length(bare) >= 2), bare)


def is_self_name(name: Column) -> Column:
    return F.coalesce(F.lower(strip(name)).isin(SELF_NAMES), F.lit(False))


def has_first_person(text: Column) -> Column:
    """Whether a pronoun of the author stands in the text as a word (false for null)."""
    return F.coalesce(text.rlike(r"(?iU)\b(?:i|me|my|mine|myself)\b"), F.lit(False))


def edge_name(name: Column) -> Column:
    """Upper case with one underscore for each run of blanks."""
    return F.upper(F.regexp_replace(strip(name), F.lit(r"(?U)\s+"), F.lit("_")))


def unescape_dayone(text: Column) -> Column:
    """Without image references of the app's own scheme and without backslashes before punctuation."""
    # The image and escape patterns of the app's export.
    bare = F.regexp_replace(text, F.lit(r"!\[\]\(dayone-moment://[^)]+\)"), F.lit(""))
    return F.regexp_replace(bare, F.lit(r"\\([.!#*_\[\](){}+\-|`~<>,])"), F.lit("$1"))


def hyphenate_uuid(text: Column) -> Column:
    """Thirty-two hex digits, upper case, as 8-4-4-4-12."""
    up = F.upper(text)
    return F.concat_ws("-", F.substring(up, 1, 8), F.substring(up, 9, 4), F.substring(up, 13, 4), F.substring(up, 17, 4), F.substring(up, 21, 1_000))


def name_uuid(text: Column) -> Column:
    """Version-5 uuid of a text in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(text, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def excerpt(text: Column, width: int = 160) -> Column:
    """Blanks collapsed, whole words up to ``width`` with a closing ellipsis where words were dropped."""
    words = F.split(squeeze(text), " ")
    grow = lambda acc, w: F.when(F.length(acc) + F.length(w) + 1 + F.when(acc == "", -1).otherwise(0) <= width - 1, F.concat(acc, F.when(acc == "", "").otherwise(" "), w)).otherwise(F.rpad(acc, width, "\u0000"))
    cut = F.aggregate(words, F.lit(""), lambda acc, w: F.when(F.contains(acc, F.lit("\u0000")), acc).otherwise(grow(acc, w)))
    return F.when(F.length(squeeze(text)) <= width, squeeze(text)).otherwise(F.concat(F.regexp_replace(cut, F.lit("\u0000+$"), F.lit("")), F.lit("…")))


def specific_label(labels: Column) -> Column:
    """The first label other than Entity, else Entity."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x != "Entity"), F.lit(0)), F.lit("Entity"))


def type_name(type_id: Column, strict: bool = True) -> Column:
    """The entity type of an id; an unknown id raises, or is Entity where ``strict`` is off."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair]), type_id)
    if strict:
        return F.coalesce(known, F.when(F.lit(True), F.raise_error(F.concat(F.lit("unknown entity type "), F.coalesce(type_id.cast("string"), F.lit("null"))))))
    return F.coalesce(known, F.lit("Entity"))


def string_list(value: Column) -> Column:
    """An array without null and empty members; an empty array for null."""
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def parse_list(text: Column) -> Column:
    """JSON text to an array of strings; broken or missing text gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def parse_map(text: Column) -> Column:
    """JSON text to a map; broken or missing text gives an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def literal(value: Column) -> Column:
    """A string as a quoted query literal: backslashes first, then quotes; null as NULL."""
    body = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(F.concat(F.lit("'"), body, F.lit("'")), F.lit("NULL"))


def valid_journal_name(name: Column, most: int = 64) -> Column:
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9_-]+\z") & (F.length(name) <= most), F.lit(False))


def content_error(content: Column, most: int = 100_000) -> Column:
    """Why an entry is refused (null when it is fine): empty, blank, NUL inside, too long."""
    blank = F.coalesce(strip(content), F.lit("")) == ""
    return F.when(blank, "empty").when(F.contains(content, F.lit("\u0000")), "nul").when(F.length(content) > most, "too long")
