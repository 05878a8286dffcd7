import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.functions import dates, text as fx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [
    ("the gym", "gym"), ("the apt", "apt"), ("The Beatles", "The Beatles"), ("The New York Times", "The New York Times"), ("living room", None), ("BALCONY", None), ("room", None), ("the patio", None),
    ("yoga", "yoga"), ("Prospect Park", "Prospect Park"), ("a", None), ("", None), ("AB", "AB"), (None, None), ("  the   lake ", "lake"),
])
def test_entity_names(spark, given, want):
    assert one(spark, fx.clean_entity_name(F.col("n")), n=given) == want


@pytest.mark.parametrize(("given", "want"), [
    ("# Morning\n\nText. More", "Morning"), ("First one. Second", "First one."), ("line\nbreak! rest", "line break!"), ("A" * 100, "A" * 80 + "..."), (None, ""), ("", ""), ("  \n", ""), ("short", "short"),
    ("x" * 79 + ". tail", "x" * 79 + "."), ("y" * 90 + ".", "y" * 80 + "..."), ("# " + "h" * 90, "h" * 80 + "..."),
])
def test_preview(spark, given, want):
    assert one(spark, fx.preview(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [
    ("# Head\nFirst. Second.", "First."), ("word " * 60, ("word " * 44).rstrip() + "..."), ("no end", "no end"), ("", ""), ("## only\n", ""),
])
def test_truncate_quote(spark, given, want):
    assert one(spark, fx.truncate_quote(F.col("t")), t=given) == want


def test_snippet(spark):
    body = "# Head\n" + "before " * 40 + "met Ann's friend " + "after " * 40
    got = one(spark, fx.entity_snippet(F.col("t"), F.col("n")), t=body, n="ann")
    assert got.startswith("...") and got.endswith("...") and "Ann's" in got and len(got) <= 226
    assert one(spark, fx.entity_snippet(F.col("t"), F.col("n")), t="Nobody here. End", n="Zoe") == "Nobody here."
    assert one(spark, fx.entity_snippet(F.col("t"), F.col("n")), t="I saw José.", n="josé") == "I saw José."


def test_sentences(spark):
    body = "- I met Ann in town. It was cold. Ann! Then we both went home because Ann was tired. Bye."
    got = one(spark, fx.entity_sentences(F.col("t"), F.col("n"), 3, 40), t=body, n="Ann")
    assert got == ["I met Ann in town. It was cold. Ann!...", "Then we both went home because Ann was tired."]
    assert one(spark, fx.entity_sentences(F.col("t"), F.col("n")), t=None, n="Ann") == []


def test_links_and_emphasis(spark):
    ents = "array(named_struct('name','Bob','uuid','1','mention_count',3), named_struct('name','Bobby','uuid','2','mention_count',cast(null as int)), named_struct('name','x','uuid','3','mention_count',9))"
    row = spark.range(1).select(F.lit("Bobby saw bob's [Bob](u) x").alias("t"), F.expr(ents).alias("e"))
    got = row.select(fx.link_entities(F.col("t"), F.col("e")).alias("x")).first().x
    assert got == "[Bobby](entity://2) saw [bob's](entity://1) [Bob](u) x"
    assert row.select(fx.link_entities(F.col("t"), F.col("e"), 4).alias("x")).first().x == "[Bobby](entity://2) saw bob's [Bob](u) x"
    assert one(spark, fx.emphasize_markdown(F.col("t"), F.col("n")), t="Ann and **Ann** and ann's", n="Ann") == "**Ann** and **Ann** and **ann's**"
    assert one(spark, fx.emphasize_rich(F.col("t"), F.col("n")), t="Ann [b]", n="ann") == "[bold]Ann[/bold] \\[b]"
    assert one(spark, fx.emphasize_rich(F.col("t"), F.col("n")), t="Ann", n="a") == "Ann"


def test_titles_and_search(spark):
    assert one(spark, fx.display_title(F.col("p"), F.col("n"), F.col("c")), p=None, n="", c="\n\n# Head \nx") == "Head"
    assert one(spark, fx.display_title(F.col("p"), F.col("n"), F.col("c")), p=None, n=None, c=None) == "Untitled"
    assert one(spark, fx.display_title(F.col("p"), F.col("n"), F.col("c")), p="z" * 60, n=None, c=None) == "z" * 50 + "..."
    assert one(spark, fx.search_query(F.col("q"), ["g", "h"]), q="the Cat, and a (dog)!") == "(@group_id:g|h) (Cat | dog)"
    assert one(spark, fx.search_query(F.col("q")), q="the and") == ""
    assert one(spark, fx.search_query(F.col("q"), None, 4), q="one two three") == ""
    assert one(spark, fx.token_estimate(F.col("q")), q="one two three") == int((13 / 4 + 3 * 1.33) / 2)


@pytest.mark.parametrize(("given", "want"), [("knows", "KNOWS"), ("spends time with", "SPENDS_TIME_WITH"), ("  Works   At ", "WORKS_AT"), ("already_under", "ALREADY_UNDER")])
def test_edge_names(spark, given, want):
    assert one(spark, fx.edge_name(F.col("n")), n=given) == want


def test_identifiers(spark):
    for path in ("files:/a/b.txt", "xml:é:3", ""):
        assert one(spark, fx.name_uuid(F.col("p")), p=path) == str(uuid.uuid5(uuid.NAMESPACE_URL, path))
    assert one(spark, fx.hyphenate_uuid(F.col("p")), p="6f30404ab159433d8c9af57052e4f3b6") == "6F30404A-B159-433D-8C9A-F57052E4F3B6"
    assert one(spark, fx.literal(F.col("p")), p="it's a \\") == "'it\\'s a \\\\'"
    assert one(spark, fx.excerpt(F.col("p"), 12), p="one two three four") == "one two…"


def test_small_predicates(spark):
    assert [one(spark, fx.is_self_name(F.col("n")), n=n) for n in (" Me ", "Ann", None)] == [True, False, False]
    assert [one(spark, fx.has_first_person(F.col("n")), n=n) for n in ("so I went", "mine.", "time", None)] == [True, True, False, False]
    assert [one(spark, fx.content_error(F.col("n")), n=n) for n in ("", " \n", "a\0b", "x" * 100_001, "x" * 100_000)] == ["empty", "empty", "nul", "too long", None]
    assert [one(spark, fx.valid_journal_name(F.col("n")), n=n) for n in ("a-b_1", "a b", "", "x" * 65, "a\n")] == [True, False, False, False, False]
    assert one(spark, fx.type_name(F.col("n").cast("int"), False), n="9") == "Entity"
    with pytest.raises(Exception, match="unknown entity type"):
        one(spark, fx.type_name(F.col("n").cast("int")), n="0")


def test_dates(spark):
    assert one(spark, dates.entry_title(F.col("t").cast("timestamp")), t="2024-11-05") == "Tuesday Nov 5, 2024"
    assert [one(spark, dates.refused_update(F.col("t")), t=t) for t in ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "soon", None)] == [None, "no time zone", "no ISO time", "no ISO time"]
    label = dates.period_label(F.col("t").cast("timestamp"), F.lit("2025-01-08").cast("timestamp"))
    assert [one(spark, label, t=t) for t in ("2025-01-06", "2025-02-01", "2024-12-30", "2024-12-29")] == ["This Week", "This Week", "Last Week", "December 2024"]
    assert [one(spark, dates.valid_order(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), a=a, b=b) for a, b in (("2020-01-01", "2021-01-01"), ("2021-01-01", "2020-01-01"), ("2020-01-01", "2020-01-01"), (None, "2020-01-01"))] == [True, False, False, True]
