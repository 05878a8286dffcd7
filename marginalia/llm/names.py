"""Variant spellings of names typed by people.

Every distinct name of a journal is read into points of an edit-distance space: its full form (folded letters, given
name spelled out, tokens in two orders) and, for full names, the short forms it may have (surname, given name, initial with surname,
cut given name with surname, given name with initial, acronym, leading words). Points lie in scopes (journal, kind of form, initial), and only points
of one scope are compared.

The comparison is a metric-space partitioned radius join: each scope has pivots, a point lives in the cell of its
nearest pivot and is copied to every cell whose pivot lies within its nearest distance plus twice the radius
(triangle inequality), and an exact join with the true Levenshtein metric at radius 2 runs inside each cell. Of its pairs
count those one edit apart, two swapped neighbours (two edits), and two edits in long texts.

Every text is compared twice, as folded and after letters that sound alike are made one, in scopes of their own: a slip
that makes or breaks a group of such letters (qu, ch, rn) is one edit as typed and several as heard. Texts of several words
are also compared word by word: a slip in one word, in long texts in each of two. Initials between given name and surname are not compared.

Matches of full forms give the base groups; a group of short forms joins the one group of full names that it fits, and
stays alone where several fit. Defined results: null, blank and one-letter names, the self entity, activities and rooms
give no row; repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .components import connected_components

#: Levenshtein radius of the join, pivots of a cell, points from which a cell is split again, the share of its pairs that a
#: split must save, and points of a block of a cell that pivots cannot split.
RADIUS, PIVOTS, CELL, SAVED, BLOCK = 2, 16, 150, 0.3, 2000
#: Texts, and words compared alone, shorter than this must agree exactly; texts from ``LONG`` letters may have two slips, and
#: one word two slips from ``LONG_WORD`` letters.
TYPO_LENGTH, LONG, LONG_WORD = 5, 12, 9

# Titles, nicknames, abbreviations, generic rooms and areas; lower case, without accents.
TITLES = set("dr prof mr mrs ms miss mme mlle frau herr sir dame doctor professor sig sra sr dott fr rev".split())
NICKNAMES = {
    "alexander": "alex sasha sandy", "andrzej": "andy", "bartholomew": "bart barty", "beatrice": "bea trixie", "benjamin": "ben benny", "bernard": "bernie",
    "bettina": "tina", "brigitta": "gitta", "christopher": "chris kit", "daniela": "dani", "desmond": "des", "dmitri": "dima mitya",
    "donatella": "dona", "dorothea": "thea dora dot", "edmund": "ed eddie ned", "elena": "nell lena", "elizabeth": "liz betty beth lizzie eliza", "esther": "essie", "florian": "flo",
    "frederick": "fred freddie freddy", "gabriel": "gabe", "giulia": "giuli", "gregory": "greg", "gwendolyn": "gwen", "harriet": "hattie", "hildegard": "hilde hilda",
    "ignacio": "nacho", "isabella": "izzy bella", "jacqueline": "jackie", "jerome": "jerry", "jose": "pepe", "josephine": "josie jo", "katherine": "kate kathy katie kat",
    "konstantin": "kostya", "leopold": "leo poldi", "lorenzo": "renzo", "ludmila": "mila lyuda", "margaret": "maggie meg peggy", "marta": "marti", "matteo": "teo", "maximilian": "max",
    "natasha": "tasha", "nathaniel": "nat nate", "nikolai": "kolya niko", "octavia": "tavia", "olympia": "oly", "ottilie": "otti tilly", "patrick": "pat paddy", "petronella": "nella petra",
    "philippa": "pippa pip", "rafael": "rafa", "rebecca": "becky becca", "rosalind": "roz ros", "samuel": "sam sammy", "solveig": "solvi", "stefan": "steff", "tamara": "toma",
    "thaddeus": "tad thad", "theodore": "theo ted teddy", "tobias": "tobi toby", "ulrich": "uli", "valentina": "valya", "veronika": "vroni", "vincent": "vinnie vince",
    "wilhelm": "willi willy", "winifred": "winnie", "yevgenia": "zhenya", "zachary": "zach zack", "zofia": "zosia",
}
GIVEN = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()}
WORDS = {
    "mus": "museum", "pk": "park", "soc": "society", "lib": "library", "obs": "observatory", "assoc": "association", "assn": "association", "pharm": "pharmacy", "terr": "terrace",
    "co": "company", "sq": "square", "st": "street", "stn": "station", "rd": "road", "ln": "lane", "br": "bridge", "cem": "cemetery", "mkt": "market", "th": "theatre", "thea": "theatre", "theater": "theatre",
    "rly": "railway", "cl": "club", "grp": "group", "hosp": "hospital", "ctr": "centre", "center": "centre", "univ": "university", "gdn": "garden", "val": "valley", "cafe": "cafe", "harbor": "harbour",
}
THINGS = set("""library observatory lake bookshop station railway cafe swimming pool museum bridge pharmacy cemetery park theatre market choir club mill housing
association chess garden book gardening circle rowing group square common corner road robotics river team society wharf hill lane union credit terrace
cycling brothers gate clinic company street valley school church hospital""".split())  # fmt: skip
_BONES = Counter(w[0] + re.sub("[aeiou]", "", w[1:]) for w in THINGS)
#: Words written without their vowels (brdg) where only one word is written so; from four letters, as shorter ones are also names cut short (Chr.).
BARE = {b: w for w in sorted(THINGS) if len(b := w[0] + re.sub("[aeiou]", "", w[1:])) >= 4 and _BONES[b] == 1 and b != w and b[0] not in "aeiou"}
ROOMS = re.compile(r"^(?:the )?(?:living|dining|laundry|bath|bed|guest|waiting|rest|store)?\s?(?:room|rooms|kitchen|balcony|patio|porch|deck|basement|garage|attic|hallway|hall|closet|bedroom|bathroom|yard|backyard|driveway)$")
SELF_NAMES = {"i", "me", "my", "mine", "myself"}

PERSON, THING, ACTIVITY = 1, 2, 4
POINT = "group_id string, name string, scope string, text string, typed string, role string"


def fold(text: str) -> str:
    """Lower case without accents; letters that have no accent form are spelled plainly."""
    text = unicodedata.normalize("NFD", text.replace(" ", " ").casefold())
    text = "".join(c for c in text if unicodedata.category(c) != "Mn")
    for a, b in (("ø", "o"), ("ł", "l"), ("æ", "ae"), ("œ", "oe"), ("đ", "d"), ("ı", "i")):
        text = text.replace(a, b)
    return text


def sound(text: str) -> str:
    """One spelling for letters that are read, heard or recognised alike (digits in words, m and rn, k and ch, f and ph)."""
    text = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", text)
    text = re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", text)
    text = re.sub(r"(?<=[a-z])5|5(?=[a-z])", "s", text)
    for a, b in (("rn", "m"), ("sch", "sk"), ("ck", "k"), ("ch", "k"), ("ph", "f"), ("qu", "kw"), ("c", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("l", "i")):
        text = text.replace(a, b)
    return text


def spelled_out(word: str) -> str:
    return WORDS.get(word) or BARE.get(word, word)


def tokens(name: str) -> tuple[list[str], bool, list[bool]]:
    """(folded words, whether a comma put the surname first, which words ended in a point)."""
    name = re.sub(r"(?<=[^\W\d_])[’'`]s\b", "", name.strip())
    name = re.sub(r"([a-zà-ÿ])([A-ZÀ-Þ])", r"\1 \2", name) if not re.search(r"\s", name.strip()) else name
    comma = bool(re.search(r"\S,\s*\S", name))
    raw = [w for w in re.split(r"[\s,\-_/]+", fold(name)) if w.strip(".'’\"()")]
    return [w.strip(".,'’\"()") for w in raw], comma, [w.endswith(".") for w in raw]


def points(name: str, kind: int) -> list[tuple[str, str, str]]:
    """(scope, text as typed, role): role 'full' or 'short' for what the name is, 'derived' for short forms it may have."""
    words, comma, dotted = tokens(name)
    if not words or (len(words) == 1 and len(words[0]) < 2):
        return []
    joined = " ".join(words)
    if joined in SELF_NAMES or ROOMS.match(joined):
        return []
    if kind == THING:
        return _thing(name, words, comma)
    titled = words[0] in TITLES and len(words) > 1
    pairs = [(w, d) for w, d in zip(words, dotted, strict=True) if w not in TITLES] or [(words[0], dotted[0])]
    words, dotted = [w for w, _ in pairs], [d for _, d in pairs]
    long = [(w, d) for w, d in pairs if len(w) > 1]
    single = [w for w, _ in pairs if len(w) == 1]
    if not long:
        return []
    if len(long) == 1:
        word = long[0][0]
        if single and words[0] in single and not comma:  # initial and surname
            return [(f"I|{sound(single[0])}", word, "short")]
        if single and comma:  # surname, initial
            return [(f"I|{sound(single[0])}", word, "short")]
        if single:  # given name and initial of the surname
            given = GIVEN.get(long[0][0], long[0][0])
            return [(f"J|{sound(single[0])}", given, "short"), (f"I|{sound(single[0])}", word, "short")]
        if titled:
            return [("S", word, "short")]
        given = GIVEN.get(long[0][0], long[0][0])
        return list(dict.fromkeys([("S", word, "short"), ("G", given, "short"), ("N", word, "single"), ("N", given, "single")]))
    if len(long) == 2 and long[0][1] and 2 <= len(long[0][0]) <= 4:  # cut given name and surname
        return [(f"A|{sound(long[0][0])[:2]}", long[1][0], "short")]
    if comma:
        long = [*long[1:], long[0]]
    given, family = long[0][0], long[-1][0]
    # Initials between are not compared: two of them are one edit apart, and people leave them out.
    full = [GIVEN.get(w, w) for w, _ in long]
    out = [("F", " ".join(full), "full")]
    if not comma:  # surname first without a comma: the other order as well
        out.append(("F", " ".join([*full[1:], full[0]]), "turned"))
    for g, f in {(given, family), (family, given)} if not comma else {(given, family)}:
        g_full = GIVEN.get(g, g)
        role = "derived" if (g, f) == (given, family) else "perhaps"
        out += [(f"I|{sound(g[0])}", f, role), (f"I|{sound(g_full[0])}", f, role), ("S", f, role), ("G", g_full, role), (f"J|{sound(f[0])}", g_full, role), (f"A|{sound(g_full)[:2]}", f, role), (f"A|{sound(g)[:2]}", f, role)]
    return list(dict.fromkeys(out))


def _thing(name: str, words: list[str], comma: bool) -> list[tuple[str, str, str]]:
    if words[0] in ("the", "a", "an") and len(words) > 1:
        words = words[1:]
    letters = re.fullmatch(r"(?:[A-Za-z]\.?\s?){2,6}", name.strip())
    if letters and name.strip().upper() == name.strip():
        return [("C", "".join(c for c in fold(name) if c.isalpha()), "short")]
    words = [spelled_out(w) for w in words]
    out = [("T", " ".join(words), "full")]
    if len(words) > 1:
        out.append(("T", " ".join(sorted(words, key=sound)), "sorted"))
    if len(words) >= 3:
        for cut in range(1, len(words)):
            out.append(("L", " ".join(words[:cut]), "derived"))
        out.append(("C", "".join(w[0] for w in words), "derived"))
        skip = [w for w in words if w not in ("of", "the", "and")]
        out.append(("C", "".join(w[0] for w in skip), "derived"))
    if not words[-1] in THINGS or len(words) <= 2:
        out.append(("L", " ".join(words), "short"))
    return list(dict.fromkeys(out))


def kinds_of(name: str, types: dict[int, int]) -> list[int]:
    """Person, thing (place or group) or activity: the words of the name first, then the majority of valid types.

    Types are often wrong: a name typed as a thing without a word for one is read both ways.
    """
    words, _, _ = tokens(name)
    votes = Counter()
    for t, n in types.items():
        if t in (1, 2, 3, 4):
            votes[THING if t in (2, 3) else t] += n
    kind = max(sorted(votes), key=votes.get) if votes else PERSON
    if any(spelled_out(w) in THINGS for w in words) and not (words and words[0] in TITLES):
        return [ACTIVITY] if kind == ACTIVITY and name == name.lower() else [THING]
    if re.fullmatch(r"(?:[A-Z]\.\s?){3,6}", name.strip()):
        return [THING]
    return [PERSON, THING] if kind == THING else [kind]


def name_points(rows: DataFrame) -> DataFrame:
    """(group_id, name, scope, text, typed, role) of the distinct names, ``text`` as it sounds (acronyms as typed); types are counted before, in the JVM."""
    counts = rows.where("group_id IS NOT NULL AND name IS NOT NULL").groupBy("group_id", "name", "entity_type_id").agg(F.count("*").alias("n"))
    names = counts.groupBy("group_id", "name").agg(F.collect_list(F.struct(F.coalesce("entity_type_id", F.lit(0)).alias("t"), "n")).alias("types"))  # one entry a type

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for group, name, types in zip(frame["group_id"], frame["name"], frame["types"], strict=True):
                for kind in kinds_of(name, {x["t"]: x["n"] for x in types}):
                    out += [] if kind == ACTIVITY else [(group, name, scope, typed if scope == "C" else sound(typed), typed, role) for scope, typed, role in points(name, kind)]
            yield pd.DataFrame(out, columns=["group_id", "name", "scope", "text", "typed", "role"])

    return names.mapInPandas(read, POINT)


def _split(cells: DataFrame, depth: int, disk: Scratch) -> DataFrame:
    """``cells(scope, cell, text, home)`` with ``child``, the cells below: a point lives with its nearest pivot and is copied to
    every pivot within that distance plus twice the radius (triangle inequality)."""
    # Pivots: of each of PIVOTS hash slots the text first in hash order, aggregated map-side.
    slot = F.pmod(F.xxhash64("text", F.lit(depth)), F.lit(PIVOTS))
    firsts = cells.groupBy("cell", slot.alias("slot")).agg(F.min_by("text", F.xxhash64("text")).alias("p"))
    pivots = firsts.groupBy("cell").agg(F.sort_array(F.collect_list("p")).alias("pivots"))  # PIVOTS entries
    joined = cells.join(pivots, "cell").withColumn("d", F.transform("pivots", lambda p: F.levenshtein(F.col("text"), p))).withColumn("least", F.array_min("d"))
    home = F.array_position("d", F.col("least")).cast("int") - 1
    near = F.filter(F.transform("d", lambda x, i: F.when(x <= F.col("least") + 2 * RADIUS, i)), lambda i: i.isNotNull())
    joined = joined.withColumn("home_no", home).withColumn("no", F.explode(near))
    child = F.concat_ws("/", "cell", F.col("no").cast("string")).alias("child")
    return disk.save(joined.select("scope", "cell", "text", "home", child, (F.col("home") & (F.col("no") == F.col("home_no"))).alias("child_home")))


def radius_join(texts: DataFrame, disk: Scratch) -> DataFrame:
    """(scope, a, b, d): pairs of different texts of one ``scope`` within ``RADIUS`` Levenshtein edits, each pair once.

    ``texts(scope, text)`` must be distinct. The first pivot is the empty text: the distance to it is the length, so a
    point lives in the ring of its length and is copied to the next ones within the radius. Cells above ``CELL`` points
    are split by pivots of their own, again and again while a split saves ``SAVED`` of the pairs to compare; where distances
    are too alike for that, the cell is cut into blocks of ``BLOCK`` points, each of which meets the whole cell in a task of its
    own. A pair is compared only where one of the two is at home, and every pair is: the home cell of either holds the
    other or a copy of it. Before the edit distance, the letters that only one of the two has are counted: an edit changes two at most.
    """
    ring = F.explode(F.sequence(F.length("text"), F.length("text") + RADIUS))
    cells = texts.select("scope", "text", ring.alias("ring")).select("scope", F.concat_ws("#", "scope", F.col("ring").cast("string")).alias("cell"), "text", (F.col("ring") == F.length("text")).alias("home"))
    done, depth = None, 0
    while True:
        cells = disk.save(cells)
        sizes = cells.groupBy("cell").agg(F.count("*").alias("size"), F.max("home").alias("any"))
        cells = cells.join(sizes.where(~F.col("any")), "cell", "left_anti")  # copies alone have nothing to meet
        big = disk.save(sizes.where(F.col("any") & (F.col("size") > CELL)))
        small = cells.join(big, "cell", "left_anti").select("scope", "cell", "text", "home")
        done = small if done is None else done.unionAll(small)
        if big.isEmpty():
            break
        large = cells.join(big.select("cell"), "cell", "left_semi")
        split = _split(large, depth, disk)
        pairs = split.groupBy("cell", "child").agg(F.count("*").alias("n"), F.sum(F.col("child_home").cast("bigint")).alias("h")).groupBy("cell").agg(F.sum(F.col("n") * F.col("h")).alias("after"))
        whole = large.groupBy("cell").agg((F.count("*") * F.sum(F.col("home").cast("bigint"))).alias("before"))
        worth = disk.save(pairs.join(whole, "cell").where(F.col("after") < (1 - SAVED) * F.col("before")).select("cell"))
        done = done.unionAll(large.join(worth, "cell", "left_anti").select("scope", "cell", "text", "home"))
        cells = split.join(worth, "cell", "left_semi").select("scope", F.col("child").alias("cell"), "text", F.col("child_home").alias("home"))
        depth += 1
    done = disk.save(done.withColumn("letters", _letters(F.col("text"))))
    blocks = done.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    done = done.join(blocks, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = done.where("home").select("scope", "cell", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int").alias("block"), F.col("text").alias("x"), F.col("letters").alias("lx"))
    right = done.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("text").alias("y"), F.col("home").alias("hy"), F.col("letters").alias("ly"))
    # Two points at home in one cell meet once, a copy meets those at home.
    met = left.join(right, ["cell", "block"]).where((F.col("x") != F.col("y")) & (~F.col("hy") | (F.col("x") < F.col("y"))))
    met = met.where(F.bit_count(F.col("lx").bitwiseXOR(F.col("ly"))) <= 2 * RADIUS)
    near = met.withColumn("d", F.levenshtein("x", "y", RADIUS)).where(F.col("d").between(1, RADIUS))
    return near.select("scope", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d").distinct()


def _letters(text: Column) -> Column:
    """The set of letters of a text as bits of a number (letters other than a to z share bits)."""
    codes = F.transform(F.split(text, ""), lambda c: F.pmod(F.ascii(c), F.lit(62)))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c)))


def slip(a: str, b: str, d: str, whole: Column) -> Column:
    """Whether two texts ``d`` edits apart are slips of each other: one edit, two neighbours swapped, or two edits in a long text.

    A ``whole`` text may have them in two words or in a long word; a word alone must be long for two.
    """
    x, y = F.col(a), F.col(b)
    turned = lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x)))
    swap = (F.length(x) == F.length(y)) & F.exists(F.sequence(F.lit(1), F.length(x) - 1), lambda i: turned(i) == y)
    least = F.least(F.length(x), F.length(y))
    allowed = lambda w, v: F.levenshtein(w, v) <= F.when(F.least(F.length(w), F.length(v)) >= LONG_WORD, 2).otherwise(1)
    by_word = (F.size(F.split(x, " ")) == F.size(F.split(y, " "))) & F.forall(F.zip_with(F.split(x, " "), F.split(y, " "), allowed), lambda ok: ok)
    two = F.when(whole, (least >= LONG) & by_word).otherwise(least >= LONG_WORD)
    return (F.col(d) == 1) | swap | two


def one_slip(forms: DataFrame, disk: Scratch) -> DataFrame:
    """(scope, a, b): pairs of different texts of the distinct ``forms(scope, text, typed)`` that are slips of each other, as they sound or as typed.

    Scopes begin with x for whole texts and w for words.
    """
    long = lambda way, c: forms.where(F.length(c) >= TYPO_LENGTH).select(F.concat(F.lit(way), "scope").alias("scope"), F.col(c).alias("text")).distinct()
    both = disk.save(long("h", "text").unionAll(long("t", "typed")))  # as heard, as typed: scopes of their own
    near = radius_join(both, disk).where(slip("a", "b", "d", F.substring("scope", 2, 1) == "x")).select(F.substring("scope", 1, 1).alias("way"), F.expr("substring(scope, 2)").alias("scope"), "a", "b")
    near = disk.save(near)
    heard = lambda c: forms.select("scope", F.col("typed").alias(c), F.col("text").alias(f"{c}_text"))
    typed = near.where("way = 't'").join(heard("a"), ["scope", "a"]).join(heard("b"), ["scope", "b"]).where("a_text <> b_text")
    typed = typed.select("scope", F.least("a_text", "b_text").alias("a"), F.greatest("a_text", "b_text").alias("b"))
    return disk.save(near.where("way = 'h'").select("scope", "a", "b").unionAll(typed).distinct())


def by_words(texts: DataFrame, near: DataFrame, disk: Scratch) -> DataFrame:
    """(scope, a, b): pairs of the distinct ``texts(scope, text)`` that differ in one word, or in two where they are long, each by a pair of ``near(scope, a, b)``.

    Found by equality of the text in which the words are replaced by the words near them.
    """
    near = near.select("scope", F.col("a").alias("w"), F.col("b").alias("v")).unionAll(near.select("scope", F.col("b").alias("w"), F.col("a").alias("v")))
    at = disk.save(texts.select("scope", "text", F.posexplode(F.split("text", " ")).alias("i", "w")).join(near, ["scope", "w"]).select("scope", "text", "i", "v"))
    words = F.split("text", " ")
    one = at.select("scope", F.col("text").alias("a"), F.array_join(F.transform(words, lambda w, k: F.when(k == F.col("i"), F.col("v")).otherwise(w)), " ").alias("b"))
    pairs = at.where(F.length("text") >= LONG).join(at.select("scope", "text", F.col("i").alias("j"), F.col("v").alias("u")), ["scope", "text"]).where("i < j")
    two = pairs.select("scope", F.col("text").alias("a"), F.array_join(F.transform(words, lambda w, k: F.when(k == F.col("i"), F.col("v")).when(k == F.col("j"), F.col("u")).otherwise(w)), " ").alias("b"))
    return one.unionAll(two).where("a < b").join(texts.select("scope", F.col("text").alias("b")), ["scope", "b"], "left_semi").select("scope", "a", "b")


def slips_of(pts: DataFrame, disk: Scratch) -> DataFrame:
    """(scope, a, b): pairs of different texts of ``pts(scope, text, typed)`` that are slips of each other, as a whole or word by word."""
    forms = disk.save(pts.select("scope", "text", "typed").distinct())
    several = forms.where("text LIKE '% %'")
    word = F.explode(F.arrays_zip(F.split("text", " ").alias("text"), F.split("typed", " ").alias("typed"))).alias("w")
    words = several.select("scope", word).select("scope", "w.text", "w.typed").distinct()
    mark = lambda d, m: d.select(F.concat(F.lit(m), "scope").alias("scope"), "text", "typed")
    near = one_slip(disk.save(mark(forms, "x").unionAll(mark(words, "w"))), disk)  # whole texts and words: scopes of their own
    near = near.select(F.substring("scope", 1, 1).alias("m"), F.expr("substring(scope, 2)").alias("scope"), "a", "b")
    parts = by_words(several.select("scope", "text").distinct(), near.where("m = 'w'").drop("m"), disk)
    return disk.save(near.where("m = 'x'").drop("m").unionAll(parts).distinct())


def link_names(rows: DataFrame) -> DataFrame:
    """(group_id, name, entity) for the names of ``rows(group_id, name, entity_type_id)`` linked to another; ``entity`` names the group of spellings."""
    disk = Scratch(rows.sparkSession, "names")
    pts = name_points(rows).withColumn("scope", F.concat_ws("|", "group_id", "scope"))
    pts = disk.save(pts.distinct())
    slips = slips_of(pts, disk)
    pts = pts.drop("typed").distinct()
    texts = pts.select("scope", "text").distinct()
    both = slips.unionAll(slips.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    same = texts.select("scope", F.col("text").alias("a"), F.col("text").alias("b"))
    pairs = both.unionAll(same)

    # Base groups: each text stands for the names that are exactly it; texts one slip apart are linked.
    own = pts.where("role IN ('full', 'turned', 'sorted', 'single', 'short')")
    strong = own.where("role IN ('full', 'turned', 'sorted', 'single')")
    strong = strong.unionAll(own.where("role = 'short' AND scope NOT LIKE '%|G' AND scope NOT LIKE '%|L'"))
    holder = F.concat(F.lit("t:"), F.col("scope"), F.lit(":"), F.col("text"))
    to_text = strong.select("group_id", F.concat(F.lit("n:"), "name").alias("x"), holder.alias("y"))
    text_group = strong.where("role <> 'turned'").select("group_id", "scope", "text").distinct()
    ends = strong.select("group_id", "scope", "text").distinct()
    linked = slips.join(text_group.select("group_id", "scope", F.col("text").alias("a")), ["scope", "a"]).join(ends.select("scope", F.col("text").alias("b")), ["scope", "b"])
    linked2 = slips.join(text_group.select("group_id", "scope", F.col("text").alias("b")), ["scope", "b"]).join(ends.select("scope", F.col("text").alias("a")), ["scope", "a"])
    tie = lambda d: d.select("group_id", F.concat(F.lit("t:"), "scope", F.lit(":"), "a").alias("x"), F.concat(F.lit("t:"), "scope", F.lit(":"), "b").alias("y"))
    base_links = to_text.unionAll(tie(linked)).unionAll(tie(linked2))
    base = connected_components(base_links, "group_id", "x", "y").where("id LIKE 'n:%'").select("group_id", F.expr("substring(id, 3)").alias("name"), F.col("root_id").alias("base"))
    base = disk.save(base)

    # Short groups join the one full group they fit.
    role = pts.groupBy("group_id", "name").agg(F.max(F.when(F.col("scope").rlike(r"\|[FT]$") & (F.col("role") == "full"), 1).otherwise(0)).alias("full"))
    pairs = disk.save(pairs)
    short = disk.save(_resolve(pts, base, role, pairs, "role = 'short'", "role IN ('derived', 'perhaps')"))
    # A short form of a short form (leading words of leading words): one more step.
    step = short.select("group_id", F.col("base").alias("target"), F.col("target").alias("further"))
    short = short.join(step, ["group_id", "target"], "left").select("group_id", "base", F.coalesce("further", "target").alias("target"))
    out = base.join(short, ["group_id", "base"], "left").select("group_id", "name", F.coalesce("target", "base").alias("entity"))
    out = disk.save(out, keep=True)
    disk.clean()
    return out


def _resolve(pts: DataFrame, base: DataFrame, role: DataFrame, pairs: DataFrame, short_points: str, full_points: str) -> DataFrame:
    """(group_id, base, target): the base groups whose ``short_points`` fit the ``full_points`` of exactly one other full group.

    The surest readings decide: words in the order written before turned ones, texts without a slip before others.
    """
    known = base.join(role, ["group_id", "name"])
    whole = known.groupBy("group_id", "base").agg(F.max("full").alias("full")).where("full = 1").select("group_id", "base")
    full_names = base.join(whole, ["group_id", "base"]).select("group_id", "name", F.col("base").alias("target"))
    derived = pts.where(full_points).join(full_names, ["group_id", "name"]).groupBy("scope", F.col("text").alias("b"), "target").agg(F.max((F.col("role") == "derived").cast("int")).alias("sure"))
    shorts = pts.where(short_points).join(base, ["group_id", "name"]).select("group_id", "base", "scope", F.col("text").alias("a")).distinct()
    fits = shorts.join(pairs, ["scope", "a"]).join(derived, ["scope", "b"]).where("base <> target")
    fits = fits.groupBy("group_id", "base", "target").agg(F.max("sure").alias("sure"), F.max((F.col("a") == F.col("b")).cast("int")).alias("exact"))
    grade = F.col("sure") * 2 + F.col("exact")
    best = fits.groupBy("group_id", "base").agg(F.max(grade).alias("grade"))
    fits = fits.join(best, ["group_id", "base"]).where(grade == F.col("grade"))
    return fits.groupBy("group_id", "base").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(group_id, name_a, name_b), name_a < name_b by code point: every pair of spellings of one entity.

    The spellings of an entity are few (what people typed, not rows); the join is on (journal, entity).
    """
    a = linked.select("group_id", "entity", F.col("name").alias("name_a"))
    b = linked.select("group_id", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["group_id", "entity"]).where("name_a < name_b").select("group_id", "name_a", "name_b").distinct()
