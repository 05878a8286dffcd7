import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import langid as L

SENTENCES = {
    "en": ["The kettle broke this morning and nobody had time to repair it.", "We walked along the river until the rain began to fall.", "There is nothing better than a quiet evening with a book."],
    "de": ["Der Wasserkocher ist heute Morgen kaputtgegangen und niemand hatte Zeit.", "Wir gingen am Fluss entlang, bis der Regen begann.", "Es gibt nichts Besseres als einen ruhigen Abend mit einem Buch."],
    "fr": ["La bouilloire est tombée en panne ce matin et personne n'avait le temps.", "Nous avons marché le long de la rivière jusqu'à la pluie.", "Il n'y a rien de mieux qu'une soirée tranquille avec un livre."],
    "es": ["El hervidor se estropeó esta mañana y nadie tenía tiempo.", "Caminamos junto al río hasta que empezó la lluvia.", "No hay nada mejor que una tarde tranquila con un libro."],
    "ru": ["Чайник сломался сегодня утром, и ни у кого не было времени.", "Мы шли вдоль реки, пока не начался дождь.", "Нет ничего лучше тихого вечера с книгой."],
}


def frame(spark):
    rows, i = [], 0
    for code, ss in SENTENCES.items():
        for k in range(40):
            rows.append((i, f"{ss[k % 3]} {ss[k // 3 % 3]}", code if k % 9 else "en", "x"))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, passages string")


def test_labels(spark):
    for given, want in [("en-GB", "en"), (" EN ", "en"), ("English", "en"), ("swe", "sv"), ("und", None), ("", None), ("??", None), ("Русский", "ru"), ("mul", None), (None, None)]:
        assert spark.range(1).select(L.label_code(F.lit(given).cast("string")).alias("x")).first().x == want


def test_fit_and_passages(spark):
    df = frame(spark)
    model = L.fit(df, "text", "lang", "doc_id")
    hits = [L.passages(" ".join(ss), model) for ss in SENTENCES.values()]
    assert [h[0][2] for h in hits] == list(SENTENCES) and all(len(h) == 1 and h[0][0] == 0 for h in hits)
    mixed = f"{' '.join(SENTENCES['en'])}\n\n> {' '.join(SENTENCES['ru'])} – {' '.join(SENTENCES['de'])}"
    got = L.passages(mixed, model)
    assert [g[2] for g in got] == ["en", "ru", "de"]
    assert [mixed[g[0] : g[0] + 5] for g in got] == [SENTENCES[c][0][:5] for c in ("en", "ru", "de")]
    assert [L.passages(t, model) for t in (None, "", "   ", "12:30 44 / 17:05 3")] == [[], [], [], []]
    assert len(L.passages("word " * 20_000, model)) == 1
    out = L.identify(df.unionByName(spark.createDataFrame([(999, None, None, None)], df.schema)), "text", "lang", "doc_id", model)
    rows = out.collect()
    assert len(rows) == df.count() and all(0 < r.confidence <= 1 for r in rows)


def test_no_labels(spark):
    df = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    model = L.fit(df, "text", "lang", "doc_id")
    assert L.identify(df, "text", "lang", "doc_id", model).count() >= df.count()


def test_penalties_make_weights_sparse():
    rows = [(np.array([1, 2]), np.ones(2, np.float32)), (np.array([3]), np.ones(1, np.float32))] * 30
    labels = np.array([0, 1] * 30)
    dense, _ = L.fit_ftrl(rows, labels, l1=0.0)
    sparse, _ = L.fit_ftrl(rows, labels, l1=60.0)
    assert (sparse != 0).sum() < (dense != 0).sum()


def test_calibration():
    r = np.random.default_rng(0)
    truth = r.normal(size=(4000, len(L.LANGUAGES)))
    p = np.exp(truth) / np.exp(truth).sum(1, keepdims=True)
    labels = np.array([r.choice(len(L.LANGUAGES), p=x) for x in p])
    assert abs(L.calibrate(truth * 3, labels) - 3) < 0.4
