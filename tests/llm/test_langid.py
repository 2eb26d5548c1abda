import math

import numpy as np
import pytest

from gristmill.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_model_equals_the_formula(spark):
    """Two tiny languages: probabilities sum to at most 1 over the symbols and equal interpolated Kneser-Ney worked out with dictionaries."""
    texts = {"x": ["abcab", "bca"], "y": ["cccab"]}
    df = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts], "text string, lang string")
    model = langid.build(langid.counts_of(df).toArrow(), ["x", "y"])
    n = langid.ORDER
    grams = {lang: {k: {} for k in range(1, n + 1)} for lang in texts}
    for lang, ts in texts.items():
        for t in ts:
            s = "^" * (n - 1) + t
            for k in range(1, n + 1):
                for i in range(len(t)):
                    g = s[i + n - k : i + n]
                    grams[lang][k][g] = grams[lang][k].get(g, 0) + 1
    everything = {g for lang in texts for g in grams[lang][1]}

    def count(lang, k):
        return grams[lang][n] if k == n else {g: sum(1 for h in grams[lang][k + 1] if h[1:] == g) for g in grams[lang][k]}

    def p(lang, k, g):
        c = count(lang, k)
        own = {h: v for h, v in c.items() if h[:-1] == g[:-1] and v}
        total = sum(own.values())
        below = p(lang, k - 1, g[1:]) if k > 1 else 1 / (len(everything) + 1)
        if not total:
            return below
        return (max(c.get(g, 0) - langid.DISCOUNT, 0) + langid.DISCOUNT * len(own) * below) / total

    for lang in texts:
        for text in ("abcab", "cab", "aacc"):
            s = "^" * (n - 1) + text
            want = sum(math.log(p(lang, n, s[i : i + n])) for i in range(len(text)))
            got = model.log_probabilities(text)[0][model.languages.index(lang)]
            assert got == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(DOCS)
    rows = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    model = langid.train(docs)
    for junk in ("qzx wvk jjq xx vvw " * 30, "日本語のテキストです。" * 20, "", None, "123 !!"):
        assert model.classify(junk)[3]
    for foreign in ("Nel mezzo del cammin di nostra vita mi ritrovai per una selva", "Het regende de hele dag en niemand ging naar buiten vandaag hoor", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności"):
        assert model.classify(foreign)[3] and model.classify(foreign * 5)[3], foreign
    text = docs.first().text
    assert model.classify(text * 200)[0] == model.classify(text)[0]


def test_rows(spark):
    base = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de")] * 30)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 34", None), (None, "the cat", None), (3, *base[3][1:])]
    df = spark.createDataFrame([(*r, "x") for r in base + odd], "doc_id long, text string, lang string, score string")
    got = langid.predict(df).collect()
    assert len(got) == 65 and {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"]
    assert langid.predict(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null or true").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id < 60").count() >= 60


def test_every_label_is_learned(spark):
    """More labels than any list of frequent ones would hold, each with letters of its own, and few rows of most."""
    word = lambda k: "".join(chr(0x4E00 + 3 * k + j) for j in (0, 1, 2, 1))
    rows = [(40 * k + j, f"{word(k)} {word(k)[::-1]}", f"l{k:03}") for k in range(230) for j in range(30 if k == 3 else 1 + k % 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in df.where(langid.fold(df.doc_id) != 0).select("lang").distinct().collect()}
    assert len(learned) > 200
    got = langid.predict(df).join(df, "doc_id").collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got if r.lang in learned)


def test_calibration():
    """Limits from quantiles, a pooled one for a language without texts, and a power that tempers shares which are too sure."""
    model = langid.Model(["a", "b", "c"], [], [], np.zeros(3), np.zeros(3), np.full(3, math.inf))
    rng = np.random.default_rng(1)
    n = np.full(4000, 100)
    lang = np.arange(4000) % 2
    total = -200.0 + rng.normal(size=(4000, 3))
    total[np.arange(4000), lang] += 40 * (rng.random(4000) < 0.9)  # one of ten is as likely wrong
    total[0] = -10_000  # one odd text does not loosen the limit
    langid.calibrate(model, lang, total, n)
    assert (model.slack < 2).all() and model.slack[2] > 0 and model.mean[2] == pytest.approx(model.mean[:2].mean(), rel=0.05) and model.power < 1
    blank = langid.Model(["a"], [], [], np.zeros(1), np.zeros(1), np.full(1, math.inf))
    langid.calibrate(blank, np.zeros(0, int), np.zeros((0, 1)), np.zeros(0))
    assert blank.slack[0] == math.inf


def test_table_find():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = langid.Table.of(keys, keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()
