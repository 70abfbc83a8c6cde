"""Trigrams as numbers: the same counts and decisions as with strings."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adherence.functions import trigrams as tg
from adherence.operators.language import LanguageModel, clean

TEXTS = ["", "ab", "abc", "aaaa", "né 字😀 x", "😀😀😀😀", "the cat sat on the mat " * 20]


def strings(text):
    return [text[k:k + 3] for k in range(len(text) - 2)]


@pytest.mark.parametrize("piece", [1, 3, 1 << 18])
def test_numbers_stand_for_the_strings(monkeypatch, piece):
    monkeypatch.setattr(tg, "PIECE", piece)
    for text in TEXTS:
        assert [tg.string(int(n)) for part in tg.pieces(text) for n in part] == strings(text)


@pytest.mark.parametrize("gathered", [1, 7, 1 << 20])
def test_counts(monkeypatch, gathered):
    monkeypatch.setattr(tg, "GATHERED", gathered)
    rows = [("x" if k % 2 else "y", t) for k, t in enumerate(TEXTS)] + [("y", None)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (0, 1)], names=["_label", "_text"])
    got = Counter()
    for out in tg.counts_by_label([batch, batch]):
        for r in out.to_pylist():
            got[r["_label"], tg.string(r["_gram"])] += r["_n"]
    assert got == Counter((label, g) for label, t in rows * 2 for g in strings(t or ""))


@pytest.mark.parametrize("table", [0, 1 << 21])
def test_best_class_against_a_plain_sum(monkeypatch, table):
    monkeypatch.setattr(tg, "TABLE", table)
    known = sorted(set(strings("the cat sat né 字😀 x")))
    grams = np.array([int(tg.numbers(g)[0]) for g in known])
    weights, prior = np.random.default_rng(1).normal(size=(3, len(known))), np.array([0.1, 0.3, 0.2])
    expected = []
    for text in TEXTS + ["unknown 猫 text", "ζζζ the"]:
        sums = prior + sum((weights[:, known.index(g)] for g in strings(text) if g in known), np.zeros(3))
        expected.append(int(sums.argmax()))
    assert list(tg.best_classes([TEXTS + ["unknown 猫 text", "ζζζ the"], [None]], grams, weights, prior)) == [expected, [None]]
    assert list(tg.best_classes([["abc"]], grams[:0], weights[:, :0], prior)) == [[1]]


def test_detection_is_the_model_s_own(spark):
    """The same languages as the fitted classifier gives over counted strings; no trigram is made a row."""
    rows = [("en", "the cat sat on the mat 😀 and the dog"), ("de", "die Katze saß auf der Matte und der Hund"),
            ("es", "el gato y el perro, https://a.b/the?the=the"), (None, "the the")]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    model = LanguageModel.fit(labelled)
    assert sorted(model.terms.vocabulary) == sorted({g for _, t in rows[:3] for g in strings(t.split("https")[0].lower() + (" " if "https" in t else ""))})
    texts = spark.createDataFrame([(k, t) for k, t in enumerate([*[t for _, t in rows], "der 😀", "?? 12", "", None, "x@y.de el gato"])], "n int, t string")
    got = {r.n: r.found for r in model.detect(texts, F.col("t"), "found").collect()}
    gram = F.udf(lambda t: strings(t), "array<string>")
    plain = texts.where(F.col("t").rlike(r"\p{L}")).withColumn("_grams", gram(clean(F.col("t"))))
    best = {r.n: model.names[int(r._best)] for r in model.bayes.transform(model.terms.transform(plain)).collect()}
    assert got == {**dict.fromkeys(range(9)), **best} and best[8] == "es"
    assert "regexp_extract_all" not in model.detect(texts, F.col("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_every_text_counts_however_many_there_are(spark, tmp_path):
    """The registered queries' model of 240,000 texts of 1,000 kinds holds each kind, as often as it stands there."""
    from registered.queries import language_model

    rows = spark.range(240_000, numPartitions=4).select(
        F.col("id").alias("doc_id"), F.expr("repeat(char(33 + id % 200) || char(33 + floor(id / 200) % 5), 2)").alias("text"),
        F.when(F.col("id") % 1_000 < 250, "a").otherwise("b").alias("lang"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    model = language_model(spark, str(tmp_path))
    # 60,000 and 180,000 texts of two trigrams each, smoothed by one
    texts, counts = {"a": 60_000, "b": 180_000}, {"a": Counter(), "b": Counter()}
    for k in range(1_000):
        for g in strings(((chr(33 + k % 200) + chr(33 + k // 200)) * 2).lower()):
            counts["a" if k < 250 else "b"][g] += 240
    vocabulary = {*counts["a"], *counts["b"]}
    assert set(model.terms.vocabulary) == vocabulary
    for y, name in enumerate(model.names):
        assert model.bayes.pi[y] == pytest.approx(np.log((texts[name] + 1) / (240_000 + 2)))
        total = 2 * texts[name] + len(vocabulary)
        got = dict(zip(model.terms.vocabulary, model.bayes.theta.toArray()[y]))
        assert got == pytest.approx({g: np.log((counts[name][g] + 1) / total) for g in vocabulary})
