import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from adherence.llm import language_id as lid

SF = "/root/testdata/sf0.01"
ENGLISH = ["the cat sat on the mat", "where is the dog now", "this is the house that they built"] * 10
GERMAN = ["der hund ist im haus", "wo ist die katze jetzt", "das ist ein schönes haus für uns"] * 10


def slow_log_probability(raw, alphabet, word):
    """Interpolated Kneser-Ney, straight from its definition."""
    counts = [dict() for _ in range(lid.ORDER + 1)]
    for gram, n in raw.items():
        counts[len(gram)][gram] = n
    for m in range(lid.ORDER - 1, 0, -1):
        grams = {g[1:] for g in counts[m + 1]}
        for g in grams:
            if m > 1 and g[0] == " ":
                continue
            counts[m][g] = sum(1 for longer in counts[m + 1] if longer[1:] == g)

    def p(context, c):
        level = counts[len(context) + 1]
        once, twice = (sum(1 for n in level.values() if n == k) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        followers = [n for g, n in level.items() if g[:-1] == context]
        lower = p(context[1:], c) if context else 1 / alphabet
        if not followers:
            return lower
        n = level.get(context + c, 0)
        return max(n - d, 0) / sum(followers) + d * len(followers) / sum(followers) * lower

    padded = f" {word} "
    return sum(math.log(p(padded[max(0, k - lid.ORDER + 1):k], padded[k])) for k in range(1, len(padded)))


def test_scores_equal_the_definition():
    counts = {}
    for lang, lines in (("en", ENGLISH), ("de", GERMAN)):
        counts[lang] = {}
        for word in lid.words_of(" ".join(lines)):
            for gram in lid.longest_grams(word):
                counts[lang][gram] = counts[lang].get(gram, 0) + 1
    model = lid.LanguageModel.from_counts(counts)
    assert np.all(model.keys[1:] > model.keys[:-1])
    alphabet = len({c for grams in counts.values() for g in grams for c in g}) + 1
    words = ["the", "haus", "a", "xyz", "schönste", "thhh", "東京"]
    got = model.score_words(words)
    for k, word in enumerate(words):
        for j, lang in enumerate(model.languages):
            assert got[k, j] == pytest.approx(slow_log_probability(counts[lang], alphabet, word), abs=1e-4)


def test_edge_rows(spark, texts):
    docs = texts(ENGLISH + GERMAN).withColumn("lang", F.when(F.col("doc_id") < 30, "en").otherwise("de"))
    model = lid.fit(docs)
    asked = texts([None, "", "12 ½ ²!", "the dog", "die katze", "die katze", "the " * 60_000, "t" * 100_000],
                  ids=[0, 1, 2, 3, 4, 4, None, 6])
    got = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in lid.identify(asked, model).collect()), key=repr)
    assert [g[:2] for g in got if g[0] != 6] == sorted([
        (0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de"), (4, "de"), (None, "en")], key=repr)
    assert all(g[2] for g in got if g[1] == "und")
    assert lid.keep_identified(asked, model).columns == asked.columns


def test_nothing_to_learn_from(texts):
    model = lid.fit(texts([]))
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in lid.identify(texts(["abc", None]), model).collect()}
    assert got == {0: ("und", 0.0, False), 1: ("und", 0.0, True)}
    assert lid.identify(texts([]), model).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy_and_rejection(spark):
    from adherence.llm.queries import op8_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_other_scripts_are_rejected(spark, texts):
    from adherence.llm.queries import fitted_languages

    model = fitted_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    asked = texts(["Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, "qzxwv kjxq zzqw vvkx qqjz wxkz " * 10])
    assert [r.rejected for r in lid.identify(asked, model).collect()] == [True, True]
