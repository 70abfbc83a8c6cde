import os
import random

import numpy as np
import pytest

from adherence.llm import quality

SF = "/root/testdata/sf0.01"


def plain_score(model, text):
    """The network, position by position."""
    data = list(text.encode().ljust(quality.TAPS))
    step = quality.CHUNK - quality.OVERLAP
    pooled = []
    for start in range(0, max(1, len(data) - quality.OVERLAP), step):
        chunk = data[start:start + quality.CHUNK]
        places = [sum(model.taps[k][chunk[p + k]] for k in range(quality.TAPS)) for p in range(len(chunk) - quality.TAPS + 1)]
        pooled.append(np.maximum(np.max(places, axis=0) + model.bias, 0))
    features = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)])
    return 1 / (1 + np.exp(-(features @ model.weights + model.offset)))


def test_scores_equal_the_definition():
    rng = np.random.default_rng(3)
    model = quality.start_model(rng)
    for text in ["", "a", "héllo wörld", "x" * 511, "x" * 512, "y" * 513, "some words and " * 200, "z" * (448 * 3 + 64)]:
        assert model.score(text) == pytest.approx(float(plain_score(model, text)), abs=1e-4)


def test_gradients_point_the_right_way():
    good, bad = ["plain words here and there " * 5] * 40, ["SHOUT!! LOUD!! TEXT!! " * 5] * 40
    texts = [quality.chunks_of(t + str(k)) for k, t in enumerate(good + bad)]
    model = quality.train(texts, np.array([1.0] * 40 + [0.0] * 40), epochs=10)
    assert model.score("other words are here too " * 9) > 0.6 > 0.4 > model.score("VERY!! LOUD!! INDEED!! " * 9)


def test_rows(spark, texts):
    docs = texts(["good words are here", None, "", "BAD!! BAD!!", "BAD!! BAD!!", "w " * 80_000], ids=[0, 1, 2, 3, 3, None])
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (3, 0, 1), (9, 1, 0), (2, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, text int")
    rows = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    assert sorted(repr(r.doc_id) for r in rows) == ["0", "1", "2", "3", "3", "None"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    unlabelled = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score_quality(docs, unlabelled).collect()} == {0.5}
    assert quality.score_quality(texts([]), unlabelled).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    from adherence.llm.queries import op6_quality_classifier

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op6_quality_classifier(spark, SF).where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    scores, ones = np.array([r.score for r in rows]), np.array([r.quality for r in rows]) == 1
    area = np.mean(scores[ones][:, None] > scores[~ones][None, :])
    assert right >= 0.9 and area >= 0.95


def test_learned_from_whole_texts(spark):
    """What tells the labels apart stands far behind in long texts."""
    rng = random.Random(9)
    filler = lambda: " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=2_500))
    rows = [(k, filler() + (" zq" * 40 if k % 2 else " vw" * 40) + " " + filler(), k % 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs.drop("quality"), docs.drop("text"))
    assert sum((model.score(t) >= 0.5) == bool(y) for _, t, y in rows) >= 57


def test_fewer_rows_where_texts_are_long(spark):
    docs = spark.createDataFrame([(k, "x" * 10_000, k % 2) for k in range(100)], "doc_id long, text string, quality int")
    seen = []
    real = quality.train
    try:
        quality.train = lambda texts, labels, epochs: seen.append(len(texts)) or real(texts[:2], labels[:2], 1)
        quality.fit(docs.drop("quality"), docs.drop("text"), size=200_000)
    finally:
        quality.train = real
    assert 5 <= seen[0] <= 40
