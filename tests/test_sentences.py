"""Learned sentence ends against a plain version, token by token."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adherence.operators import sentences as s
from adherence.operators.checks import Registry, default_registry
from adherence.operators.scoring import ScoringOptions, score_samples

L = "a-zA-ZäöüÄÖÜß"
WORDS = "the cat saw a dog near old house while rain fell on Green hills today".split()


def core(token):
    return token.strip(s.AROUND)


def kind(c):
    c = c[:-1] if re.search(r"(?:\A|[^.])[.]\Z", c) else c
    return c.lower() if re.fullmatch(f"[{L}](?:[{L}.]*[{L}])?", c) else None


def odds(k, n, p):
    return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)


def learned(texts):
    tokens = [(t or "").split() for t in texts]
    n, stops = Counter(), Counter()
    for w in (w for row in tokens for w in row):
        n[kind(core(w))] += 1
        stops[kind(core(w))] += bool(re.search(r"(?:\A|[^.])[.]\Z", core(w)))
    share = sum(stops.values()) / max(1, sum(n.values()))
    abbreviations = set()
    for w in n:
        if w and stops[w]:
            ratio = -2 * (odds(stops[w], n[w], share) - odds(stops[w], n[w], 0.99))
            letters = len(w.replace(".", ""))
            score = ratio * math.exp(-letters) * (w.count(".") + 1) * letters ** (stops[w] - n[w])
            abbreviations |= {w} if score >= 0.3 else set()
    n, starts = Counter(), Counter()
    for row in tokens:
        for before, token in zip(["", *row], row):
            c = core(before)
            short = kind(c) is not None and (kind(c) in abbreviations or re.fullmatch(f"(?:[{L}][.])*[{L}]", kind(c))) and c[-1:] == "."
            found = re.match(rf"{s.OPENING}([{L}0-9]+)", token)
            word = found[1].lower() if found else ""
            n[word] += 1
            starts[word] += bool(c[-1:] in tuple(".?!") and not short and c[-2:] != "..")
    total, ends, starters = sum(n.values()), sum(starts.values()), set()
    for w in n:
        if w and starts[w]:
            p, p1, p2 = n[w] / total, starts[w] / ends, (n[w] - starts[w]) / max(1, total - ends)
            k, rest = n[w] - starts[w], total - ends
            ratio = -2 * (odds(starts[w], ends, p) + odds(k, rest, p) - odds(starts[w], ends, p1) - odds(k, rest, p2))
            starters |= {w} if p1 > p and ratio >= 30 else set()
    return s.SentenceModel(tuple(sorted(abbreviations)), tuple(sorted(starters)))


def counted(model, text):
    tokens = text.split()
    n = 1 if tokens else 0
    for token, after in zip(tokens, tokens[1:]):
        if not re.search(r"[.?!][\"'”’)\]}]*\Z", token):
            continue
        if re.search(r"[.]{2}\Z", token) and not after[0].isupper():
            continue
        short = re.search(rf"(?:\A|[^{L}0-9.])([{L}](?:[{L}.]*[{L}])?)[.]\Z", token)
        if short:
            word = re.match(rf"{s.OPENING}([{L}0-9]*)", after)[1]
            if re.fullmatch(f"(?:[{L}][.])*[{L}]", short[1]):
                continue
            if short[1].lower() in model.abbreviations and not (word[:1].isupper() and word.lower() in model.starters):
                continue
        n += 1
    return n


def corpus(rng, n):
    """Sentences that begin with a few words; abbreviations stand in their middle."""
    out = [None, "", "  \n ", "..."]
    for _ in range(n):
        text = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choices(WORDS, k=rng.randint(3, 9))
            if rng.random() < 0.5:
                words.insert(rng.randrange(len(words)), rng.choice(["Dr. Lee", "approx. ten", "z.B. das", "J. R. Roe", "wait... no", "(cf. that)"]))
            end = rng.choice([".", ".", ".", "!", "?", '."', "...", "etc."])
            text.append(" ".join([rng.choice(["He", "She", "It", "Über", "Then"]), *words]) + end)
        out.append(rng.choice([" ", "\n", "  "]).join(text))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus(random.Random(3), 250)


@pytest.fixture(scope="module")
def model(spark, texts):
    return s.SentenceModel.fit(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3))


def test_learned_words_equal_the_plain_version(model, texts):
    assert model == learned(texts)
    assert {"dr", "z.b", "approx", "cf"} <= set(model.abbreviations)
    assert "he" in model.starters and "cat" not in model.starters


def test_counts_equal_the_plain_version(spark, model, texts):
    cases = [x for x in texts if x] + ["Dr. Lee. He left", "Dr. He left", "x-cf. It", "A. B. Lee came. Yes", "So... He. so... he", "a.. b", ". . .", "end. “He said"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    got = {r.k: r.n for r in df.select("k", model.count(F.col("x")).alias("n")).collect()}
    for k, x in enumerate(cases):
        assert got[k] == counted(model, x), x
    blank = spark.createDataFrame([("",), (" \n",), (None,)], "x string").select(model.count(F.col("x")).alias("n"))
    assert [r.n for r in blank.collect()] == [0, 0, None]


def test_better_than_fixed_words_where_they_are_unknown(spark, model):
    df = spark.createDataFrame([("He saw z.B. das Haus approx. ten times. She left",)], "x string")
    from adherence.functions import text as t
    assert df.select(model.count(F.col("x")), t.sentence_count(F.col("x"))).first() == (2, 3)


def test_empty_and_one_sided_corpora(spark):
    empty = spark.createDataFrame([], "text string")
    assert s.SentenceModel.fit(empty, known=["Mr"]) == s.SentenceModel(("mr",), ())
    for values in ([None, ""], ["no stops here"], ["all. stops. here."], ["one"], ["."]):
        rows = spark.createDataFrame([(v,) for v in values], "text string")
        assert s.SentenceModel.fit(rows) == learned(values)


def test_hot_document_and_long_text(spark):
    values = ["The end of etc. that " * 3_000 + "x."] * 3 + ["a" * 50_000 + ".", "word " * 20_000]
    rows = spark.createDataFrame([(v,) for v in values], "text string")
    assert s.SentenceModel.fit(rows) == learned(values)


def test_model_as_a_table(spark, model, tmp_path):
    model.table(spark).write.parquet(str(tmp_path / "model"))
    assert s.SentenceModel.read(spark.read.parquet(str(tmp_path / "model"))) == model


def test_check_uses_the_model(spark, make_samples, model):
    rows = make_samples(("He saw approx. ten. She left", [("length_constraints:number_sentences", '{"num_sentences": 3, "relation": "less than"}')]))
    registry = Registry([default_registry()["length_constraints:number_sentences"]])
    verdict = lambda m: score_samples(rows, ScoringOptions(registry=registry, sentence_model=m)).first().prompt_strict_pass
    assert verdict(model) is True and verdict(None) is False
    plan = score_samples(rows, ScoringOptions(registry=registry, sentence_model=model))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
