"""Translated patterns against Python's own engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from adherence.functions.patterns import Refused, translate
from adherence.operators import scoring, translation
from adherence.operators.checks import Registry, default_registry
from adherence.operators.scoring import ScoringOptions

PATTERNS = [
    "the", r"[^😀]a", r"(?<=\w)!", r"(?<!😀)a", r"\bcat\b", r"[a-cx]+", r"[^a-c\s]{2,3}", r"(a|b)c", r"(?:ab|cd){1,3}", r"a.b", r"(?s:a.b)", r"^the", r"end$", r"\Athe", r"end\Z",
    r"\w+", r"\W", r"\d{2}", r"[\d-]+", r"\D\S", r"[^\W\d]+", r"\Bat", r"(?=the)t", r"(?!the)t", r"(?<=a )cat", r"(?<!a )cat", r"(\w)\1",
    r"(?P<x>c)at(?P=x)?", r"a*?b", r"a++b", r"(?>a+)b", r"[\]\[^-]", r"[A-Z][a-z]*", r"k", r"[k-s]", r"ß", r"İ", r"s", r"é", r"\.", r"\$\d", r"x{0}y?",
    r"(?i:THE) cat", r"(?m:^cat$)", r"(?x) c a t # word", r"\x41|é|\N{EM DASH}", r"", r"a?", r"\b", r"&&[&]", r"[a&&b]", r"#", r"[[]", r"\\", r"/", r"(?:)"]
TEXTS = ["", "the cat", "The CAT sat\non the mat\n", "a cat, ab abcd cdcd", "aab ab b", "12-34 x99 $5", "cat\ncat\n", "end", "end\n", "end\n\n", "café É ẞ ß ſ K k ı I i İ",
         "a\nb a\rb a b a\x85b", "--^[]{}&&&", "tt ss 字字 ａ ²½ _", "​　\x1c\x1f", "😀😀 a—b", "xy y", "aaa", " ", "a+b\\c/d#e", "𝒳!𝒳", "𐐀a😀"]


def outcomes(pattern, flags, text):
    compiled = re.compile(pattern, {"": 0, "i": re.I, "m": re.M}[flags])
    return (compiled.search(text) is not None, len(compiled.findall(text)), len(compiled.split(text)) - 1)


def test_against_python(spark):
    rows, refused = [], []
    for pattern in PATTERNS:
        for flags in ("", "i", "m"):
            try:
                java, groups = translate(pattern, flags)
            except Refused:
                refused.append((pattern, flags))
                continue
            rows += [(pattern, flags, java, groups, text) for text in TEXTS]
    # a reference back under "ignore case", and what may match nothing
    assert {r[0] for r in refused if r[1] != "i"} == {"x{0}y?", "", "a?", r"\b", "(?:)"}
    assert {r[0] for r in refused if r[1] == "i"} == {r"(\w)\1", r"(?P<x>c)at(?P=x)?", "x{0}y?", "", "a?", r"\b", "(?:)"}
    df = spark.createDataFrame(rows, "p string, flags string, java string, groups int, text string")
    got = df.select("p", "flags", "text", F.rlike("text", F.col("java")).alias("found"), F.regexp_count("text", F.col("java")).alias("n"), "groups").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.found, r.n, r.n * (r.groups + 1)) == outcomes(r.p, r.flags, r.text), (r.p, r.flags, r.text)


def random_pattern(rng, depth=0):
    atoms = ["a", "b", "c", ".", r"\w", r"\s", r"[ab]", r"[^a]", r"\b", r"\d", "1", " "]
    part = lambda: rng.choice(atoms) if depth > 2 or rng.random() < 0.7 else "(" + rng.choice(["", "?:", "?=", "?!"]) + random_pattern(rng, depth + 1) + ")"
    quantified = lambda p: p + rng.choice(["", "", "", "?", "{1,2}", "*", "+", "*?"]) if not p.startswith(r"\b") and not p.startswith(("(?=", "(?!")) else p
    out = "".join(quantified(part()) for _ in range(rng.randint(1, 4)))
    return out if rng.random() < 0.8 else out + "|" + rng.choice(atoms[:4])


def test_random_patterns(spark):
    rng, rows = random.Random(11), []
    while len(rows) < 3_000:
        pattern, flags = random_pattern(rng), rng.choice(["", "i", "m"])
        try:
            java, groups = translate(pattern, flags)
        except (Refused, re.error):
            continue
        rows += [(pattern, flags, java, groups, "".join(rng.choices("aabbc1 \nA", k=rng.randint(0, 12)))) for _ in range(3)]
    df = spark.createDataFrame(rows, "p string, flags string, java string, groups int, text string")
    for r in df.select("*", F.rlike("text", F.col("java")).alias("found"), F.regexp_count("text", F.col("java")).alias("n")).collect():
        found, n, splits = outcomes(r.p, r.flags, r.text)
        assert (r.found, r.n, r.n * (r.groups + 1)) == (found, n, splits), (r.p, r.flags, r.text)


@pytest.mark.parametrize("pattern", [r"(ab)*", r"(?:aa|b)+", r"(a?){3}", r"(?:(?:ab){50}){50}", r"(a)?(?(1)b|c)", r"(?a)\w", r"(a)\1"])
def test_refused(pattern):
    with pytest.raises(Refused):
        translate(pattern, "i")


def test_long_texts_do_not_overflow(spark):
    text = "ab " * 50_000 + "the end"
    javas = [(translate(p)[0],) for p in (r"[ab ]*the end", r".*end", r"(?:ab ){1,100}the", r"\w+\s", r"(?s:.+)\Z", r".*?end")]
    df = spark.createDataFrame(javas, "java string").select(F.rlike(F.lit(text), F.col("java")).alias("found"))
    assert all(r.found for r in df.collect())


K, FREQ, SECT, FORB, POST, START = ("keywords:existence", "keywords:frequency", "detectable_format:multiple_sections", "keywords:forbidden_words",
                                    "detectable_content:postscript", "multi-turn:constrained_start")


def pattern_registry(*more):
    return Registry([default_registry().enable()[i] for i in (K, FREQ, SECT, FORB, POST, START, *more)])


def many_samples(make_samples, extra=()):
    cases = [
        ("The cat sat. A dog", [(K, '{"keywords": ["c[ao]t", "(?<=A )dog"]}'), (FORB, '{"forbidden_words": ["d[a-z]g|x"]}')]),
        ("The cat sat. A dog", [(FREQ, '{"keyword": "[aeiou](?=t)", "frequency": 2, "relation": "at least"}'), ("unknown:thing", "{}")]),
        ("Part 1 a Part 2 b", [(SECT, '{"section_spliter": "(Part|PART)", "num_sections": 4}'), (K, '{"keywords": ["Part", "1"]}')]),
        ("bye\nNOTE: x", [(POST, '{"postscript_marker": "note[:;]"}'), (START, '{"starter": "(bye|hello)"}')]),
        ("ends", [(K, '{"keywords": ["(", "a"]}')]), (None, [(K, '{"keywords": ["a+"]}')]), ("", [(K, "not json")]), ("plain", []),
        ("The cat sat. A dog", [(K, '{"keywords": ["c[ao]t", "(?<=A )dog"]}'), (FORB, '{"forbidden_words": ["d[a-z]g|x"]}')]), *extra]
    return make_samples(*cases)


def outcome_rows(scored):
    return [tuple(map(str, r)) for r in scoring.scores_long(scored).orderBy("sample_pos", "inst_pos").collect()]


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_scores_are_the_same_without_python(make_samples, monkeypatch, broadcast):
    monkeypatch.setattr(translation, "BROADCAST_ROWS", broadcast)
    samples = many_samples(make_samples)
    plain = ScoringOptions(registry=pattern_registry())
    with_table = ScoringOptions(registry=pattern_registry(), translations=translation.translated(samples, plain))
    assert not with_table.translations.refused and with_table.translations.rows.count() == 6
    scored = scoring.score_samples(samples, with_table)
    assert outcome_rows(scored) == outcome_rows(scoring.score_samples(samples, plain))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Python" in scoring.score_samples(samples, plain)._jdf.queryExecution().executedPlan().toString()


def test_refused_patterns_still_go_to_python(make_samples):
    samples = many_samples(make_samples, [("abab cat", [(K, '{"keywords": ["(ab)*c?", "ca[t]"]}'), (FREQ, '{"keyword": "(?:ab|c)+", "frequency": 2, "relation": "at least"}')]),
                                          ('{"a": 1}', [("detectable_format:json_format", "{}")])])
    plain = ScoringOptions(registry=pattern_registry("detectable_format:json_format"))
    found = translation.translated(samples, plain)
    assert found.refused
    both = ScoringOptions(registry=plain.registry, translations=found)
    assert outcome_rows(scoring.score_samples(samples, both)) == outcome_rows(scoring.score_samples(samples, plain))


def test_no_samples_and_null_lists(spark, make_samples):
    from adherence.schemas import SAMPLES
    rows = spark.createDataFrame([("run", 1, 1, "p", "x", None, None), ("run", 2, 2, "p", "x", [K], None), ("run", 3, 3, "p", "x", [None], ["{}"])], SAMPLES)
    for samples in (rows, rows.limit(0)):
        plain = ScoringOptions(registry=pattern_registry())
        table = ScoringOptions(registry=plain.registry, translations=translation.translated(samples, plain))
        assert outcome_rows(scoring.score_samples(samples, table)) == outcome_rows(scoring.score_samples(samples, plain))
