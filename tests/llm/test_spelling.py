import random
import zlib

import numpy as np
import pytest
import regex

from adherence.llm import spelling


def edits_are_one(a, b):
    """By definition: every deletion, insertion and replacement is tried."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def expected_rows(counts, ratio=10):
    rows = {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if edits_are_one(w, x)]
        best = min(near, default=None)
        formed = best is not None and -best[0] >= ratio * n
        rows[w] = (n, len(near), best[1] if formed else None, -best[0] if formed else None)
    def root(w):
        return w if rows[w][2] is None else root(rows[w][2])
    return sorted((w, *r, root(w)) for w, r in rows.items())


def random_counts(rng, words, letters, low=1, high=9):
    found = {}
    while len(found) < words:
        base = "".join(rng.choices(letters, k=rng.randint(low, high)))
        for _ in range(rng.randint(1, 5)):
            found[base] = int(10 ** rng.uniform(0, 5))
            k = rng.randrange(len(base) + 1)
            base = base[:k] + rng.choice(["", rng.choice(letters)]) + base[k + rng.randint(0, 1):] or "x"
    return found


def grouped(spark, counts, **options):
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.variant_groups(table, **options)
    return sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3_000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in "ab")
        assert spelling.one_edit(a, b) == edits_are_one(a, b), (a, b)


@pytest.mark.parametrize("node_words,states,pairs", [(10_000, 100_000, 200_000), (5, 7, 9)])
def test_against_all_pairs(spark, monkeypatch, node_words, states, pairs):
    for name, value in (("NODE_WORDS", node_words), ("STATES", states), ("PAIRS", pairs)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(node_words)
    counts = random_counts(rng, 300, "abcdeßÀÿ字😀")
    assert grouped(spark, counts) == expected_rows(counts)
    longer = random_counts(rng, 150, "abcdefgh", 70, 90) | random_counts(rng, 150, "abc", 7, 9)
    assert grouped(spark, {w: n for w, n in longer.items() if len(w) >= 7}, min_length=7) == expected_rows(
        {w: n for w, n in longer.items() if len(w) >= 7})


def test_equal_vectors_beyond_a_node(spark, monkeypatch):
    """Words of the same letters cannot be cut apart; a node then holds more than its share."""
    monkeypatch.setattr(spelling, "NODE_WORDS", 4)
    rng = random.Random(5)
    counts = {"".join(rng.sample("abcdefg", 7)): k + 1 for k in range(60)} | {"abcdefgh": 900, "bcdefgh": 9, "ab": 3, "b" * 400: 1, "b" * 401: 20}
    assert grouped(spark, counts) == expected_rows(counts)


def test_chains_ties_and_empty_tables(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1_000, "aaabbbb": 10_000, "aabbbbb": 100_000,
              "zzzzzzz": 2, "zzzzzza": 20, "zzzzzzb": 20, "yyyyyyy": 3, "yyyyyyyy": 29}
    rows = grouped(spark, counts)
    assert rows == expected_rows(counts)
    assert dict((r[0], r[5]) for r in rows)["aaaaaaa"] == "aabbbbb"
    assert grouped(spark, {}) == []


def test_words_of_texts(spark, texts):
    long = "Elephant " * 5_000 + "x" * 30_000
    docs = texts([None, "", "Straße été ÉTÉÉÉÉÉ abcdefg-abcdefgh ×××÷÷÷÷÷ 字字字字字字字字", long, "elephant elephant", long],
                 ids=[0, 1, 2, 2, None, 4])
    for min_count in (1, 2):
        expected = {}
        for r in docs.collect():
            for run in regex.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                if len(run) >= 7:
                    expected[run] = expected.get(run, 0) + 1
        got = spelling.word_counts(docs, change=spelling.without_one, min_count=min_count).collect()
        assert {r.word: r.n for r in got} == {w: n for w, n in expected.items() if n >= min_count}
    assert spelling.word_counts(texts([])).collect() == []


def test_one_code_point_goes_at_the_right_place(spark):
    rows = [(f"{k}", "abcdéfghij") for k in range(200)]
    df = spark.createDataFrame(rows, "id string, run string")
    got = df.select("id", spelling.without_one(df.id, df.run).alias("w")).collect()
    for r in got:
        h = zlib.crc32(f"{r.id}:abcdéfghij".encode())
        at = h % 10
        assert r.w == ("abcdéfghij"[:at] + "abcdéfghij"[at + 1:] if h % 31 == 0 else "abcdéfghij")


def test_hot_word_and_groups_are_even(spark):
    """A third of all rows is one word: counted before the shuffle, it is one row afterwards."""
    docs = spark.createDataFrame([(k, "understand " * 50 if k % 3 == 0 else f"wordnumber{chr(97 + k % 26)}") for k in range(900)],
                                 "doc_id long, text string")
    counts = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert counts["understand"] == 300 * 50
    groups = spelling.Groups({ord(c): n for c, n in zip("abcdefghijklmnopqrst", range(20, 0, -1))})
    assert len(set(groups.of[[ord(c) for c in "abcdefghijklmnop"]])) == spelling.GROUPS
    assert np.array_equal(groups.vectors(["", "aab"]).sum(axis=1), [0, 3])
