import random

import public_tokenizers as vocabularies
import pytest
import regex

from adherence.llm import token_counts as tc

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")


def greedy(vocabulary, word):
    n = at = 0
    longest = max(map(len, vocabulary), default=0)
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at:at + size] in vocabulary:
                break
        else:
            return 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("full", [True, False])
def test_automaton_against_greedy_search(full):
    rng = random.Random(4)
    for _ in range(300):
        vocabulary = {bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 14))}
        if full:
            vocabulary |= {b"a", b"b", b"c"}
        counter = tc.PieceCounter(vocabulary)
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 18)))
            assert counter.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_rows(texts, monkeypatch):
    vocabulary = set(tc.read_vocabulary(RANKS))
    docs = texts([None, "", "Hello there's 12 cats", "Hello there's 12 cats", "été 字字 \x00", "z" * 30_000, "a b " * 20_000],
                 ids=[0, 1, 2, 2, None, 4, 5])
    expected = []
    for r in docs.collect():
        words = regex.findall(vocabularies.PATTERN, r.text or "")
        expected.append((r.doc_id, len(words), sum(greedy(vocabulary, w.encode()) for w in words)))
    got = tc.count_tokens(docs, RANKS, vocabularies.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert tc.count_tokens(texts([]), RANKS, vocabularies.PATTERN).collect() == []
