import hashlib
import random
import struct

import public_tokenizers as vocabularies
import pytest
import regex

from adherence.llm import bpe
from adherence.llm.queries import token_rows

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")


def encode_matches(encoder, text):
    """Every match of the pattern on its own, from the whole text."""
    return [i for m in regex.finditer(vocabularies.PATTERN, text) for i in encoder.one_match.encode_ordinary(m.group())]


def test_cut_texts_give_the_ids_of_whole_ones(monkeypatch):
    encoder = bpe.encoder(RANKS, vocabularies.PATTERN)
    monkeypatch.setattr(bpe, "WHOLE", 4)
    rng = random.Random(1)
    letters = list("aeé1²٣ \n\t'!s _\x1c　字") + ["'s", "'ll", "  ", " \n"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 50)))
        ids = encoder.encode(text)
        assert ids == encode_matches(encoder, text) == encoder.by_pattern.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["a", " ", "!", "7", "ab ", "é\n", "a1"])
def test_long_texts_come_back(unit):
    encoder = bpe.encoder(RANKS, vocabularies.PATTERN)
    text = unit * 120_000 + "x"
    assert encoder.decode(encoder.encode(text)) == text.encode()


def test_rows(texts):
    values = [None, "", "Hello there's 12 cats", "Hello there's 12 cats", "<|endoftext|>", "퟿𝄞", "y" * 70_000]
    docs = texts(values, ids=[0, 1, 2, 2, 3, None, 5])
    encoder = bpe.encoder(RANKS, vocabularies.PATTERN)
    expected = []
    for r in docs.collect():
        text = r.text or ""
        ids = encode_matches(encoder, text)
        expected.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r) for r in token_rows(docs).collect()), key=repr) == sorted(expected, key=repr)


def test_empty_table(texts):
    assert token_rows(texts([])).collect() == []
