import hashlib
import random

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece

from adherence.llm import pieces

MODEL = vocabularies.path("piece_bpe_32k.model")
ALPHABET = " \t\n▁aabbeeostnrthi.,;-0012é字的ла😀̀\x00<>xyz"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def merge_by_definition(text, rank):
    parts = list(text)
    while True:
        options = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not options:
            return parts
        k = min(options)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("distinct", [True, False])
def test_prefix_table_against_merging(distinct):
    """Vocabularies whose longer pieces may score better than their parts, with equal
    scores, pieces that merging never gives and characters that are no piece."""
    rng = random.Random(7)
    for _ in range(250):
        words = {"".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 14))} | set("abc")
        scores = {w: rng.random() if distinct else rng.randint(0, 3) for w in sorted(words)}
        names = list(scores)
        table = pieces.PrefixTable({3 * k: (w, scores[w]) for k, w in enumerate(names)})
        for _ in range(30):
            text = "".join(rng.choices("abcd" if rng.random() < 0.2 else "abc", k=rng.randint(0, 16)))
            expected = merge_by_definition(text, table.rank)
            assert pieces.merged(text, table.rank)[0] == expected
            got = [names[k // 3] if k >= 0 else chr(-1 - k) for k in table.ids(text)]
            assert got == expected, (scores, text)


def test_library_ids_and_text(library):
    rng, coder = random.Random(3), pieces.Coder(MODEL)
    cases = ["", " ", "a" * 5_000, " " * 3_000, "▁▁ ▁", "<s></s><unk><0x41>", "\x00", "ab" * 2_000 + " end"]
    cases += ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3_000)]
    for text in cases:
        packed = coder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert coder.decode(packed) == library.decode(np.frombuffer(packed, "<u4").tolist())


def test_bounded_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_STRETCHES", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 5)
    coder = pieces.Coder(MODEL)
    text = "the words of a text that repeats the words of a text " * 5
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert len(coder) <= 3 and len(coder.older) <= 3 and coder.table.n_kept < 5 + 100


def test_rows(texts, library):
    docs = texts([None, "", "Hello  there\nyou", "Hello  there\nyou", "été 字字 \x00 😀", "z" * 30_000, "a b " * 20_000],
                 ids=[0, 1, 2, 2, None, 4, 5])
    expected = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = pieces.piece_digests(pieces.encode_pieces(docs, MODEL)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert pieces.encode_pieces(texts([]), MODEL).collect() == []
