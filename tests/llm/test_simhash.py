import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from adherence.llm import simhash


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """prints: list of (id, fp). Smallest id reachable over fingerprints at two bits or fewer."""
    values = sorted({f for _, f in prints})
    parent = {f: f for f in values}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= 2:
                parent[root(b)] = root(a)
    least = {}
    for doc, f in prints:
        r = root(f)
        least[r] = min([x for x in (least.get(r), doc) if x is not None], default=None)
    return sorted(((doc, f"{f:016x}", least[root(f)]) for doc, f in prints), key=repr)


TEXTS = [None, "", " \t", "one", "One", "ONE two", "a b c", "A  b\nc", "Ä b c", "ä b c", "w " * 5000, "same " * 3,
         "the quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog", "x" * 100_000]


def test_fingerprints_and_components(texts):
    docs = texts(TEXTS + TEXTS[:4], ids=[*range(len(TEXTS)), 2, 2, None, None])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert got == brute_components([(d, brute_print(t)) for d, t in rows])


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(n % 977) for n in range(4000))
    monkeypatch.setattr(simhash, "BLOCK", 97)
    assert simhash.fingerprint(text, 3) % (1 << 64) == brute_print(text)


def test_golay_indices_meet_at_two_bits():
    rng = np.random.default_rng(5)
    golay = simhash._golay()
    words = rng.integers(0, 1 << 23, 20_000).astype(np.int32)
    flips = (1 << rng.integers(0, 23, 20_000)) | (1 << rng.integers(0, 23, 20_000))
    (a, used_a), (b, used_b) = golay.indices(words), golay.indices((words ^ flips).astype(np.int32))
    meet = ((a[:, :, None] == b[:, None, :]) & used_a[:, :, None] & used_b[:, None, :]).any(axis=(1, 2))
    assert meet.all() and Counter(used_a.sum(axis=1).tolist()).keys() == {1, 6}


@pytest.mark.parametrize("paired", [1000, 3])
def test_components_of_close_fingerprints(spark, paired):
    """Chains, hubs and crowded keys; paired=3 sends most keys the way of neighbouring words."""
    rng = random.Random(11)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            prints.append(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                base ^= 1 << rng.randrange(64)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    fps = frame.select("fp").distinct()
    links = simhash.fingerprint_links(fps, paired).collect()
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2 for r in links)
    found = simhash.fingerprint_components(frame)
    rows = frame.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute_components(list(enumerate(prints)))


def test_one_of_each_group_stays(texts):
    docs = texts(["a b c d", "a b c d", "other words here now", "a b c d", None, ""], ids=[4, 2, 9, 2, 1, 8])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 9]


def test_empty_table_and_other_distances(texts):
    assert simhash.simhash_components(texts([])).collect() == []
    with pytest.raises(ValueError):
        simhash.simhash_components(texts([]), max_distance=3)
