import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from adherence.llm import sharding


def best_capacity(sizes, shards):
    """Smallest capacity of a contiguous partition, by dynamic programming."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    best = sums.copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sums))])
    return int(best[-1])


def check(docs, shards, pieces=sharding.PIECES):
    source = docs.collect()
    rows = sharding.shard_documents(docs, shards, pieces=pieces).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (repr(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in source)
    by_shard, bytes_of, shard_of = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
        shard_of[r.text_crc32, r.size].add(r.shard)
    assert all(0 <= s < shards for s in by_shard) and all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    groups = defaultdict(lambda: [float("inf"), 0])
    for r in source:
        g = groups[r.text or ""]
        g[0] = min(g[0], r.doc_id if r.doc_id is not None else -1)
        g[1] += len((r.text or "").encode()) + 1
    sizes = [size for _, size in sorted(groups.values(), key=lambda g: (-g[1], g[0]))]
    assert max(bytes_of.values()) == best_capacity(sizes, shards)
    return bytes_of


@pytest.mark.parametrize("pieces", [4, sharding.PIECES])
def test_smallest_capacity(texts, pieces):
    rng = random.Random(9)
    values = ["w" * rng.randrange(1, 300) + str(k) for k in range(120)]
    spread = check(texts(values, parts=5), 7, pieces)
    assert min(spread.values()) > 0.8 * max(spread.values())


def test_a_hot_group_keeps_together_and_the_rest_is_even(texts):
    values = ["hot " * 30] * 60 + ["x" * (50 + k % 7) + str(k) for k in range(120)]
    random.Random(1).shuffle(values)
    spread = check(texts(values, parts=6), 5)
    rest = sorted(spread.values())[:-1]
    assert rest[0] > 0.8 * rest[-1]


def test_nulls_empty_texts_repeated_rows(texts):
    check(texts([None, "", "a", "a", "ä" * 50_000, "b", "b"], ids=[3, 9, 4, 4, 7, 1, 2]), 4)
    check(texts(["one"]), 16)
    assert sharding.shard_documents(texts([])).collect() == []
