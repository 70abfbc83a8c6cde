import math
import random

import numpy as np
import pytest

from adherence.llm import negatives


def expected(rows, n_positives=5, n_negatives=10):
    valid = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in valid:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other == label) for j, other, w in valid)
        for p, j, _ in [x for x in scored if x[2] and x[1] != i][:n_positives]:
            inside = [(-q, k) for q, k, same in scored if not same and 30 * -p <= 100 * -q <= 90 * -p]
            out += [(i, j, r + 1, k, -p, q) for r, (q, k) in enumerate(inside[:n_negatives])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, "clash") for i, v, label in rows],
                                 "vec_id long, embedding array<float>, label int, number string, score int, id string").repartition(3)


def mined(spark, rows, **options):
    got = negatives.hard_negatives(table(spark, rows), negatives.every_hundredth, **options)
    return sorted(map(tuple, got.collect()))


def test_strassen_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    for cut in (1, 3, 32):
        monkeypatch.setattr(negatives, "CUT", cut)
        for _ in range(20):
            m, k, n = rng.integers(1, 80, 3)
            for top in (300, 2 ** 28):
                a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
                assert np.array_equal(negatives.strassen(a, b), a @ b)
    # Sums inside wrap around; the entries fit.
    a = np.full((66, 66), 2 ** 28)
    a[::2] *= -1
    assert np.array_equal(negatives.strassen(a, a.T.copy()), a @ a.T)


def test_heaps_break_ties_by_id():
    for scale in (1, 2 ** 58):
        heaps = negatives.Heaps(2, 3)
        scores = np.array([[1, 2, 2, 2, 2, 1], [0, -1, -1, -2, -2, 5]]) * scale
        allowed = np.ones((2, 6), bool)
        allowed[1, 5] = False
        for ids in (np.arange(10, 16), np.arange(0, 6)):
            heaps.offer(np.arange(2), scores, allowed, ids)
        assert heaps.ids.tolist() == [[1, 2, 3], [0, 10, 1]]


@pytest.mark.parametrize("tiles,group", [((512, 2048), 16 << 20), ((2, 3), 200)])
def test_against_plain_search(spark, monkeypatch, tiles, group):
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", tiles[0])
    monkeypatch.setattr(negatives, "CANDIDATE_ROWS", tiles[1])
    monkeypatch.setattr(negatives, "GROUP_BYTES", group)
    rng = random.Random(group)
    rows = [(i * 20, [rng.choice([-0.5, 0.25, 0.1, 0.9]) for _ in range(4)], rng.randint(0, 2)) for i in range(90)]
    assert mined(spark, rows) == expected(rows)
    assert mined(spark, rows, positives=2, negatives=3) == expected(rows, 2, 3)


def test_nulls_odd_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, [0.5, 0.5], 2), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 2), (6, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (7, [], 1), (8, [0.5], 2), (9, [0.6, 0.1, 9.0], 2),
            (10, [0.5, 0.5], 2), (200, [-1.0, -1.0], 3), (300, [0.0, 0.0], 4), (301, [0.0, 1.0], 4)]
    assert mined(spark, rows) == expected(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_repeated_rows_count_each(spark):
    rows = [(0, [1.0], 1), (1, [0.9], 1), (1, [0.9], 1), (2, [0.5], 2), (2, [0.5], 2)]
    got = mined(spark, rows)
    assert [(r[1], r[2], r[3]) for r in got] == [(1, 1, 2), (1, 1, 2), (1, 2, 2), (1, 2, 2)]
    twice = mined(spark, rows + [(0, [1.0], 1)])
    assert len(twice) == 8


def test_large_components(spark):
    rows = [(0, [1e6, 3.0], 1), (1, [1e6, 2.0], 1), (2, [5e5, 1.0], 2)]
    assert mined(spark, rows) == expected(rows)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1)])


def test_one_label_with_a_third_of_the_rows_and_equal_vectors(spark):
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [0.5, i / 900], i % 3) for i in range(300)]
    assert mined(spark, rows) == expected(rows)
