"""Words drawn by index, whatever the size of the pool."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from adherence.functions import draws


def floyd(row, field, size, n):
    chosen = []
    n = min(n, size)
    for j in range(n):
        top = size - n + j
        t = int(hashlib.md5(f"{row}|{field}|{j}".encode()).hexdigest()[:8], 16) % (top + 1)
        chosen.append(top if t in chosen else t)
    return chosen


def test_against_a_plain_version(spark):
    rows = spark.range(300).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("row"))
    for size, n in ((1, 1), (2, 2), (5, 3), (24, 2), (4_000, 7), (3, 9), (7, 0), (0, 2)):
        got = rows.select("row", draws.sample_indexes(F.col("row"), "f", size, n).alias("i")).collect()
        for r in got:
            assert r.i == floyd(r.row, "f", size, n) and len(set(r.i)) == min(n, size)


def test_draws_are_even(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("row"))
    seen = Counter(i for r in rows.select(draws.sample_indexes(F.col("row"), "f", 10, 3).alias("i")).collect() for i in r.i)
    assert set(seen) == set(range(10)) and all(abs(n - 6_000) < 400 for n in seen.values())


def test_a_pool_from_a_table(spark, make_samples):
    from adherence.operators.checks import Registry, default_registry
    from adherence.operators.scoring import ScoringOptions, describe_instructions

    words = spark.range(5_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("word"))
    pool = draws.pool_of(words.union(words).union(spark.createDataFrame([("",), (None,)], "word string")))
    assert len(pool) == 5_000 and list(pool) == sorted(pool)
    options = ScoringOptions(registry=Registry([default_registry()["keywords:existence"]]), keyword_pool=pool)
    text = describe_instructions(make_samples(("x", [("keywords:existence", "{}")])), options).first().description
    drawn = [pool[i] for i in floyd("42|run|0|0", "keywords", 5_000, 2)]
    assert all(w in text for w in drawn)
