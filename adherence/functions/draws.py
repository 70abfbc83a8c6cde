"""Repeatable draws for missing arguments.

A draw depends on the seed and the row's own identity only, so a re-run, another
partitioning or a lost executor gives the same value.
"""

from pyspark.sql import Column, DataFrame, functions as F

from adherence.functions.text import constants, let


def draw(row_id, field, n) -> Column:
    """An integer in 0..n-1 from the digest of (row, field)."""
    digest = F.md5(F.concat(row_id, F.lit("|"), field if isinstance(field, Column) else F.lit(field)))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, n if isinstance(n, Column) else F.lit(n))


def draw_between(row_id, field, low, high) -> Column:
    span = high - low + 1
    return F.lit(low) + draw(row_id, field, span)


def draw_from(row_id, field, options) -> Column:
    return F.get(constants(options), draw(row_id, field, len(options)).cast("int"))


def sample_indexes(row_id, field, size, n) -> Column:
    """`n` different numbers of 0..size-1, all of them if there are no more (Floyd's method).
    One draw a number, however large `size` is: the j-th is of 0..size-n+j, and gives way
    to size-n+j where it is taken already."""
    n = min(n, size)
    if n == 0:
        return F.array().cast("array<bigint>")
    first = size - n

    def add(chosen, top):
        number = draw(row_id, F.concat(F.lit(f"{field}|"), (top - first).cast("string")), top + 1)
        return let(number, lambda t: F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), top).otherwise(t))))

    tops = F.sequence(F.lit(first).cast("bigint"), F.lit(size - 1).cast("bigint"))
    return F.aggregate(tops, F.array().cast("array<bigint>"), add)


def sample_words(row_id, field, pool, n) -> Column:
    """`n` different words of `pool` (distinct words), in the order of their draws."""
    words = constants(pool)
    return F.transform(sample_indexes(row_id, field, len(pool), n), lambda i: F.get(words, i.cast("int")))


def pool_of(words: DataFrame, column="word") -> tuple:
    """A pool out of a table of words, sorted, each once; nulls and empty words are left out.
    It becomes a constant of the plan, so it is meant for thousands of words."""
    found = words.select(F.col(column).alias("w")).where("w <> ''").distinct()
    return tuple(sorted(r.w for r in found.collect()))
