"""Prompt batches in dataset order, their padding, and length budgets."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from adherence.functions.text import NOT_WS, WS, strip
from adherence.operators.chat import MAX_SEQ_LENGTH, token_count
from adherence.session import written

def first_rows(rows: DataFrame, n, order) -> DataFrame:
    """The first `n` rows in dataset order; 0 or None means all."""
    return rows.orderBy(order).limit(n) if n else rows


def with_position(rows: DataFrame, order, out="position", rows_per_block=None) -> DataFrame:
    """Number the rows 0, 1, ... by an `order` column of any sortable type, nulls first;
    equal keys are numbered by a digest of their row, equal rows in some order.

    The rows are range-partitioned once by key and digest, so that a key that many rows
    share is split too, sorted, and written to the shared folder with their place in their
    partition; a partition's count (one number each) moves it up by those before.
    `rows_per_block` asks for partitions of about that size, else Spark's own number stands;
    the numbers of different rows do not depend on it.
    """
    hashable = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    tied = rows.withColumn("_tie", F.xxhash64(*hashable)).withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(order).asc_nulls_first(), F.col("_tie"), F.col("_row")]
    dealt = tied.repartitionByRange(*keys)
    if rows_per_block:
        dealt = tied.repartitionByRange(max(1, math.ceil(rows.count() / rows_per_block)), *keys)
    # the id holds the partition in its upper bits, the place in the partition below
    placed = written(
        dealt.sortWithinPartitions(*keys).drop("_tie", "_row").withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_block", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))),
        "positions",
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_block").count().select(
        "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    return (
        placed.join(F.broadcast(starts), "_block")
        .withColumn(out, (F.col("_start") + F.col("_n")).cast("bigint"))
        .select(*rows.columns, out)
    )


def prompt_batches(rows: DataFrame, batch_size, order, rows_per_block=None) -> DataFrame:
    """Consecutive prompts in batches of `batch_size`."""
    placed = with_position(rows, order, rows_per_block=rows_per_block)
    return placed.withColumn("batch_id", F.floor(F.col("position") / batch_size))


def batch_padding(batches: DataFrame, text="text") -> DataFrame:
    """True length of each prompt and the padded length of its batch. A batch has
    at most `batch_size` rows, and so has a window."""
    batch = Window.partitionBy("batch_id")
    tokens = batches.withColumn("tokens", token_count(F.col(text)))
    return tokens.withColumn("padded_tokens", F.max("tokens").over(batch)).withColumn(
        "padding_waste",
        F.coalesce(
            1 - F.try_divide(
                F.sum("tokens").over(batch), F.count(F.lit(1)).over(batch) * F.col("padded_tokens")
            ),
            F.lit(0.0),
        ),
    )


def truncate_tokens(text, max_tokens=MAX_SEQ_LENGTH) -> Column:
    """The text up to the end of its `max_tokens`-th white-space token; what stays is
    unchanged, white space included."""
    tokens = F.split(strip(text), f"{WS}+", -1)
    gaps = F.split(strip(text), f"{NOT_WS}+", -1)  # the first stands before the first token and is empty
    kept = F.zip_with(F.slice(gaps, 1, max_tokens), F.slice(tokens, 1, max_tokens), lambda g, w: F.concat(g, w))
    lead = F.regexp_extract(text, rf"\A{WS}*", 0)
    return F.when(F.size(tokens) <= max_tokens, text).otherwise(F.concat(lead, F.array_join(kept, "")))


def throughput(tokens, seconds) -> Column:
    """Tokens, seconds to two places, tokens per second to one."""
    return F.struct(
        tokens.alias("tokens"),
        F.round(seconds, 2).alias("time"),
        F.round(F.try_divide(tokens, seconds), 1).alias("tok_per_s"),
    )
