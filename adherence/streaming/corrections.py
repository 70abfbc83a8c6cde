"""Accuracies of a stream in which responses are sent again.

A response that is sent again replaces the earlier one of its sample. The state holds,
per sample, the newest response's counts; what changes is emitted as differences, so that
sums of the emitted rows are the counts of the newest responses at any time. They go to an
append-only table, which is exactly what a file sink writes once per micro-batch.

Responses older than the watermark are left out, and a sample's state goes when the
watermark has passed its newest response: the state is bounded by the samples of that span.

The samples of a run at neighbouring places share a block of state, a table of numbers: Python
is called once a block and micro-batch, and handles its rows as columns.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from adherence.operators import scoring

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["run_file", "sample_pos"]
COUNTS = ["num_samples", "num_instructions", "inst_strict_pass", "inst_loose_pass",
          "prompt_strict_pass", "prompt_loose_pass", "dropped_instructions"]
_KINDS = ", ".join(f"{c} long" for c in COUNTS)
DIFFERENCES = f"run_file string, sample_pos long, {_KINDS}"
#: Places of a run that share a block of state, as a power of two; a sample takes 80 bytes.
PLACES = 12
# A block's samples by place: place, newest time, its counts, and the watermark (ms) its state lasts to.
_STATE = "samples binary"
_AT, _DUE = 1, 2 + len(COUNTS)


def _newest(rows: np.ndarray) -> np.ndarray:
    """Of the rows of each place the greatest by time, then by counts; by place. Of equal times
    the larger counts are the newest, whatever their order of arrival."""
    order = np.lexsort(rows[:, _DUE - 1::-1].T)
    rows = rows[order]
    return rows[np.append(rows[1:, 0] != rows[:-1, 0], True)] if len(rows) else rows


def _replaced(key, batches, state):
    """The newest responses of a block's samples against those in the state."""
    width, watermark = _DUE + 1, state.getCurrentWatermarkMs()
    before = np.frombuffer(state.get[0], np.int64).reshape(-1, width) if state.exists else np.zeros((0, width), np.int64)
    sent = np.zeros((0, width), np.int64)
    if not state.hasTimedOut:
        for rows in batches:
            rows = rows[["sample_pos", "_at", *COUNTS]].to_numpy(np.int64)
            # The state keeps microseconds, watermarks are milliseconds.
            due = np.maximum(rows[:, _AT] // 1000, watermark) + 1
            sent = _newest(np.concatenate([sent, np.column_stack([rows, due])]))
    # What is sent takes the place of its sample's state if it is newer; a touched state lasts on.
    touched = np.isin(before[:, 0], sent[:, 0])
    held = before[touched]
    held = np.column_stack([held[:, :_DUE], np.maximum(held[:, _AT] // 1000, watermark) + 1])
    after = _newest(np.concatenate([held, sent]))
    old = np.zeros_like(after)
    old[np.isin(after[:, 0], held[:, 0])] = held
    changed = (after[:, _AT:_DUE] != old[:, _AT:_DUE]).any(axis=1) | ~np.isin(after[:, 0], held[:, 0])
    if changed.any():
        counts = (after - old)[changed, _AT + 1:_DUE]
        yield pd.DataFrame({"run_file": key[0], "sample_pos": after[changed, 0], **dict(zip(COUNTS, counts.T))})
    rest = before[~touched]
    kept = np.concatenate([rest[rest[:, _DUE] >= watermark], after])
    if not len(kept):
        state.remove()
        return
    state.update((kept[kept[:, 0].argsort()].tobytes(),))
    state.setTimeoutTimestamp(max(int(kept[:, _DUE].min()), watermark))


def differences(samples: DataFrame, sent_at="sent_at", late="1 hour", options=None) -> DataFrame:
    """Samples (a stream, or a table as one micro-batch) to rows of differences: run_file,
    sample_pos and the counts of scoring.accuracy. `sent_at`: the time of the response;
    rows without one, or without a run or a place, are left out."""
    rows = samples.where(F.col(sent_at).isNotNull() & F.col("run_file").isNotNull() & F.col("sample_pos").isNotNull())
    scored = scoring.score_samples(rows.withWatermark(sent_at, late), options, keep=(sent_at,))
    size = lambda name: F.size(F.filter("scores", lambda s: s[name]))
    counted = scored.select(
        *KEYS, sent_at, F.unix_micros(sent_at).alias("_at"), F.lit(1).alias("num_samples"), F.size("scores").alias("num_instructions"),
        size("strict").alias("inst_strict_pass"), size("loose").alias("inst_loose_pass"),
        F.col("prompt_strict_pass").cast("int").alias("prompt_strict_pass"), F.col("prompt_loose_pass").cast("int").alias("prompt_loose_pass"),
        "dropped_instructions")
    blocks = counted.withColumn("_block", F.shiftright("sample_pos", PLACES))
    return blocks.groupBy("run_file", "_block").applyInPandasWithState(
        _replaced, DIFFERENCES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_differences(rows: DataFrame, out, checkpoint):
    """A writer that appends the differences of each micro-batch to a Parquet table."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def accuracy(spark: SparkSession, out, by=("run_file",)) -> DataFrame:
    """Accuracies of the newest responses so far; runs of which nothing is left have no row."""
    table = spark.read.schema(DIFFERENCES).parquet(out)
    sums = table.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS]).where("num_samples > 0")
    return scoring.with_rates(sums)
