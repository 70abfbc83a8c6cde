"""Responses sent again on a stream replace the earlier ones."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from adherence.operators import scoring
from adherence.operators.checks import Registry, default_registry
from adherence.schemas import SAMPLES
from adherence.streaming import corrections

OPTIONS = scoring.ScoringOptions(registry=Registry([default_registry()["punctuation:no_comma"]]))


def at(minute):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    """Sends rows (run, place, response, minute) as one micro-batch and gives the accuracies."""
    paths = {name: str(tmp_path / name) for name in ("sent", "out", "checkpoint")}
    schema = f"{SAMPLES}, sent_at timestamp"

    def send(*rows, late="1 hour"):
        values = [(run, place, place, "p", response, ["punctuation:no_comma"], ["{}"], None if minute is None else at(minute))
                  for run, place, response, minute in rows]
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(paths["sent"])
        samples = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(paths["sent"])
        found = corrections.differences(samples, late=late, options=OPTIONS)
        corrections.write_differences(found, paths["out"], paths["checkpoint"]).trigger(availableNow=True).start().awaitTermination()
        got = corrections.accuracy(spark, paths["out"]).orderBy("run_file").collect()
        return [(r.run_file, r.num_samples, r.inst_strict_pass, r.prompt_strict_pass, r.inst_level_strict_acc) for r in got]

    return send


def test_the_newest_response_counts(stream):
    assert stream(("a", 1, "good", 1), ("a", 2, "bad,", 1), ("b", 1, "bad,", 1)) == [("a", 2, 1, 1, 0.5), ("b", 1, 0, 0, 0.0)]
    # sent again in a later run of the query, from the same checkpoint: corrected, unchanged, older
    assert stream(("a", 2, "good now", 5), ("b", 1, "bad, still", 5), ("a", 1, "bad, but older", 0)) == [("a", 2, 2, 2, 1.0), ("b", 1, 0, 0, 0.0)]
    assert stream(("a", 1, "bad, newer", 9), ("a", 1, "good", 8)) == [("a", 2, 1, 1, 0.5), ("b", 1, 0, 0, 0.0)]


def test_one_batch_with_repeats_nulls_and_a_null_response(stream):
    rows = [("a", 1, "bad,", 1), ("a", 1, "good", 3), ("a", 1, "bad,", 2), ("a", 1, "good", 3), ("a", 2, None, 1),
            (None, 1, "good", 1), ("a", None, "good", 1), ("a", 3, "good", None)]
    assert stream(*rows) == [("a", 2, 1, 1, 0.5)]


def test_what_is_later_than_the_watermark_is_left_out(stream):
    stream(("a", 1, "good", 0), late="10 minutes")
    stream(("a", 2, "good", 100), late="10 minutes")
    assert stream(("a", 3, "late, and bad", 20), ("a", 1, "late, and bad", 30), ("a", 4, "good", 101), late="10 minutes") == [("a", 3, 3, 3, 1.0)]


def test_equal_to_the_batch_roll_up(spark, stream):
    rows = [(f"run{k % 3}", k, "x," * (k % 4 == 0) + "y", k % 7) for k in range(80)]
    again = [(run, place, "z" if place % 5 else "z,", 10 + place % 3) for run, place, _, _ in rows if place % 2]
    stream(*rows)
    got = stream(*again)
    newest = {(r[0], r[1]): r for r in rows + again}
    samples = spark.createDataFrame([(run, place, place, "p", response, ["punctuation:no_comma"], ["{}"]) for run, place, response, _ in newest.values()], SAMPLES)
    batch = scoring.accuracy(scoring.score_samples(samples, OPTIONS)).orderBy("run_file")
    assert got == [tuple(r) for r in batch.select(F.col("run_file"), "num_samples", "inst_strict_pass", "prompt_strict_pass", "inst_level_strict_acc").collect()]


class State:
    """A group's state as Spark hands it out, with a time out by the watermark."""

    exists, timeout = False, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.exists, self.timeout = False, None

    def setTimeoutTimestamp(self, at):
        assert at >= self.watermark
        self.timeout = at


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_a_call_handles_the_samples_of_a_block_each_by_its_own_times(chunk):
    """Against a dictionary with one state a sample, which goes when the watermark has passed it."""
    draw, state, one, calls = random.Random(chunk), State(), {}, 0
    for batch in range(60):
        watermark = max(0, batch - 6) * 1000
        rows = [(draw.randrange(30), draw.randrange(watermark, watermark + 9000) * 1000, *(draw.randrange(3) for _ in corrections.COUNTS))
                for _ in range(draw.choice([0, 0, 5, 60]))]
        expected = {}
        for place in {r[0] for r in rows}:
            before, _ = one.get(place, (None, 0))
            newest = max([r[1:] for r in rows if r[0] == place] + [before] * (before is not None))
            if newest != before:
                expected[place] = [a - b for a, b in zip(newest[1:], before[1:] if before else [0] * 7)]
            one[place] = newest, max(newest[0] // 1000, watermark) + 1
        one = {p: (n, due) for p, (n, due) in one.items() if due >= watermark or p in {r[0] for r in rows}}
        state.watermark, state.hasTimedOut = watermark, not rows
        if not rows and not (state.timeout is not None and state.timeout < watermark):
            continue
        calls += 1
        parts = [pd.DataFrame(rows[k:k + chunk], columns=["sample_pos", "_at", *corrections.COUNTS]) for k in range(0, len(rows), chunk)]
        got = [r for found in corrections._replaced(("run", 0), parts, state) for r in found.itertuples(index=False, name=None)]
        assert {r[1]: list(r[2:]) for r in got} == expected and len(got) == len(expected) and {r[0] for r in got} <= {"run"}
        assert state.exists == bool(one) and (not one or state.timeout == max(watermark, min(due for _, due in one.values())))
    assert calls > 30


def test_one_state_for_neighbouring_places(spark):
    plan = corrections.differences(spark.createDataFrame([], f"{SAMPLES}, sent_at timestamp"), options=OPTIONS)
    grouped = plan._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandasWithState")[1].split("\n")[0]
    assert "_block#" in grouped and "[StructField(samples,BinaryType,true)]" in grouped
