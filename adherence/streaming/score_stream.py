"""Scoring as responses arrive. The plan is the batch plan: it is row-local."""

from pyspark.sql import DataFrame, SparkSession

from adherence.operators import scoring
from adherence.schemas import SAMPLES


def read_sample_stream(spark: SparkSession, path, fmt="parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(SAMPLES).load(path)


def score_stream(samples: DataFrame, out, checkpoint, options=None):
    """Append the outcomes of each micro-batch to a Parquet table."""
    scored = scoring.score_samples(samples, options)
    return (
        scored.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )


def running_accuracy(outcomes: DataFrame) -> DataFrame:
    """Accuracies per run so far, for an update or complete sink; the state is a
    handful of counters per run."""
    return scoring.accuracy(outcomes)
