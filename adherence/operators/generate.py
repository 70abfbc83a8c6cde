"""Batched response generation: Spark hands out the prompts, the caller's model answers."""

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from adherence.functions.text import strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def generate_responses(
    rows: DataFrame, respond: Callable[[list], list], batch_size=64, prompt="model_input"
) -> DataFrame:
    """Add `response` to every row by calling `respond` on lists of at most
    `batch_size` prompts, within the partitions as they are."""
    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType())])

    def answer(frames):
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                yield part.assign(response=respond(part[prompt].tolist()))

    return rows.mapInPandas(answer, schema).withColumn("response", strip(F.col("response")))
