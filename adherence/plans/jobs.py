"""The five jobs end to end, out of the operators."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from adherence.operators import batching, chat, compare, runs, scoring
from adherence.operators.generate import generate_responses
from adherence.session import checkpoint_dir
from adherence.sources import documents, sinks


@dataclass
class Scored:
    outcomes: DataFrame
    accuracy: DataFrame
    by_level: DataFrame


def score_job(spark: SparkSession, samples: DataFrame, out=None, options=None, keep=()) -> Scored:
    """Score once, write the narrow outcomes, and take every roll-up from them.

    The written table is also what a comparison starts from, so no text is scored
    twice, and it outlives any executor. Without `out` it goes to the shared
    folder of the session."""
    folder = out or f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/outcomes"
    sinks.write_table(scoring.score_samples(samples, options, keep), path)
    outcomes = spark.read.parquet(path)
    stats = compare.type_stats(outcomes)
    return Scored(outcomes, scoring.accuracy(outcomes), compare.level_stats(stats))


def compare_responses_job(spark: SparkSession, path1, path2, out=None, options=None, use_strict=True):
    """The comparison straight from two responses documents, under their models' names.
    Each is scored once, and the outcomes are written."""
    scored, names = [], []
    for n, path in enumerate((path1, path2), 1):
        found, samples = documents.read_runs(spark, path)
        name = found.agg(F.min("display_name")).first()[0]
        names.append(name if name is not None else f"model{n}")
        scored.append(score_job(spark, samples, out and f"{out.rstrip('/')}/model{n}", options).outcomes)
    registry = (options or scoring.ScoringOptions()).registry
    return compare_job(*scored, *names, use_strict, [c.inst_id for c in registry])


def compare_job(outcomes1: DataFrame, outcomes2: DataFrame, name1, name2, use_strict=True, known_ids=None):
    """Comparison rows, tally of wins and the nested document of two scored models
    (outcomes as score_job writes them)."""
    known_ids = known_ids or [c.inst_id for c in scoring.default_registry()]
    sides = outcomes1.select(F.lit(1).alias("side"), "scores").unionByName(
        outcomes2.select(F.lit(2).alias("side"), "scores")
    )
    levels = compare.level_stats(compare.type_stats(sides, ("side",)), ("side",))
    rows = compare.compare_stats(levels, use_strict, with_stats=True)
    return (
        compare.sorted_comparison(rows.drop("stats1", "stats2")),
        compare.wins(rows),
        compare.comparison_document(rows, name1, name2, known_ids),
    )


def generate_job(prompts: DataFrame, respond, batch_size=64, use_chat=True, limit=None,
                 order="key", max_tokens=chat.MAX_SEQ_LENGTH) -> DataFrame:
    """Benchmark rows to response rows: limit, render, cut to length, answer in batches."""
    rows = batching.first_rows(prompts, limit, order)
    text = chat.prompt_text(F.col("prompt"), use_chat)
    rows = rows.withColumn("model_input", batching.truncate_tokens(text, max_tokens))
    return generate_responses(rows, respond, batch_size).drop("model_input")


def track_job(results: DataFrame) -> dict:
    """All tracking tables of a set of result documents."""
    return {
        "configs": runs.run_configs(results),
        "metrics": runs.run_metrics(results),
        "summaries": runs.run_summaries(results),
        "base_vs_finetuned": runs.base_vs_finetuned(results),
        "charts": runs.chart_rows(results),
    }


def training_text_job(rows: DataFrame, n=None, order=None) -> DataFrame:
    return chat.training_text(batching.first_rows(rows, n, order))
