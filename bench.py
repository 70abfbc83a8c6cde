"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm the JVM up and once timed, to a sink that takes all
rows. Prompts per second compare with the recorded scoring throughput; they are also
taken over the samples ten times over, where planning no longer counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from adherence.operators import scoring
from adherence.operators.language import LanguageModel
from adherence.operators.sentences import SentenceModel
from adherence.session import local_session
from adherence.sources.documents import laid_out
from registered import queries as registered

HEADLINE = [
    "accuracy_by_run", "stats_by_level", "model_comparison", "instruction_scores",
    "check_length_constraints_number_words", "check_length_constraints_number_sentences",
    "check_change_case_capital_word_frequency", "check_detectable_format_json_format",
    "check_keywords_forbidden_words", "check_language_response_language", "text_language",
    "instruction_descriptions", "conflicting_pairs", "base_vs_finetuned", "training_text",
    "conversation_text", "trimmed_history_over_budget", "prompt_batches",
]


def timed(run):
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(app="adherence-bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    registered.language_model(spark, sf_dir)
    registered.sentence_model(spark, sf_dir)

    def warm(run):
        start = time.perf_counter()
        run()
        return round(time.perf_counter() - start, 3)

    # What the queries find done: the layout of their table and the fitted models, once more.
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    times = {
        "layout": warm(lambda: laid_out(documents, "layout")),
        "fit_language_model": warm(lambda: LanguageModel.fit(registered.table(spark, sf_dir, "documents"))),
        "fit_sentence_model": warm(lambda: SentenceModel.fit(registered.responses(spark, sf_dir), "response")),
    }
    for name in HEADLINE:
        run = lambda: registered.QUERIES[name](spark, sf_dir)
        timed(run)
        times[name] = round(timed(run), 3)
    prompts = registered.table(spark, sf_dir, "documents").count()
    copies = registered.samples(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    copies = laid_out(copies.withColumn("sample_pos", F.col("sample_pos") * 10 + F.col("copy")).drop("copy"), "replicated")
    scored = lambda: scoring.accuracy(scoring.score_samples(copies, registered.options(spark, sf_dir)))
    timed(scored)
    replicated = timed(scored)
    total = sum(times.values())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "prompts": prompts,
        "prompts_per_second": round(prompts / times["accuracy_by_run"], 1),
        "prompts_per_second_replicated": round(10 * prompts / replicated, 1),
    }))


if __name__ == "__main__":
    main()
