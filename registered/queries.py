"""The registered queries: every operator over the given tables."""

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from adherence.functions import draws, text as t
from adherence.operators import batching, chat, compare, conflicts, runs, scoring, translation
from adherence.operators.checks import DEFAULT_KEYWORD_POOL, LANGUAGE_CHECKS, LANGUAGE_NAMES, Registry, default_registry
from adherence.operators.generate import generate_responses
from adherence.operators.language import LanguageModel
from adherence.operators.scoring import ScoringOptions
from adherence.operators.sentences import ABBREVIATION_SCORE, SentenceModel, abbreviation_scores
from adherence.schemas import MMLU_DOCUMENT, RESPONSES_DOCUMENT, RESULT_DOCUMENT, TRAINING_METADATA
from adherence.session import checkpoint_dir
from adherence.sources import documents as docs, json_documents, sinks
from adherence.streaming import corrections
from registered import fixture

QUERIES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


# --- inputs ------------------------------------------------------------------

_KEPT = {}


def kept(spark, sf, name, build):
    """Fitted models and option objects live once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def table(spark, sf, name) -> DataFrame:
    """A given table; its one piece is laid out in small files once per session."""
    read = lambda: docs.laid_out(spark.read.parquet(f"{sf}/{name}.parquet"), name)
    return kept(spark, sf, f"table {name}", read)


def sql(spark, sf, statement, *tables) -> DataFrame:
    for name in tables or ("documents",):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(statement)


def responses(spark, sf, shift=0):
    return sql(spark, sf, fixture.responses_sql("spark", shift)).select("doc_id", "lang", "source", "response")


def samples(spark, sf, shift=0):
    return sql(spark, sf, fixture.samples_sql("spark", shift)).drop("lang")


def language_model(spark, sf):
    return kept(spark, sf, "language", lambda: LanguageModel.fit(table(spark, sf, "documents")))


def sentence_model(spark, sf):
    """Learned from the texts whose sentences are counted."""
    return kept(spark, sf, "sentences", lambda: SentenceModel.fit(responses(spark, sf), "response"))


def options(spark, sf):
    return kept(spark, sf, "options", lambda: ScoringOptions(language_model=language_model(spark, sf)))


def scored(spark, sf, shift=0):
    return scoring.score_samples(samples(spark, sf, shift), options(spark, sf))


# --- the checks ----------------------------------------------------------------


SENTENCE_CHECK = "length_constraints:number_sentences"


def check_query(inst_id):
    def run(spark, sf):
        model = language_model(spark, sf) if inst_id in LANGUAGE_CHECKS else None
        chosen = kept(spark, sf, inst_id, lambda: ScoringOptions(
            registry=Registry([replace(default_registry()[inst_id], enabled=True)]), language_model=model,
            sentence_model=sentence_model(spark, sf) if inst_id == SENTENCE_CHECK else None))
        rows = sql(spark, sf, fixture.check_samples_sql(inst_id, "spark")).drop("lang")
        outcomes = scoring.scores_long(scoring.score_samples(rows, chosen))
        return outcomes.select(
            "sample_pos", "strict", "arg_defaulted", F.col("error").isNotNull().alias("failed")
        )

    return run


CHECK_QUERIES = {
    "check_" + i.replace(":", "_").replace("-", "_"): i
    for i in fixture.INSTRUCTION_IDS[:-1] + fixture.OFF_BY_DEFAULT
}
for _name, _inst_id in CHECK_QUERIES.items():
    QUERIES[_name] = check_query(_inst_id)


# --- scoring and roll-ups --------------------------------------------------------


@query("paired_instructions")
def _(spark, sf):
    return samples(spark, sf).select(
        "sample_pos",
        scoring.dropped_instructions(F.col("instruction_id_list"), F.col("kwargs")).alias("dropped"),
        F.posexplode_outer(scoring.paired(F.col("instruction_id_list"), F.col("kwargs"))).alias("inst_pos", "p"),
    ).select("sample_pos", "dropped", "inst_pos", "p.inst_id", "p.kwargs")


@query("parsed_args")
def _(spark, sf):
    return scoring.parsed_instructions(samples(spark, sf)).select(
        "sample_pos", "inst_pos", "args.relation", "args.num_words", "args.num_sections", "args.letter",
        "args.end_phrase", F.array_join("args.keywords", ",").alias("keywords"),
    )


@query("accepted_args")
def _(spark, sf):
    rows = scoring.accepted_args(samples(spark, sf), default_registry().to_frame(spark))
    return rows.select(
        "sample_pos", "inst_pos", "inst_id", "known", F.array_join(F.array_sort("accepted"), ",").alias("accepted")
    )


@query("unknown_instructions")
def _(spark, sf):
    rows = scoring.accepted_args(samples(spark, sf), default_registry().to_frame(spark))
    return rows.groupBy("inst_id", "known").agg(F.count(F.lit(1)).alias("n"))


@query("instruction_category")
def _(spark, sf):
    rows = scoring.parsed_instructions(samples(spark, sf))
    return rows.select("sample_pos", "inst_pos", scoring.category(F.col("inst_id")).alias("category"))


@query("instruction_scores")
def _(spark, sf):
    return scoring.scores_long(scored(spark, sf)).select(
        "run_file", "sample_pos", "inst_pos", "inst_id", "category", "known", "strict", "loose",
        F.col("error").isNotNull().alias("failed"), "arg_defaulted",
    )


@query("accuracy_by_run")
def accuracy_by_run(spark, sf):
    return scoring.accuracy(scored(spark, sf))


@query("streamed_accuracy")
def _(spark, sf):
    """Every sample is streamed; a third of them is sent again with another response, and what
    comes after that with an older time counts no more. Equal to the batch roll-up."""
    path, first, second = scratch(spark, "stream"), samples(spark, sf, 5), samples(spark, sf)
    third = F.col("sample_pos") % 3 == 0
    at = lambda rows, minute: rows.withColumn("sent_at", F.lit(f"2026-01-01 00:{minute:02d}:00").cast("timestamp"))
    sent = [at(first.where(third), 10).unionByName(at(second.where(~third), 10)), at(second.where(third), 20), at(first.where(third), 15)]
    for rows in sent:
        rows.write.mode("append").parquet(f"{path}/sent")
    found = spark.read.parquet(f"{path}/sent")
    # Each task of the writing tables leaves a file; three micro-batches take them, the earliest first.
    files = -(-json_documents.files(spark, f"{path}/sent").count() // 3)
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/sent")
    rows = corrections.differences(stream, options=options(spark, sf))
    corrections.write_differences(rows, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return corrections.accuracy(spark, f"{path}/out")


@query("sample_outcomes")
def _(spark, sf):
    rows = scoring.sample_outcomes(scored(spark, sf))
    joined = lambda c: F.array_join(F.transform(c, lambda b: b.cast("string")), ",")
    return rows.select(
        "run_file", "sample_pos", joined("strict").alias("strict"), joined("loose").alias("loose"),
        "prompt_strict_pass", "prompt_loose_pass", "dropped_instructions",
    )


@query("stats_by_type")
def _(spark, sf):
    return compare.type_stats(scored(spark, sf))


@query("stats_by_level")
def _(spark, sf):
    return compare.level_stats(compare.type_stats(scored(spark, sf)))


def compared(spark, sf):
    return compare.compare_samples(samples(spark, sf), samples(spark, sf, 5), options(spark, sf))


@query("model_comparison")
def model_comparison(spark, sf):
    return compare.sorted_comparison(compared(spark, sf))


@query("comparison_wins")
def _(spark, sf):
    return compare.wins(compared(spark, sf))


@query("comparison_document")
def _(spark, sf):
    sides = compare.scored_sides(samples(spark, sf), samples(spark, sf, 5), options(spark, sf))
    levels = compare.level_stats(compare.type_stats(sides, ("side",)), ("side",))
    rows = compare.compare_stats(levels, with_stats=True)
    doc = compare.comparison_document(rows, "first", "second", [c.inst_id for c in default_registry()])
    listed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit(":"), F.concat_ws("/", e["value"]["strict_pass"], e["value"]["loose_pass"], e["value"]["total"]))), ",")
    compared = F.transform("comparison", lambda c: F.concat_ws(
        "|", c["instruction_type"], c["model1_count"], c["model2_count"], c["winner"]))
    return doc.select(
        F.col("model1.name").alias("name1"), F.col("model2.name").alias("name2"),
        F.col("model1.overall").alias("overall1"), F.col("model2.overall").alias("overall2"),
        listed("model1.by_type").alias("types1"), listed("model2.by_type").alias("types2"),
        listed("model1.by_category").alias("categories1"), listed("model2.by_category").alias("categories2"),
        F.array_join(compared, ",").alias("compared"),
    )


@query("pattern_scores")
def _(spark, sf):
    """Checks whose patterns have classes, groups and look-around, scored without Python."""
    rows = sql(spark, sf, fixture.pattern_samples_sql("spark")).drop("lang")
    ids = dict.fromkeys(c[0] for c in fixture.PATTERN_CASES)
    plain = ScoringOptions(registry=Registry([replace(default_registry()[i], enabled=True) for i in ids]))
    chosen = replace(plain, translations=translation.translated(rows, plain), _columns={})
    outcomes = scoring.scores_long(scoring.score_samples(rows, chosen))
    return outcomes.select("sample_pos", "inst_id", "strict", F.col("error").isNotNull().alias("failed"))


COMPARISON_DOCUMENT = (
    "model1 struct<name:string,overall:double,by_type:map<string,struct<total:bigint>>>, model2 struct<name:string,overall:double>, "
    "comparison array<struct<instruction_type:string,model1_count:string,model2_count:string,winner:string>>")


@query("comparison_round_trip")
def _(spark, sf):
    """The comparison document written as a file and read again."""
    sides = compare.scored_sides(samples(spark, sf), samples(spark, sf, 5), options(spark, sf))
    levels = compare.level_stats(compare.type_stats(sides, ("side",)), ("side",))
    doc = compare.comparison_document(
        compare.compare_stats(levels, with_stats=True), "first", "second", [c.inst_id for c in default_registry()])
    path = scratch(spark, "comparison")
    sinks.write_documents(doc.withColumn("document", F.lit("first vs second.json")), path)
    found = docs.read_comparisons(spark, path, COMPARISON_DOCUMENT)
    rows = F.transform(F.array_sort("comparison"), lambda c: F.concat_ws(
        "|", c["instruction_type"], c["model1_count"], c["model2_count"], c["winner"]))
    return found.select(
        "file", F.col("model1.name").alias("name1"), F.col("model2.name").alias("name2"), F.col("model1.overall").alias("overall1"),
        F.col("model2.overall").alias("overall2"), F.size("model1.by_type").cast("bigint").alias("n_types"), F.array_join(rows, ",").alias("compared"))


LOOSE_CHECK = "custom:short"


def short_registry():
    """A check of the caller's own whose loose form lets more pass."""
    return Registry().register_check(
        LOOSE_CHECK, [], lambda v, a: F.length(v) <= 1000, loose=lambda v, a: F.length(v) <= 3000)


@query("loose_comparison")
def _(spark, sf):
    chosen = kept(spark, sf, LOOSE_CHECK, lambda: ScoringOptions(registry=short_registry()))
    a, b = (scoring.score_samples(sql(spark, sf, fixture.check_samples_sql(LOOSE_CHECK, "spark", n)).drop("lang"), chosen)
            for n in (0, 5))
    return compare.sorted_comparison(compare.compare_models(a, b, use_strict=False))


@query("conflicting_pairs")
def _(spark, sf):
    return conflicts.conflicting_pairs(samples(spark, sf)).drop("run_file")


@query("instruction_descriptions")
def _(spark, sf):
    return scoring.describe_instructions(samples(spark, sf)).drop("run_file")


@query("drawn_args")
def _(spark, sf):
    row = F.concat(F.lit("42|"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id",
        draws.draw_between(row, "num_words", 100, 500).alias("num_words"),
        draws.draw_between(row, "num_sentences", 1, 20).alias("num_sentences"),
        draws.draw_from(row, "language", list(LANGUAGE_NAMES)).alias("language"),
        draws.draw_from(row, "relation", ["less than", "at least"]).alias("relation"),
    )


@query("sampled_words")
def _(spark, sf):
    row = F.concat(F.lit("42|"), F.col("doc_id").cast("string"))
    words = draws.sample_words(row, "keywords", DEFAULT_KEYWORD_POOL, 2)
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, ",").alias("words"))


# --- text functions ----------------------------------------------------------------


@query("text_sentences")
def _(spark, sf):
    return responses(spark, sf).select("doc_id", F.posexplode(t.sentences(F.col("response"))).alias("pos", "sentence"))


@query("text_counts")
def _(spark, sf):
    r = F.col("response")
    return responses(spark, sf).select(
        "doc_id", t.word_count(r).cast("bigint").alias("n_words"),
        sentence_model(spark, sf).count(r).cast("bigint").alias("n_sentences"),
        t.is_upper(r).alias("is_upper"), t.is_lower(r).alias("is_lower"),
    )


@query("sentence_model")
def _(spark, sf):
    """Abbreviations and sentence starters learned from the documents."""
    return SentenceModel.fit(table(spark, sf, "documents")).table(spark)


@query("abbreviation_scores")
def _(spark, sf):
    rows = abbreviation_scores(responses(spark, sf), "response")
    return rows.select("word", "n", "n_stop", (F.col("score") >= ABBREVIATION_SCORE).alias("abbreviation"))


@query("text_tokens")
def _(spark, sf):
    return responses(spark, sf).select("doc_id", F.array_join(t.word_tokens(F.col("response")), " ").alias("tokens"))


@query("text_shared_words")
def _(spark, sf):
    rows = sql(spark, sf, fixture.instructions_sql())
    joined = rows.select("doc_id", F.col("output").alias("a"), F.concat_ws(" ", "instruction", "output").alias("b"))
    return joined.select("doc_id", t.shared_word_count(F.col("a"), F.col("b")).cast("bigint").alias("shared"))


@query("text_language")
def text_language(spark, sf):
    rows = language_model(spark, sf).detect(responses(spark, sf), F.col("response"))
    return rows.select("doc_id", "lang", "detected")


@query("stripped_responses")
def _(spark, sf):
    return responses(spark, sf).select("doc_id", t.strip(F.col("response")).alias("response"))


# --- documents and runs --------------------------------------------------------------


def run_rows(spark, sf):
    return sql(spark, sf, fixture.runs_sql("spark"))


def _generation():
    return F.struct(F.lit(1024).alias("max_new_tokens"), F.lit(False).alias("do_sample")).alias("generation_config")


def run_headers(spark, sf):
    """config and metadata of each run, keyed by source."""
    return run_rows(spark, sf).select(
        F.col("source").alias("run_file"),
        F.struct(
            "model_name", "lora_path", F.coalesce("precision", F.lit("fp16")).alias("precision"),
            F.lit(2048).alias("max_seq_length"), F.lit(64).alias("batch_size"), _generation(),
            F.lit("role-headers").alias("chat_template"), F.lit("default").alias("loader"),
        ).alias("config"),
        F.struct(
            runs.run_name(F.col("model_name"), F.col("lora_path"), F.col("n") % 2 == 1).alias("run_name"),
            F.coalesce("ts", F.lit("20260101_000000")).alias("timestamp"), "num_samples",
            F.col("generation_seconds").alias("generation_time_seconds"), F.col("gpu").alias("gpu_memory_gb"),
        ).alias("metadata"),
    )


@query("read_responses")
def _(spark, sf):
    """Documents of about 64 kB as JSON text, read back into sample rows."""
    rows = samples(spark, sf).join(run_headers(spark, sf), "run_file")
    texts = sinks.responses_documents(rows, bytes_per_document=1 << 16).select(
        F.col("document").alias("file"), F.to_json(F.struct("config", "metadata", "samples")).alias("value"))
    parsed = docs.named(docs.well_formed(docs.parse_documents(texts, RESPONSES_DOCUMENT)))
    return parsed.select("display_name", F.explode("samples").alias("s")).select(
        "display_name", "s.key", "s.prompt", "s.response",
        F.array_join("s.instruction_id_list", ",").alias("ids"), F.array_join("s.kwargs", ",").alias("kwargs"))


@query("responses_documents")
def _(spark, sf):
    rows = samples(spark, sf).join(run_headers(spark, sf), "run_file")
    content = F.transform("samples", lambda s: F.concat_ws(
        "|", s["key"].cast("string"), s["prompt"], s["response"], F.array_join(s["instruction_id_list"], ","),
        F.array_join(s["kwargs"], ",")))
    return sinks.responses_documents(rows).select(
        "document", F.size("samples").cast("bigint").alias("n"), F.md5(F.array_join(content, "~")).alias("content"))


def scratch(spark, label):
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def round_trip(spark, sf):
    """Responses documents written as files, one a run, and read again in small byte ranges."""
    path = scratch(spark, "responses")
    sinks.write_responses(samples(spark, sf).join(run_headers(spark, sf), "run_file"), path)
    return docs.read_runs(spark, path, bytes_per_range=100_000)


@query("responses_round_trip")
def _(spark, sf):
    found, rows = round_trip(spark, sf)
    return rows.join(found.select(F.col("file").alias("run_file"), "display_name"), "run_file").select(
        F.col("run_file").alias("file"), "display_name", "key", "prompt", "response",
        F.array_join("instruction_id_list", ",").alias("ids"), F.array_join("kwargs", ",").alias("kwargs"))


@query("accuracy_after_round_trip")
def _(spark, sf):
    """A run is one run again: accuracies of what was written and read."""
    _, rows = round_trip(spark, sf)
    scored_rows = scoring.score_samples(rows, ScoringOptions(registry=position_free_registry()))
    return scoring.accuracy(scored_rows)


def position_free_registry():
    """A check without drawn arguments, which would depend on the run's name."""
    return Registry([replace(default_registry()["punctuation:no_comma"], enabled=True)])


@query("result_round_trip")
def _(spark, sf):
    """Result documents with their scored samples, written as files and read again."""
    path = scratch(spark, "results")
    rows = kept(spark, sf, "scored with texts", lambda: docs.laid_out(
        scoring.score_samples(samples(spark, sf), options(spark, sf), keep=("response",)), "scored"))
    built = sinks.result_documents(
        scoring.accuracy(rows), run_headers(spark, sf), F.lit("20260201_000000"), F.lit(0.5), keep_run=True)
    sinks.write_results(built, rows, path)
    heads, elements = json_documents.read_documents(spark, path, "scored_samples", bytes_per_range=100_000)
    found = docs.scored_results(docs.parse_documents(heads.select("file", "head"), RESULT_DOCUMENT, "head"))
    marks = F.from_json("element", "key bigint, scores struct<strict:array<boolean>>")
    passed = elements.select("path", marks.alias("s")).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "s.key", F.forall("s.scores.strict", lambda b: b).alias("passed"))
    return found.select("file", F.col("results.ifeval.prompt_level_strict_acc").alias("accuracy")).join(
        passed.groupBy("file").agg(F.count("key").alias("n"), F.count_if("passed").alias("passed")), "file")


@query("read_instructions")
def _(spark, sf):
    path = scratch(spark, "instructions")
    sql(spark, sf, fixture.instructions_sql()).drop("doc_id").write.option("ignoreNullFields", False).json(path)
    return docs.read_instructions(spark, path, "json")


@query("read_benchmark")
def _(spark, sf):
    path = scratch(spark, "benchmark")
    rows = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("key"), F.col("text").alias("prompt"),
        F.array(F.lit("punctuation:no_comma")).alias("instruction_id_list"), F.array(F.lit("{}")).alias("kwargs"))
    rows.write.json(path)
    found = docs.read_benchmark(spark, path, "json")
    return found.select("key", "prompt", F.array_join("instruction_id_list", ",").alias("ids"), F.array_join("kwargs", ",").alias("kwargs"))


@query("training_metadata_documents")
def _(spark, sf):
    """Training metadata written as documents and read again."""
    path = scratch(spark, "training")
    sinks.write_documents(sinks.training_metadata_documents(training_runs(spark, sf)), path)
    found = docs.read_training_metadata(spark, path)
    return found.select("file", "base_model", "precision", "dataset", "samples", "loss", "runtime_s", "timestamp")


@query("result_documents_with_samples")
def _(spark, sf):
    rows = kept(spark, sf, "scored with texts", lambda: docs.laid_out(
        scoring.score_samples(samples(spark, sf), options(spark, sf), keep=("response",)), "scored"))
    # Documents of 4 MB, of which a task holds a few; a run's are read one after another for its digest.
    built = sinks.result_documents(
        scoring.accuracy(rows), run_headers(spark, sf), F.lit("20260201_000000"), F.lit(0.5), rows, keep_run=True, bytes_per_document=4 << 20)
    marks = lambda s: F.array_join(F.transform(s["scores"]["strict"], lambda b: b.cast("string")), ",")
    content = F.transform("scored_samples", lambda s: F.concat_ws("|", s["key"].cast("string"), s["response"], marks(s)))
    parts = built.select("run_file", "part", "document", F.size("scored_samples").cast("bigint").alias("n"),
                         F.array_join(content, "~").alias("content"))
    return sinks.run_digests(parts, "~").drop("run_file")


@query("display_names")
def _(spark, sf):
    return docs.named(run_headers(spark, sf)).select("run_file", "display_name", F.col("metadata.run_name").alias("run_name"))


def result_texts(spark, sf):
    """Result documents as JSON text; those of every tenth run are cut short."""
    rows = run_rows(spark, sf)
    doc = F.struct(
        F.struct("model_name", "lora_path", "precision", "run_name", F.col("ts").alias("timestamp"),
                 F.col("gpu").alias("eval_gpu_memory_gb")).alias("metadata"),
        F.struct(F.lit(2048).alias("max_seq_length"), F.lit(64).alias("batch_size"), _generation(),
                 "num_samples").alias("config"),
        F.when(F.col("n") % 6 != 5, F.struct(
            "generation_seconds", "scoring_seconds",
            (F.col("generation_seconds") + F.col("scoring_seconds")).alias("total_seconds"))).alias("timing"),
        F.struct(F.struct(
            F.col("inst_strict").alias("inst_level_strict_acc"), F.col("inst_loose").alias("inst_level_loose_acc"),
            F.col("prompt_strict").alias("prompt_level_strict_acc"),
            F.col("prompt_loose").alias("prompt_level_loose_acc")).alias("ifeval")).alias("results"),
    )
    text = F.to_json(doc)
    return rows.select(
        "file", F.when(F.col("n") % 10 == 9, F.left(text, F.length(text) - 3)).otherwise(text).alias("value"))


def results(spark, sf):
    return docs.scored_results(docs.parse_documents(result_texts(spark, sf), RESULT_DOCUMENT))


@query("load_results")
def _(spark, sf):
    rows = docs.in_time_order(results(spark, sf))
    return rows.select(
        "file", F.col("metadata.run_name").alias("run_name"), F.col("metadata.timestamp").alias("timestamp"),
        F.col("config.num_samples").alias("num_samples"), runs.model_type().alias("model_type"))


def text_files(texts, path):
    """Each text as a file of its own, named after it; malformed ones as they are."""
    texts.select(F.col("file").alias("document"), "value").write.option("maxRecordsPerFile", 1).partitionBy("document").text(path)


@query("results_folder")
def _(spark, sf):
    """A folder of result files, some of them cut short, and files of other kinds beside them."""
    path = scratch(spark, "results")
    other = run_rows(spark, sf).select(F.concat("source", F.lit("_other.json")).alias("file"), F.lit('{"results": {"other": 1}}').alias("value"))
    text_files(result_texts(spark, sf).unionByName(other), path)
    rows = docs.in_time_order(docs.read_results(spark, path))
    return rows.select(
        "file", F.col("metadata.run_name").alias("run_name"), F.col("metadata.timestamp").alias("timestamp"),
        F.col("config.num_samples").alias("num_samples"), runs.model_type().alias("model_type"))


@query("run_configs")
def _(spark, sf):
    return runs.run_configs(results(spark, sf)).select(
        "file", "name", "model_name", "model_type", "precision", "lora_path", "max_seq_length", "batch_size",
        "num_samples", "max_new_tokens", "do_sample", F.array_join("tags", ",").alias("tags"))


@query("run_metrics")
def _(spark, sf):
    return runs.run_metrics(results(spark, sf)).select("file", F.explode("metrics").alias("metric", "value"))


@query("run_summaries")
def _(spark, sf):
    return runs.run_summaries(results(spark, sf))


@query("latest_runs")
def _(spark, sf):
    return runs.latest_per_type(results(spark, sf)).select("model_type", "file")


@query("base_vs_finetuned")
def _(spark, sf):
    return runs.base_vs_finetuned(results(spark, sf))


@query("chart_rows")
def _(spark, sf):
    return runs.chart_rows(results(spark, sf))


@query("run_timing_totals")
def _(spark, sf):
    """Timing and flat metrics of the result documents the scores lead to."""
    acc = scoring.accuracy(scored(spark, sf))
    built = sinks.result_documents(acc, run_headers(spark, sf), F.lit("20260201_000000"), F.lit(0.5))
    return built.select("document", "timing.generation_seconds", "timing.total_seconds",
                        F.explode("metrics_flat").alias("metric", "value"))


@query("result_documents")
def _(spark, sf):
    acc = scoring.accuracy(scored(spark, sf))
    built = sinks.result_documents(acc, run_headers(spark, sf), F.lit("20260201_000000"), F.lit(0.5))
    return built.select("document", "metadata.run_name", "metadata.model_name", "config.num_samples",
                        "results.ifeval.*")


def mmlu_texts(spark, sf):
    rows = run_rows(spark, sf)
    task = F.struct(F.col("prompt_strict").alias("acc_norm,none"))
    doc = F.struct(
        F.struct(task.alias("tinyMMLU")).alias("results"),
        F.struct(F.struct(F.struct(F.col("precision").alias("dtype")).alias("metadata")).alias("tinyMMLU")).alias("configs"),
        F.struct(F.struct(F.col("num_samples").alias("effective")).alias("tinyMMLU")).alias("n-samples"),
        F.struct(F.lit("16").alias("batch_size"), F.lit("float16").alias("model_dtype")).alias("config"),
        F.when(F.col("n") % 4 != 2, F.col("model_name")).alias("model_name"),
        F.col("generation_seconds").cast("string").alias("total_evaluation_time_seconds"),
    )
    return rows.select(F.concat(F.lit("mmlu_"), "source", F.lit("_results_2026.json")).alias("file"), F.to_json(doc).alias("value"))


@query("mmlu_rows")
def _(spark, sf):
    return runs.mmlu_rows(docs.well_formed(docs.parse_documents(mmlu_texts(spark, sf), MMLU_DOCUMENT)))


@query("mmlu_folder")
def _(spark, sf):
    """A folder of result files of the multiple-choice task, with malformed ones and others beside them."""
    path = scratch(spark, "mmlu")
    texts = mmlu_texts(spark, sf)
    broken = texts.select(F.concat(F.lit("mmlu_cut_"), "file").alias("file"), F.left("value", F.length("value") - 5).alias("value"))
    others = texts.select(F.concat(F.lit("other_"), "file").alias("file"), "value")
    text_files(texts.unionByName(broken).unionByName(others), path)
    return runs.mmlu_rows(docs.read_mmlu(spark, path))


def training_runs(spark, sf):
    """A training run per scored run; every second one is of another model."""
    other = F.when(F.col("n") % 2 == 0, F.lit("")).otherwise(F.lit("-x"))
    return run_rows(spark, sf).select(
        "file", F.concat("model_name", other).alias("base_model"), "precision", F.lit("docs").alias("dataset"),
        F.col("num_samples").alias("samples"), F.col("inst_strict").alias("loss"),
        F.col("generation_seconds").alias("runtime_s"), F.lit(21.5).alias("peak_gpu_gb"), F.lit("20260101").alias("timestamp"))


@query("training_metadata_runs")
def _(spark, sf):
    rows = training_runs(spark, sf)
    doc = F.struct(*[c for c in rows.columns if c != "file"])
    training = docs.well_formed(docs.parse_documents(
        rows.select("file", F.to_json(doc).alias("value")), TRAINING_METADATA))
    joined = runs.with_training_metadata(results(spark, sf), training)
    return joined.select("file", F.col("training_metadata.dataset_samples").alias("dataset_samples"),
                         F.col("training_metadata.training_loss").alias("training_loss"),
                         F.col("training_metadata.training_time_seconds").alias("training_time_seconds"))


# --- prompts, batches, conversations -----------------------------------------------------


@query("first_rows")
def _(spark, sf):
    return batching.first_rows(table(spark, sf, "documents").select("doc_id", "text"), 25, "doc_id")


@query("alpaca_user_text")
def _(spark, sf):
    return sql(spark, sf, fixture.instructions_sql()).select("doc_id", chat.alpaca_user_text().alias("user_text"))


@query("training_text")
def _(spark, sf):
    return chat.training_text(sql(spark, sf, fixture.instructions_sql()))


@query("prompt_text")
def _(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", chat.prompt_text(F.col("text"), F.col("item_id") % 2 == 0).alias("text"))


@query("truncated_prompts")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", batching.truncate_tokens(F.col("text")).alias("text"))


@query("request_throughput")
def _(spark, sf):
    rows = table(spark, sf, "documents")
    m = batching.throughput(chat.token_count(F.col("text")).cast("bigint"), F.col("n_chars") / F.lit(997.0))
    return rows.select("doc_id", m.alias("m")).select("doc_id", "m.*")


@query("prompt_batches")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return batching.prompt_batches(rows, 64, "doc_id", rows_per_block=500).select("doc_id", "position", "batch_id")


@query("batch_padding")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    return batching.batch_padding(batching.prompt_batches(rows, 8, "item_id")).select(
        "item_id", "batch_id", F.col("tokens").cast("bigint").alias("tokens"),
        F.col("padded_tokens").cast("bigint").alias("padded_tokens"), "padding_waste")


@query("generated_responses")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", chat.prompt_text(F.col("text"), True).alias("model_input"))
    echo = lambda prompts: [f"  You said: {p}\n" for p in prompts]
    return generate_responses(rows, echo, batch_size=16).select("item_id", "response")


@query("conversation_text")
def conversation_text(spark, sf):
    return chat.conversation_text(sql(spark, sf, fixture.odd_turns_sql(), "conversations"))


@query("conversation_plain_text")
def _(spark, sf):
    return chat.conversation_text(sql(spark, sf, fixture.odd_turns_sql(), "conversations"), use_chat=False)


@query("trimmed_history")
def trimmed_history(spark, sf):
    return chat.trim_history(table(spark, sf, "conversations"), budget=None)


@query("trimmed_history_over_budget")
def _(spark, sf):
    return chat.trim_history(table(spark, sf, "conversations"), budget=300)


@query("history_segments")
def _(spark, sf):
    return chat.history_segments(sql(spark, sf, fixture.turns_sql(), "conversations")).drop("text")


@query("active_history")
def _(spark, sf):
    return chat.active_history(sql(spark, sf, fixture.turns_sql(), "conversations"))
