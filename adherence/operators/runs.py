"""Run tracking: result documents flattened into tables, base against fine-tuned."""

from pyspark.sql import Column, DataFrame, functions as F

# What marks a run name as fine-tuned, and the compared metrics.
FINETUNED_MARKS = ["sft", "finetune", "lora", "trained"]
COMPARED = [
    ("Prompt Strict Acc", "prompt_level_strict_acc"),
    ("Prompt Loose Acc", "prompt_level_loose_acc"),
    ("Inst Strict Acc", "inst_level_strict_acc"),
    ("Inst Loose Acc", "inst_level_loose_acc"),
]


def text_or(column, default="unknown") -> Column:
    return F.coalesce(column, F.lit(default))


def last_path_part(path) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def has_text(column) -> Column:
    return column.isNotNull() & (column != "")


def display_name(config="config") -> Column:
    """The adapter's folder name if there is an adapter, else the model name."""
    lora = F.col(f"{config}.lora_path")
    return F.when(has_text(lora), last_path_part(lora)).otherwise(F.col(f"{config}.model_name"))


def run_name(model_name, lora_path, alternate_loader) -> Column:
    name = F.when(has_text(lora_path), last_path_part(lora_path)).otherwise(
        F.replace(model_name, F.lit("/"), F.lit("_"))
    )
    return F.concat(name, F.when(alternate_loader, F.lit("_hf")).otherwise(F.lit("")))


def document_name(run, precision, timestamp) -> Column:
    return F.concat(F.concat_ws("_", run, precision, timestamp), F.lit(".json"))


def model_type() -> Column:
    name = F.lower(F.coalesce(F.col("metadata.run_name"), F.lit("")))
    marked = F.rlike(name, F.lit("|".join(FINETUNED_MARKS)))
    return F.when(has_text(F.col("metadata.lora_path")) | marked, "finetuned").otherwise("base")


def accuracy_of(name) -> Column:
    return F.coalesce(F.col(f"results.ifeval.{name}"), F.lit(0.0))


def run_configs(results: DataFrame) -> DataFrame:
    """One flat row of settings per run."""
    kind, precision = model_type(), text_or(F.col("metadata.precision"))
    run = text_or(F.col("metadata.run_name"))
    return results.select(
        "file",
        F.concat_ws("_", kind, precision, run).alias("name"),
        text_or(F.col("metadata.model_name")).alias("model_name"),
        kind.alias("model_type"),
        precision.alias("precision"),
        F.col("metadata.lora_path").alias("lora_path"),
        *[F.col(f"config.{c}").alias(c) for c in ("max_seq_length", "batch_size", "num_samples", "chat_template")],
        F.coalesce(F.col("metadata.tasks"), F.array().cast("array<string>")).alias("tasks"),
        F.col("config.generation_config.*"),
        F.col("training_metadata.dataset_samples").alias("training_dataset_samples"),
        F.col("training_metadata.epochs").alias("training_epochs"),
        F.col("training_metadata.learning_rate").alias("training_learning_rate"),
        F.array(kind, precision, F.lit("ifeval")).alias("tags"),
    )


def _metric_map(*pairs) -> Column:
    entries = F.create_map(*[x for name, value in pairs for x in (F.lit(name), value.cast("double"))])
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def truthy(value) -> Column:
    return F.nullif(value, F.lit(0.0))


def run_metrics(results: DataFrame) -> DataFrame:
    """One row of metrics per run, as a map; absent metrics have no entry."""
    timed = F.col("timing").isNotNull()
    timing = lambda n: F.when(timed, F.coalesce(F.col(f"timing.{n}"), F.lit(0.0)))
    training = lambda n: truthy(F.col(f"training_metadata.{n}"))
    return results.select(
        "file",
        _metric_map(
            # Metric names of the tracking tables.
            ("ifeval/prompt_strict_acc", accuracy_of("prompt_level_strict_acc")),
            ("ifeval/prompt_loose_acc", accuracy_of("prompt_level_loose_acc")),
            ("ifeval/inst_strict_acc", accuracy_of("inst_level_strict_acc")),
            ("ifeval/inst_loose_acc", accuracy_of("inst_level_loose_acc")),
            ("timing/generation_seconds", timing("generation_seconds")),
            ("timing/scoring_seconds", timing("scoring_seconds")),
            ("timing/total_seconds", timing("total_seconds")),
            ("training/time_seconds", training("training_time_seconds")),
            ("training/final_loss", training("training_loss")),
            ("training/peak_gpu_memory_gb", training("peak_gpu_memory_gb")),
            ("training/samples_per_second", training("training_samples_per_second")),
            ("eval/gpu_memory_gb", truthy(F.col("metadata.eval_gpu_memory_gb"))),
        ).alias("metrics"),
    )


def run_summaries(results: DataFrame) -> DataFrame:
    """Seven (metric, value) rows per run."""
    rows = [
        ("Model", text_or(F.col("metadata.model_name"))),
        ("Type", model_type()),
        ("Precision", text_or(F.col("metadata.precision"))),
        *[(label, F.format_string("%.4f", accuracy_of(name))) for label, name in COMPARED],
    ]
    pairs = F.array(*[F.struct(F.lit(m).alias("Metric"), v.alias("Value")) for m, v in rows])
    return results.select("file", F.inline(pairs))


def flat_metrics(accuracies, generation_seconds, scoring_seconds, gpu_memory_gb) -> Column:
    """The `metrics_flat` map of a result document. `accuracies` maps names to columns."""
    return _metric_map(
        # Metric names of the exchange format.
        *[(f"ifeval/{n}", c) for n, c in accuracies.items()],
        ("timing/generation_seconds", generation_seconds),
        ("timing/scoring_seconds", scoring_seconds),
        ("timing/total_seconds", generation_seconds + scoring_seconds),
        ("eval/gpu_memory_gb", truthy(gpu_memory_gb)),
    )


def mmlu_rows(documents: DataFrame) -> DataFrame:
    task_dtype = F.col("configs.tinyMMLU.metadata.dtype")
    stem = F.regexp_replace(last_path_part(F.col("file")), r"\.json$", "")
    return documents.select(
        F.replace(stem, F.lit("_results"), F.lit("")).alias("run_name"),
        text_or(F.col("model_name")).alias("model_name"),
        F.coalesce(task_dtype, F.col("config.model_dtype")).alias("dtype"),
        F.col("config.batch_size").alias("batch_size"),
        F.col("`n-samples`.tinyMMLU.effective").alias("n_samples"),
        F.coalesce(F.col("results.tinyMMLU.`acc_norm,none`"), F.lit(0.0)).alias("acc_norm"),
        F.coalesce(
            F.col("total_evaluation_time_seconds").try_cast("double"), F.lit(0.0)
        ).alias("eval_time_seconds"),
        text_or(task_dtype).alias("dtype_tag"),
    )


def latest_per_type(results: DataFrame) -> DataFrame:
    """The last run of each type by (timestamp, file). An aggregate, so a type that
    holds most runs is reduced before the shuffle."""
    when = F.struct(F.coalesce(F.col("metadata.timestamp"), F.lit("")), F.col("file"))
    picked = results.groupBy(model_type().alias("model_type")).agg(
        F.max_by(F.struct("file", "metadata", "results"), when).alias("run")
    )
    return picked.select("model_type", "run.*")


def _both_sides(results):
    """One row with the accuracies of the two latest runs; none unless both exist."""
    latest = latest_per_type(results)
    side = lambda kind, name: F.max(F.when(F.col("model_type") == kind, accuracy_of(name)))
    return latest.agg(
        *[side(kind, name).alias(f"{kind}_{name}") for _, name in COMPARED for kind in ("base", "finetuned")]
    ).where(
        F.col(f"base_{COMPARED[0][1]}").isNotNull() & F.col(f"finetuned_{COMPARED[0][1]}").isNotNull()
    )


def improvement(base, tuned) -> Column:
    gain = tuned - base
    plain = F.format_string("%+.4f", gain)
    percent = F.format_string("%+.4f (%+.1f%%)", gain, F.try_divide(gain, base) * 100)
    return F.when(base > 0, percent).otherwise(plain)


def base_vs_finetuned(results: DataFrame) -> DataFrame:
    rows = []
    for label, name in COMPARED:
        base, tuned = F.col(f"base_{name}"), F.col(f"finetuned_{name}")
        rows.append(F.struct(
            F.lit(label).alias("Metric"),
            F.format_string("%.4f", base).alias("Base"),
            F.format_string("%.4f", tuned).alias("Finetuned"),
            improvement(base, tuned).alias("Improvement"),
        ))
    return _both_sides(results).select(F.inline(F.array(*rows)))


def chart_rows(results: DataFrame) -> DataFrame:
    """Rows of the two bar charts: strict accuracy of both latest runs."""
    charts = [
        ("comparison/prompt_strict_acc", "prompt_level_strict_acc"),
        ("comparison/inst_strict_acc", "inst_level_strict_acc"),
    ]
    rows = [
        F.struct(F.lit(chart).alias("chart"), F.lit(label).alias("Model"), F.col(f"{kind}_{name}").alias("Accuracy"))
        for chart, name in charts
        for label, kind in (("Base", "base"), ("Finetuned", "finetuned"))
    ]
    return _both_sides(results).select(F.inline(F.array(*rows)))


def with_training_metadata(results: DataFrame, training: DataFrame) -> DataFrame:
    """Attach training metadata by base model and precision, under the names the
    run tables read: of several the newest, of equal times the one with the larger
    values. Runs without any keep nulls."""
    found = F.struct(
        F.col("samples").alias("dataset_samples"),
        F.lit(None).cast("double").alias("epochs"),
        F.lit(None).cast("double").alias("learning_rate"),
        F.col("runtime_s").alias("training_time_seconds"),
        F.col("loss").alias("training_loss"),
        F.col("peak_gpu_gb").alias("peak_gpu_memory_gb"),
        F.try_divide("samples", "runtime_s").alias("training_samples_per_second"),
    )
    newest = F.max(F.struct(F.col("timestamp").alias("at"), found.alias("found")))
    mapped = training.groupBy("base_model", "precision").agg(newest.alias("_newest")).select(
        "base_model", "precision", F.col("_newest.found").alias("training_metadata"))
    runs = results.drop("training_metadata")
    return runs.join(
        mapped,
        (runs["metadata.model_name"] == mapped["base_model"])
        & (runs["metadata.precision"] == mapped["precision"]),
        "left",
    ).drop("base_model", "precision")
