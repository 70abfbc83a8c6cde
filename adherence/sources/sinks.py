"""Writers. Rows go to Parquet; nested JSON documents are for exchange."""

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from adherence.operators.runs import document_name, flat_metrics
from adherence.sources import json_documents

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTES_PER_DOCUMENT = 64 << 20
RUN_KEYS = ["run_name", "precision", "timestamp"]


def write_samples(samples: DataFrame, path, mode="append"):
    """Samples with their run keys, one folder per run."""
    samples.write.mode(mode).partitionBy(*RUN_KEYS).parquet(path)


def responses_documents(samples: DataFrame, bytes_per_document=BYTES_PER_DOCUMENT) -> DataFrame:
    """Samples (with `config` and `metadata` structs) as nested documents.

    A run of more bytes than `bytes_per_document` comes in as many numbered documents
    of about that size, in the order of its samples; the first has the run's name."""
    keys = ["config", "metadata"]
    sample = F.struct("key", "prompt", "response", "instruction_id_list", "kwargs")
    size = F.octet_length(F.concat_ws("", F.col("prompt"), F.col("response"), F.array_join("kwargs", ""))) + 100
    sizes = samples.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.ceil(F.sum(size) / bytes_per_document).alias("_parts"), (F.max("sample_pos") + 1).alias("_end"))
    part = F.floor(F.col("sample_pos") * F.col("_parts") / F.col("_end"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    sized = samples.join(sizes, same).select(*keys, "sample_pos", part.alias("part"), sample.alias("s"))
    docs = sized.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("sample_pos", "s"))).alias("_s"))
    name = document_name("metadata.run_name", "config.precision", "metadata.timestamp")
    return docs.select(
        F.when(F.col("part") == 0, name).otherwise(_numbered(name)).alias("document"),
        "config", "metadata", F.transform("_s", lambda x: x["s"]).alias("samples"),
    )


def _numbered(name):
    return F.regexp_replace(name, r"\.json$", F.concat(F.lit("."), F.col("part"), F.lit(".json")))


def _json(struct):
    return F.to_json(struct, {"ignoreNullFields": "false"})


def write_responses(samples: DataFrame, path, runs: DataFrame | None = None) -> None:
    """Samples (with `config` and `metadata` structs) as files, one document a run whatever
    its size, its samples streamed in their order. `runs` (config, metadata) adds runs
    without samples. Rows without a run name are left out."""
    name = document_name("metadata.run_name", "config.precision", "metadata.timestamp")
    header = ["config", "metadata"]
    heads = samples.select(name.alias("document"), *header)
    if runs is not None:
        heads = heads.unionByName(runs.select(name.alias("document"), *header))
    heads = heads.dropDuplicates(["document"]).select("document", _json(F.struct(*header)).alias("head"))
    sample = F.struct("key", "prompt", "response", "instruction_id_list", "kwargs")
    elements = samples.select(name.alias("document"), F.col("sample_pos").alias("pos"), _json(sample).alias("element"))
    json_documents.write_documents(heads, elements, path, "samples")


def write_results(documents: DataFrame, scored: DataFrame, path) -> None:
    """Result documents (result_documents' rows, with their run_file) as files, each with the
    scored samples of its run, streamed in their order."""
    fields = [c for c in documents.columns if c not in ("document", "run_file")]
    heads = documents.select("document", _json(F.struct(*fields)).alias("head"))
    rows = scored_sample_rows(scored)
    sample = F.struct(*[c for c in rows.columns if c not in {"run_file", "sample_pos"}])
    elements = rows.select("run_file", F.col("sample_pos").alias("pos"), _json(sample).alias("element"))
    elements = elements.join(documents.select("document", "run_file"), "run_file")
    json_documents.write_documents(heads, elements, path, "scored_samples")


def result_documents(accuracies: DataFrame, runs: DataFrame, timestamp, scoring_seconds, scored=None, keep_run=False,
                     bytes_per_document=BYTES_PER_DOCUMENT) -> DataFrame:
    """One nested result per run. `accuracies` has a row per run_file, `runs` the
    run's `config` and `metadata` next to run_file; a run without samples scores 0.
    With `scored` (samples kept with their texts) each holds its scored samples; a run of more
    bytes than `bytes_per_document` then comes in numbered documents of about that size, in the
    order of its samples (`part`), the first under the run's name."""
    acc = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    names = ["inst_level_strict_acc", "inst_level_loose_acc", "prompt_level_strict_acc", "prompt_level_loose_acc"]
    generation, scoring = F.col("metadata.generation_time_seconds"), scoring_seconds
    gpu = F.col("metadata.gpu_memory_gb")
    joined = runs.join(accuracies.select("run_file", *names), "run_file", "left")
    name, inside = document_name("metadata.run_name", "config.precision", timestamp), []
    if scored is not None:
        # The heads, a row a run, go to the samples, which are not shuffled again.
        parts = samples_by_run(scored, bytes_per_document)
        without = joined.join(scored.select("run_file").distinct(), "run_file", "left_anti")
        joined = parts.join(F.broadcast(joined), "run_file").unionByName(without, allowMissingColumns=True)
        joined = joined.withColumn("part", F.coalesce("part", F.lit(0)))
        name = F.when(F.col("part") == 0, name).otherwise(_numbered(name))
        inside = ["part", "scored_samples"]
    return joined.select(
        *(["run_file"] if keep_run else []),
        name.alias("document"),
        F.struct(
            F.col("config.model_name"), F.col("config.lora_path"), F.col("config.precision"),
            F.col("metadata.run_name"), timestamp.alias("timestamp"),
            F.array(F.lit("ifeval")).alias("tasks"), gpu.alias("eval_gpu_memory_gb"),
        ).alias("metadata"),
        F.struct(
            F.col("config.max_seq_length"), F.col("config.batch_size"),
            F.col("config.generation_config"), F.col("config.chat_template"),
            F.col("metadata.num_samples"),
        ).alias("config"),
        F.struct(
            generation.alias("generation_seconds"), scoring.alias("scoring_seconds"),
            (generation + scoring).alias("total_seconds"),
        ).alias("timing"),
        F.struct(F.struct(*[acc(n).alias(n) for n in names]).alias("ifeval")).alias("results"),
        flat_metrics({n: acc(n) for n in names}, generation, scoring, gpu).alias("metrics_flat"),
        *inside,
    )


def scored_sample_rows(scored: DataFrame) -> DataFrame:
    """Scored samples (kept with their text) in the shape of the exchange format."""
    pick = lambda n: F.transform("scores", lambda s: s[n])
    return scored.withColumn(
        "scores", F.struct(pick("strict").alias("strict"), pick("loose").alias("loose"))
    )


def samples_by_run(scored: DataFrame, bytes_per_document=BYTES_PER_DOCUMENT) -> DataFrame:
    """The scored samples of each run in order, in arrays of about `bytes_per_document` (part
    0, 1, ...): an exchange format, tables (write_table) are for the rest."""
    rows = scored_sample_rows(scored)
    inside = [c for c in rows.columns if c not in {"run_file", "sample_pos"}]
    # Where the parts behind a run's first one begin, from a running sum of its samples' sizes.
    texts = [F.octet_length(f.name) for f in rows.schema.fields if f.dataType.typeName() == "string" and f.name in inside]
    size = sum([F.coalesce(t, F.lit(0)) for t in texts], F.lit(100)).cast("bigint")
    before = Window.partitionBy("run_file").orderBy("sample_pos").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("run_file", "sample_pos", size.alias("_size"))
    starts = sizes.withColumn("_part", F.floor(F.sum("_size").over(before) / bytes_per_document)).where("_part > 0").groupBy(
        "run_file", "_part").agg(F.min("sample_pos").alias("_start")).groupBy("run_file").agg(
        F.array_sort(F.collect_set("_start")).alias("_starts"))
    part = F.size(F.filter("_starts", lambda s: s <= F.col("sample_pos")))
    placed = rows.join(F.broadcast(starts), "run_file", "left").withColumn("part", F.when(F.col("_starts").isNull(), 0).otherwise(part))
    # Dealt first: a scan's task would hold arrays of every part that begins in it.
    dealt = placed.select("run_file", "part", F.struct("sample_pos", *inside).alias("_s")).repartition("run_file", "part")
    return dealt.groupBy("run_file", "part").agg(F.array_sort(F.collect_list("_s")).alias("scored_samples"))


def run_digests(parts: DataFrame, separator) -> DataFrame:
    """The documents of a run (run_file, part, document, n samples, content) as one row: the
    first one's name, all samples, and the MD5 of the contents joined by a separator. They
    stream through one task a run, a few of them at a time."""
    contents = parts.select("run_file", "part", "document", "n", F.col("content").cast("binary").alias("content"))
    return contents.repartition("run_file").sortWithinPartitions("run_file", "part").mapInArrow(
        _md5(separator.encode()), "run_file string, document string, n bigint, content string")


def _md5(separator):
    out = pa.schema([("run_file", pa.string()), ("document", pa.string()), ("n", pa.int64()), ("content", pa.string())])

    def run(batches):
        at, digest, n = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, n, digest.hexdigest()), out)], schema=out)

        for batch in batches:
            runs, documents, sizes = (batch.column(c).to_pylist() for c in ("run_file", "document", "n"))
            for run_file, document, size, content in zip(runs, documents, sizes, batch.column("content")):
                if at is None or run_file != at[0]:
                    if at is not None:
                        yield row()
                    at, digest, n = (run_file, document), hashlib.md5(), 0
                else:
                    digest.update(separator)
                digest.update(content.as_buffer() or b"")
                n += size or 0
        if at is not None:
            yield row()

    return run


def training_metadata_documents(runs: DataFrame) -> DataFrame:
    """Training runs (base_model, precision, dataset, samples, loss, ...) as documents
    named after the model and its time."""
    name = F.concat_ws("_", F.lit("training_metadata"), F.regexp_replace("base_model", "/", "_"), "precision", "timestamp")
    return runs.withColumn("document", F.concat(name, F.lit(".json")))


def write_documents(documents: DataFrame, path, mode="overwrite"):
    """One file per row, in a folder named after its `document`; a document written
    again replaces itself, others stay. The readers of documents.py give the name back."""
    writer = documents.write.mode(mode).option("maxRecordsPerFile", 1)
    if "document" in documents.columns:
        writer = writer.partitionBy("document").option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def write_table(rows: DataFrame, path, mode="overwrite"):
    rows.write.mode(mode).parquet(path)
