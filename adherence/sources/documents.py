"""Readers of the JSON documents and of tabular inputs.

A JSON document is read by one task, so ingest runs are wide in files, and their
rows go to Parquet (sinks.write_samples) before the heavy work.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from adherence import schemas
from adherence.operators.batching import first_rows
from adherence.operators.runs import display_name
from adherence.session import checkpoint_dir
from adherence.sources import json_documents

CORRUPT = "_corrupt_record"


def _read_json(spark, path, ddl):
    """All documents under `path`, malformed ones marked; none if it is missing. One
    document is one file, by its own name or in a folder named after it (sinks)."""
    schema = f"{ddl}, document string, `{CORRUPT}` string"
    reader = spark.read.schema(schema).option("multiLine", True).option(
        "columnNameOfCorruptRecord", CORRUPT
    )
    if "*" in path:
        reader = reader.option("basePath", path.rsplit("/", 1)[0])
    try:
        return reader.json(path).withColumn(
            "file", F.coalesce("document", F.col("_metadata.file_name"))).drop("document")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ddl}, `{CORRUPT}` string, file string")


def parse_documents(texts: DataFrame, ddl, value="value") -> DataFrame:
    """The same for documents that already are a text column, next to `file`."""
    schema = f"{ddl}, `{CORRUPT}` string"
    options = {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    return texts.select("file", F.from_json(value, schema, options).alias("d")).select("d.*", "file")


def well_formed(documents: DataFrame) -> DataFrame:
    """Leave out malformed documents."""
    return documents.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_responses(spark: SparkSession, path) -> DataFrame:
    """Responses documents, one row per file, with the model's display name."""
    return named(well_formed(_read_json(spark, path, schemas.RESPONSES_DOCUMENT)))


def read_runs(spark: SparkSession, path, bytes_per_range=json_documents.BYTES_PER_RANGE):
    """(runs, samples) of the responses documents under a path, of any size: a document is
    read in byte ranges by many tasks, and is one run.

    runs: file, display_name, config, metadata; samples: run_file, sample_pos and the fields
    of a sample. Malformed documents, also those with one malformed sample, are in neither."""
    heads, elements = json_documents.read_documents(spark, path, "samples", bytes_per_range)
    options = {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    header = f"{schemas.RESPONSES_DOCUMENT}, `{CORRUPT}` string"
    runs = heads.select("path", "file", F.from_json("head", header, options).alias("d")).select("path", "file", "d.*")
    sample = f"{schemas.SAMPLE[:-1]},`{CORRUPT}`:string>"
    samples = elements.select("path", "pos", F.from_json("element", sample, options).alias("s"))
    broken = samples.where(F.col(f"s.{CORRUPT}").isNotNull()).select("path").distinct()
    runs = well_formed(runs).drop("samples").join(broken, "path", "left_anti")
    kept = samples.join(runs.select("path", "file"), "path")
    return named(runs.drop("path")), kept.select(F.col("file").alias("run_file"), F.col("pos").alias("sample_pos"), "s.*").drop(CORRUPT)


def named(documents: DataFrame) -> DataFrame:
    return documents.withColumn("display_name", display_name())


ROWS_PER_FILE = 500


def laid_out(rows: DataFrame, label="rows", rows_per_file=ROWS_PER_FILE) -> DataFrame:
    """The rows, written once to the shared folder in files of at most `rows_per_file`
    and read back. For inputs that come in one piece (a JSON document, a Parquet file of
    one row group): the scan of many files has many tasks, and no text is shuffled. In zstd,
    since the copy stays beside the input and what is shuffled from it."""
    path = f"{checkpoint_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def samples_of(documents: DataFrame) -> DataFrame:
    """One row per sample. A sample is known by its file and place, as keys need
    not be unique."""
    return documents.select(
        F.col("file").alias("run_file"), F.posexplode("samples").alias("sample_pos", "s")
    ).select("run_file", F.col("sample_pos").cast("bigint").alias("sample_pos"), "s.*")


def read_results(spark: SparkSession, folder) -> DataFrame:
    """Result documents of a folder, without malformed ones and other kinds."""
    return scored_results(_read_json(spark, f"{folder.rstrip('/')}/*.json", schemas.RESULT_DOCUMENT))


def scored_results(documents: DataFrame) -> DataFrame:
    return well_formed(documents).where(F.col("results.ifeval").isNotNull())


def in_time_order(results: DataFrame) -> DataFrame:
    """By timestamp text, a missing one first, ties by file name."""
    return results.orderBy(F.coalesce(F.col("metadata.timestamp"), F.lit("")), "file")


def read_mmlu(spark: SparkSession, folder) -> DataFrame:
    """Results of the multiple-choice task: files named mmlu..., or folders of one document each."""
    return well_formed(_read_json(spark, f"{folder.rstrip('/')}/{{mmlu*,document=mmlu*}}.json", schemas.MMLU_DOCUMENT))


def read_comparisons(spark: SparkSession, path, ddl) -> DataFrame:
    """Comparison documents under a path, with the fields that `ddl` names."""
    return well_formed(_read_json(spark, path, ddl))


def read_training_metadata(spark: SparkSession, path) -> DataFrame:
    return well_formed(_read_json(spark, path, schemas.TRAINING_METADATA))


def _read_rows(spark, path, fmt, ddl):
    reader = spark.read.format(fmt)
    return (reader.schema(ddl) if ddl else reader).load(path)


def read_instructions(spark, path, fmt="parquet", n=None, order=None) -> DataFrame:
    """Instruction-tuning rows, optionally the first `n` by `order`."""
    ddl = schemas.INSTRUCTION_ROW if fmt == "json" and order is None else None
    return first_rows(_read_rows(spark, path, fmt, ddl), n, order)


def read_benchmark(spark, path, fmt="parquet", n=None, order="key") -> DataFrame:
    """Prompt benchmark rows, optionally the first `n`."""
    ddl = schemas.BENCHMARK_ROW if fmt == "json" else None
    return first_rows(_read_rows(spark, path, fmt, ddl), n, order)
