"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read back as the next one's docs. All but the last keep the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from adherence.llm import common, decontaminate, exact_dedup, language_id, queries, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that are rejected go. Null and empty texts, and
    those without a letter, are in no language and go; null and repeated ids stay as they are;
    without a labelled row only texts without a letter go; an empty table stays empty.
    All columns stay."""
    common.bounded_batches(spark)
    return language_id.keep_identified(docs, queries.fitted_languages(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id.
    Null texts count as empty and are equal to each other; of rows that repeat an id and a
    text one stays; an empty table stays empty. All columns stay."""
    common.bounded_batches(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows that repeat
    that id and fingerprint all stay. Null and empty texts are near each other; an empty table
    stays empty. All columns stay."""
    common.bounded_batches(spark)
    return simhash.drop_near_copies(docs, shingle=3, max_distance=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; an id whose rows
    together hold an item goes with all of them; without items all stay. All columns stay."""
    common.bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what stayed, a row for each row; null texts count as empty."""
    common.bounded_batches(spark)
    return queries.token_rows(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: SQL cannot express the language model or the templates; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents, with a written table between stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
