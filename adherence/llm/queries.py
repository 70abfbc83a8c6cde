"""The registered queries of this folder: each operator over its whole table."""

from pyspark.sql import DataFrame, functions as F

from adherence.llm import (
    bpe, common, decontaminate, exact_dedup, language_id, negatives, negatives_sql, passages, pieces, quality, secret_scan, secret_sql, sharding, simhash, spelling,
    spelling_sql, token_counts,
)

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name) -> DataFrame:
    common.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fitted_languages(docs):
    """Learned from the rows with a language whose crc32 remainder by 5 is not 0."""
    return language_id.fit(docs.where(docs.lang.isNotNull() & (common.text_mod(docs.doc_id, 5) != 0)))


@query
def op1_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


@query
def op3_token_counts(spark, sf_dir):
    import public_tokenizers as vocabularies

    vocabulary = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary, vocabularies.PATTERN)


@query
def op4_substring_dedup(spark, sf_dir):
    return passages.find_passages(table(spark, sf_dir, "documents"))


@query
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(common.text_mod(labels.doc_id, 3) != 1))
    scored = docs.select("doc_id", (common.text_mod(docs.doc_id, 3) == 1).alias("held_out"),
                         quality.score_column(model, spark, docs.text).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def token_rows(docs):
    import public_tokenizers as vocabularies

    ranks = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(bpe.encode_texts(docs, ranks, vocabularies.PATTERN))


ORACLE["op5_exact_dedup"] = """
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
  sha256(norm) AS text_sha256
FROM normal
"""


@query
def op7_byte_bpe(spark, sf_dir):
    return token_rows(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fitted_languages(docs)
    folds = docs.select("doc_id", (common.text_mod(docs.doc_id, 5) == 0).alias("held_out"),
                        language_id.identify_column(model, spark, docs.text).alias("judged"))
    return folds.select("doc_id", "held_out", "judged.lang_pred", "judged.score", "judged.rejected")


@query
def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_secret_scan(spark, sf_dir):
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


ORACLE["op10_secret_scan"] = secret_sql.SQL


@query
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(vectors.vec_id % 7 == 0, (vectors.label + 1) % 10).otherwise(vectors.label)
    return negatives.hard_negatives(vectors.withColumn("label", label), negatives.every_hundredth)


ORACLE["op11_hard_negatives"] = negatives_sql.SQL


@query
def op12_spelling_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = spelling.word_counts(docs, change=spelling.without_one)
    return spelling.variant_groups(common.written(words, "words"), min_length=spelling.MIN_LENGTH)


ORACLE["op12_spelling_variants"] = spelling_sql.SQL


@query
def op13_sentencepiece(spark, sf_dir):
    import public_tokenizers as vocabularies

    docs, model = table(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model")
    return pieces.piece_digests(pieces.encode_pieces(docs, model))
