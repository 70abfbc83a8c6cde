"""Which instructions contradict each other, and prompts that ask for both."""

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adherence.operators.checks import _CHECKS
from adherence.operators.scoring import ROW_KEYS, unnest

REGISTERED = [c.inst_id for c in _CHECKS if c.enabled]

# The declared conflicts besides each instruction's with itself.
DECLARED = {
    "language:response_language": [
        "detectable_format:multiple_sections", "keywords:existence", "keywords:frequency",
        "keywords:forbidden_words", "startend:end_checker", "change_case:english_capital",
        "change_case:english_lowercase",
    ],
    "length_constraints:number_paragraphs": [
        "length_constraints:nth_paragraph_first_word", "length_constraints:number_sentences",
    ],
    "length_constraints:nth_paragraph_first_word": ["length_constraints:number_paragraphs"],
    "detectable_format:multiple_sections": [
        "language:response_language", "detectable_format:number_highlighted_sections",
    ],
    "change_case:capital_word_frequency": [
        "change_case:english_lowercase", "change_case:english_capital",
    ],
    "change_case:english_lowercase": ["change_case:english_capital"],
    "startend:quotation": ["detectable_format:title"],
}
# These conflict with everything registered but the ones listed.
DECLARED_ALL_BUT = {
    "detectable_format:constrained_response": [],
    "detectable_format:json_format": ["keywords:forbidden_words", "keywords:existence"],
    "combination:two_responses": [
        "keywords:forbidden_words", "keywords:existence", "language:response_language",
        "detectable_format:title", "punctuation:no_comma",
    ],
    "combination:repeat_prompt": [
        "keywords:existence", "detectable_format:title", "punctuation:no_comma",
    ],
}


def declared_pairs():
    """The declared conflicts as (id, other id) pairs."""
    pairs = [(a, b) for a, others in DECLARED.items() for b in others]
    for a, spared in DECLARED_ALL_BUT.items():
        pairs += [(a, b) for b in REGISTERED if b not in spared]
    return pairs


def declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(declared_pairs(), "inst_id string, other_id string")


def close(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """The symmetric and reflexive closure of a conflict relation."""
    mirrored = pairs.select(F.col("other_id").alias("inst_id"), F.col("inst_id").alias("other_id"))
    selves = ids.select("inst_id", F.col("inst_id").alias("other_id"))
    return pairs.union(mirrored).union(selves).distinct()


def conflicts(spark: SparkSession) -> DataFrame:
    ids = spark.createDataFrame([(i,) for i in REGISTERED], "inst_id string")
    return close(declared(spark), ids)


def _conflict_map() -> Column:
    """The closed relation as a constant: at most one entry per registered id."""
    closed = {i: {i} for i in REGISTERED}
    for a, b in declared_pairs():
        closed[a].add(b)
        closed[b].add(a)
    text = json.dumps({k: sorted(v) for k, v in closed.items()})
    return F.from_json(F.lit(text), "map<string,array<string>>")


def conflicting_pairs(samples: DataFrame, ids="instruction_id_list") -> DataFrame:
    """Per sample the conflicting pairs its instruction list holds, each once, the
    earlier instruction first; a repeated id conflicts with itself.

    The list is looked at within its row, so no pairs of rows are formed."""
    known = F.col("_conflicts")
    later = lambda x, i: F.slice(F.col(ids), i + 2, F.greatest(F.size(ids), F.lit(1)))
    pairs = F.flatten(
        F.transform(
            ids,
            lambda x, i: F.transform(
                F.array_intersect(F.coalesce(known[x], F.array().cast("array<string>")), later(x, i)),
                lambda o: F.struct(x.alias("inst_id"), o.alias("other_id")),
            ),
        )
    )
    rows = samples.select("run_file", "sample_pos", ids).withColumn("_conflicts", _conflict_map())
    return unnest(rows, ROW_KEYS, F.array_distinct(pairs), present="inst_id")
