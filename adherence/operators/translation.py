"""Translations of the patterns that samples carry, so that no text goes to Python for them.

Patterns come with the prompts and repeat in every response to them. The distinct lists of
instructions are translated once, without any text, and written as a table; scoring joins
it to the samples by their instructions and evaluates the patterns natively. The table is
broadcast up to a size and joined by its key beyond.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from adherence.functions.patterns import Refused, translate
from adherence.session import written

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct lists of instructions up to which their translations are broadcast.
BROADCAST_ROWS = 20_000

OUTCOMES = "array<struct<n:bigint,error:string>>"
TRANSLATED = T.ArrayType(T.StructType([
    T.StructField("op", T.StringType()), T.StructField("lower", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("groups", T.IntegerType()), T.StructField("refused", T.BooleanType()), T.StructField("error", T.StringType())]))


def _translated(asked):
    """One wish of a check with the JVM's patterns; an error as Python words it."""
    if asked is None:
        return None
    out = {"op": asked["op"], "lower": asked["lower"], "patterns": [], "groups": 0, "refused": False, "error": None}
    try:
        for pattern in asked["patterns"]:
            java, out["groups"] = translate(pattern, asked["flags"])
            out["patterns"].append(java)
    except (re.error, RecursionError) as problem:
        out["error"] = f"{type(problem).__name__}: {problem}"
    except Refused:
        out["refused"] = True
    return out


@F.pandas_udf(TRANSLATED)
def _translate_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda asked: [_translated(a) for a in asked])


def instruction_key() -> Column:
    """What decides the patterns of a sample: its instructions and their arguments."""
    return F.to_json(F.struct("instruction_id_list", "kwargs"))


@dataclass
class Translations:
    """key and translated (one entry an instruction) of the samples with patterns; ids of
    the checks that take patterns; whether any pattern was refused."""

    rows: DataFrame
    ids: tuple
    refused: bool
    small: bool

    def joined(self, samples: DataFrame) -> DataFrame:
        """The samples with `_translated`. Without a pattern check there is no key to look for."""
        some = F.exists("instruction_id_list", lambda i: i.isin(list(self.ids)))
        keyed = samples.withColumn("_key", F.when(some, instruction_key()))
        table = self.rows.select(F.col("key").alias("_key"), F.col("translated").alias("_translated"))
        if self.small:
            return keyed.join(F.broadcast(table), "_key", "left").drop("_key")
        return keyed.where(F.col("_key").isNotNull()).join(table, "_key", "left").drop("_key").unionByName(
            keyed.where(F.col("_key").isNull()).drop("_key").withColumn("_translated", F.lit(None).cast(TRANSLATED)))


def translated(samples: DataFrame, options=None) -> Translations:
    """Translate the patterns of all samples (their texts are not read). Samples without
    patterns have no row; null and empty lists have none either. A broken pattern keeps
    its error, an untranslatable one is marked and goes to Python when scored."""
    from adherence.operators import scoring

    options = options or scoring.ScoringOptions()
    checks = [c for c in options.registry.enabled() if c.patterns is not None]
    ids = tuple(c.inst_id for c in checks)
    some = F.exists("instruction_id_list", lambda i: i.isin(list(ids)))
    lists = samples.where(some).select("instruction_id_list", "kwargs", instruction_key().alias("key"))
    narrow = lists.withColumns({
        "run_file": F.lit(""), "sample_pos": F.lit(0), "response": F.lit("")}).dropDuplicates(["key"])
    asked = F.transform("_instructions", lambda x: scoring.dispatch(
        x["inst_id"], checks, lambda c: c.patterns(scoring.view(x, options)), F.lit(None).cast(scoring.WANTED)))
    rows = scoring.with_instructions(narrow, options).select("key", asked.alias("asked"))
    rows = rows.where(F.exists("asked", lambda a: a.isNotNull()))
    table = written(rows.select("key", _translate_lists("asked").alias("translated")), "patterns")
    refused = F.exists("translated", lambda x: F.coalesce(x["refused"], F.lit(False)))
    counts = table.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(refused), F.lit(False)).alias("refused")).first()
    return Translations(table, ids, counts.refused, counts.n <= BROADCAST_ROWS)


def native_outcomes(name, text) -> Column:
    """What translated patterns find in the text: matches, splits with the groups they give
    back, or how many patterns occur; an entry an instruction, null for what was not asked."""

    def decided(z):
        subject = F.when(z["lower"], F.lower(text)).otherwise(text)
        only = F.get(z["patterns"], F.lit(0))
        n = (
            F.when(z["op"] == "found", F.size(F.filter(z["patterns"], lambda p: F.rlike(subject, p))))
            .when(z["op"] == "splits", F.regexp_count(subject, only) * (z["groups"] + 1))
            .otherwise(F.regexp_count(subject, only))
        )
        found = F.struct(F.when(z["error"].isNull(), n).cast("bigint").alias("n"), z["error"].alias("error"))
        return F.when(z.isNotNull() & ~z["refused"], found)

    return F.transform(name, decided)
