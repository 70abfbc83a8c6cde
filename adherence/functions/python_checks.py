"""The two things no native expression decides: whether a text is JSON as
Python's reader accepts it, and what a caller-supplied regular expression means.

Only rows that hold such a task reach Python with content: the task list of any
other row is null.
"""

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK = "struct<op:string,text:string,patterns:array<string>,flags:string>"
OUTCOME = T.StructType([T.StructField("n", T.LongType()), T.StructField("error", T.StringType())])


def _decide(task):
    """The number a task asks for: matches, splits, patterns found, or 1/0 for JSON."""
    op, text = task["op"], task["text"]
    if op == "json":
        try:
            json.loads(text)
        except ValueError:
            return 0
        return 1
    flags = {"i": re.IGNORECASE, "m": re.MULTILINE}.get(task["flags"], 0)
    patterns = [re.compile(p, flags) for p in task["patterns"]]
    if op == "found":
        return sum(p.search(text) is not None for p in patterns)
    if op == "splits":
        return len(patterns[0].split(text)) - 1
    return len(patterns[0].findall(text))


def _outcome(task):
    if task is None:
        return None
    try:
        return {"n": _decide(task), "error": None}
    except (re.error, RecursionError) as problem:
        return {"n": None, "error": f"{type(problem).__name__}: {problem}"}


@F.pandas_udf(T.ArrayType(OUTCOME))
def decide_tasks(tasks: pd.Series) -> pd.Series:
    return tasks.map(lambda row: None if row is None else [_outcome(t) for t in row])


WANTED = "struct<op:string,patterns:array<string>,flags:string,lower:boolean>"


def wanted(op, patterns, flags="", lower=False) -> Column:
    """What a check asks of caller-supplied patterns; `lower`: of the text in lower case."""
    return F.struct(
        F.lit(op).alias("op"), patterns.alias("patterns"), F.lit(flags).alias("flags"), F.lit(lower).alias("lower"))


def no_task() -> Column:
    return F.lit(None).cast(TASK)


def task(op, text, patterns=None, flags="") -> Column:
    return F.struct(
        F.lit(op).alias("op"),
        text.alias("text"),
        (F.lit(None).cast("array<string>") if patterns is None else patterns).alias("patterns"),
        F.lit(flags).alias("flags"),
    )


def task_of(asked, text) -> Column:
    """The same as a task for Python, with the text; null where nothing is asked."""
    return F.when(
        asked.isNotNull() & text.isNotNull(),
        F.struct(
            asked["op"].alias("op"), F.when(asked["lower"], F.lower(text)).otherwise(text).alias("text"),
            asked["patterns"].alias("patterns"), asked["flags"].alias("flags")),
    )
