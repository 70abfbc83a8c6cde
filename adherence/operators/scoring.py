"""Scoring: one output row per sample, with the outcome of each instruction.

The whole of it is row-local. Instructions are checked inside their sample row,
so the response text is neither multiplied by an explode nor shuffled, and the
sample-level verdict needs no group-by. Roll-ups start from counts per row and
combine on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adherence.functions import text as t
from adherence.functions.python_checks import WANTED, decide_tasks, no_task, task_of
from adherence.operators.checks import (
    DEFAULT_KEYWORD_POOL,
    LANGUAGE_CHECKS,
    Instruction,
    Registry,
    default_registry,
)
from adherence.operators.language import LanguageModel
from adherence.operators.translation import OUTCOMES, Translations, native_outcomes
from adherence.schemas import args_ddl

END_OF_ARGS = "\u241fend of arguments"
ROW_KEYS = ["run_file", "sample_pos"]


@dataclass
class ScoringOptions:
    registry: Registry = field(default_factory=default_registry)
    seed: int = 42
    keyword_pool: tuple = tuple(DEFAULT_KEYWORD_POOL)
    on_error: str = "mark"  # or "fail"
    translations: Translations | None = None  # of the samples' patterns, from translation.translated
    language_model: object = None  # operators.language.LanguageModel; None: its default where a check needs one, False: none
    sentence_model: object = None  # operators.sentences.SentenceModel; fixed abbreviations without one
    _columns: dict = field(default_factory=dict, repr=False, compare=False)

    def language(self):
        """The language model that the enabled checks use, if any."""
        needed = any(c.inst_id in LANGUAGE_CHECKS for c in self.registry.enabled())
        if self.language_model is None and needed:
            return LanguageModel.default(SparkSession.active())
        return self.language_model or None

    def columns(self, name, build):
        """Column trees are built once per options and session; they refer to
        input columns by name only."""
        key = (name, SparkSession.active().sparkContext.applicationId)
        if key not in self._columns:
            self._columns[key] = build(self)
        return self._columns[key]


_DEFAULT = ScoringOptions()


def category(inst_id) -> Column:
    return F.substring_index(inst_id, ":", 1)


def parse_args(kwargs, extra=None) -> Column:
    """Arguments of one instruction; anything but one JSON object means none. The text is
    also read as the first of two array elements: whatever follows the object keeps the
    second from being the mark that was put there."""
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    parsed = F.from_json(kwargs, args_ddl(extra), options)
    marked = F.concat(F.lit("["), kwargs, F.lit(f',"{END_OF_ARGS}"]'))
    elements = F.from_json(marked, "array<string>", options)
    whole = F.rlike(kwargs, F.lit(r"\A\s*\{")) & (F.size(elements) == 2) & (F.get(elements, F.lit(1)) == END_OF_ARGS)
    return F.when(whole, parsed)


def paired(ids, kwargs) -> Column:
    """Ids with their arguments, cut to the shorter of the two lists."""
    n = F.least(F.size(ids), F.size(kwargs))
    pairs = F.arrays_zip(ids.alias("inst_id"), kwargs.alias("kwargs"))
    empty = F.array().cast("array<struct<inst_id:string,kwargs:string>>")
    named = F.transform(
        F.slice(pairs, F.lit(1), n),
        lambda p: F.struct(p["inst_id"].alias("inst_id"), p["kwargs"].alias("kwargs")),
    )
    return F.when(n > 0, named).otherwise(empty)


def dropped_instructions(ids, kwargs) -> Column:
    """How many ids have no arguments to go with and so are not scored."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return F.greatest(size(ids) - size(kwargs), F.lit(0))


def _instructions(options):
    return F.transform(
        paired(F.col("instruction_id_list"), F.col("kwargs")),
        lambda p, pos: F.struct(
            pos.alias("inst_pos"),
            p["inst_id"].alias("inst_id"),
            p["kwargs"].alias("raw"),
            parse_args(p["kwargs"], options.registry.extra_arg_types()).alias("args"),
        ),
    )


def dispatch(inst_id, checks, branch, otherwise):
    out = None
    for check in checks:
        out = (F if out is None else out).when(inst_id == check.inst_id, branch(check))
    return otherwise if out is None else out.otherwise(otherwise)


def view(x, options, outcome=None, language=None) -> Instruction:
    row_id = F.concat_ws(
        "|", F.lit(str(options.seed)), F.col("run_file"),
        F.col("sample_pos").cast("string"), x["inst_pos"].cast("string"),
    )
    return Instruction(
        text=F.col("response"), args=x["args"], raw=F.when(x["args"].isNotNull(), x["raw"]), row_id=row_id, outcome=outcome,
        language=None if language is None else F.col("_language"),
        languages=() if language is None else tuple(language.names),
        keyword_pool=tuple(options.keyword_pool), sentences=options.sentence_model,
    )


def _verdict(check, inst):
    error = check.error(inst)
    verdict = lambda builder: F.when(
        error.isNull(), F.coalesce(builder(inst), F.lit(False))
    ).otherwise(F.lit(False))
    defaulted = F.lit(False) if check.defaulted is None else check.defaulted(inst)
    return F.struct(
        F.lit(True).alias("known"),
        verdict(check.strict).alias("strict"),
        (F.lit(None).cast("boolean") if check.loose is None else verdict(check.loose)).alias("loose"),
        error.alias("error"),
        F.coalesce(defaulted, F.lit(False)).alias("arg_defaulted"),
    )


def _fixed_verdict(known, error):
    return F.struct(
        F.lit(known).alias("known"), F.lit(False).alias("strict"), F.lit(False).alias("loose"),
        F.lit(error).cast("string").alias("error"), F.lit(False).alias("arg_defaulted"),
    )


def _tasks(options):
    """What goes to Python: texts that may be JSON, and patterns without a translation."""
    translations = options.translations
    python_patterns = translations is None or translations.refused
    tasked = [c for c in options.registry.enabled() if c.task is not None or c.patterns is not None and python_patterns]
    if not tasked:
        return None

    def asked(check, inst, i):
        if check.task is not None:
            return check.task(inst)
        todo = check.patterns(inst)
        if translations is not None:
            todo = F.when(F.get("_translated", i)["refused"], todo)
        return t.let(todo, lambda w: task_of(w, inst.text))

    def needed(x, i):
        inst = view(x, options)
        return dispatch(x["inst_id"], tasked, lambda c: asked(c, inst, i), no_task())

    return F.transform("_instructions", needed)


def _scores(options):
    checks, language = options.registry.enabled(), options.language()

    def scored(x, i):
        inst = view(x, options, F.get("_outcomes", i), language)
        return F.when(
            F.col("response").isNull(), _fixed_verdict(True, "TypeError: response is null")
        ).otherwise(
            dispatch(x["inst_id"], checks, lambda c: _verdict(c, inst), _fixed_verdict(False, None))
        )

    pairs = F.arrays_zip(
        F.col("_instructions").alias("i"), F.transform("_instructions", scored).alias("v")
    )
    return F.transform(
        pairs,
        lambda z: F.struct(
            z["i"]["inst_pos"].alias("inst_pos"),
            z["i"]["inst_id"].alias("inst_id"),
            category(z["i"]["inst_id"]).alias("category"),
            z["v"]["known"].alias("known"),
            z["v"]["strict"].alias("strict"),
            F.coalesce(z["v"]["loose"], z["v"]["strict"]).alias("loose"),
            z["v"]["error"].alias("error"),
            z["v"]["arg_defaulted"].alias("arg_defaulted"),
        ),
    )


def with_instructions(samples: DataFrame, options=None) -> DataFrame:
    """Pair ids with arguments and parse them, without touching the text."""
    options = options or _DEFAULT
    return samples.withColumn("_instructions", options.columns("instructions", _instructions))


def score_samples(samples: DataFrame, options: ScoringOptions | None = None, keep=()) -> DataFrame:
    """Score every sample row.

    Adds `scores` (one struct per instruction, in order), the two prompt-level
    verdicts and the number of dropped ids. Text columns are left behind unless
    named in `keep`.
    """
    options = options or _DEFAULT
    rows = with_instructions(samples, options)

    language = options.language()
    if language is not None:
        needed = F.exists("_instructions", lambda x: x["inst_id"].isin(LANGUAGE_CHECKS))
        rows = language.detect(rows, F.when(needed, F.col("response")), "_language")

    outcomes = []
    if options.translations is not None:
        rows = options.translations.joined(rows)
        outcomes.append(native_outcomes("_translated", F.col("response")))
    tasks = options.columns("tasks", _tasks)
    if tasks is not None:
        some = F.exists("_tasks", lambda x: x.isNotNull())
        rows = rows.withColumn("_tasks", tasks)
        outcomes.append(decide_tasks(F.when(some, F.col("_tasks"))))
    if len(outcomes) == 2:
        rows = rows.withColumn("_decided", outcomes[1])
        outcomes = [F.transform("_instructions", lambda x, i: F.coalesce(F.get(outcomes[0], i), F.get("_decided", i)))]
    rows = rows.withColumn("_outcomes", outcomes[0] if outcomes else F.lit(None).cast(OUTCOMES))

    scores = options.columns("scores", _scores)
    if options.on_error == "fail":
        bad = F.filter("scores", lambda x: x["error"].isNotNull())
        fail = F.when(F.size(bad) > 0, F.raise_error(F.get(bad, F.lit(0))["error"]))
    else:
        fail = None

    names = [c for c in samples.columns if c in {*ROW_KEYS, "key", *keep}]
    rows = rows.select(
        *names,
        dropped_instructions(F.col("instruction_id_list"), F.col("kwargs")).alias("dropped_instructions"),
        scores.alias("scores"),
    )
    if fail is not None:
        rows = rows.withColumn("scores", F.coalesce(fail.cast(rows.schema["scores"].dataType), F.col("scores")))
    return rows.withColumns(
        {
            "prompt_strict_pass": F.forall("scores", lambda s: s["strict"]),
            "prompt_loose_pass": F.forall("scores", lambda s: s["loose"]),
        }
    )


def unnest(rows: DataFrame, keys, structs, present="inst_pos") -> DataFrame:
    """One row per struct of an array column.

    The outer form with a filter behind it: for the inner form the optimizer adds
    a size test on the array and pushes it down to the scan, so that a computed
    array would be computed twice."""
    return rows.select(*keys, F.inline_outer(structs)).where(F.col(present).isNotNull())


def scores_long(scored: DataFrame, keys=("run_file", "sample_pos")) -> DataFrame:
    """One narrow row per scored instruction."""
    return unnest(scored, keys, "scores")


def parsed_instructions(samples: DataFrame, options=None) -> DataFrame:
    """One row per scored instruction with its parsed arguments."""
    return unnest(with_instructions(samples, options), ROW_KEYS, "_instructions")


def accepted_args(samples: DataFrame, registry: DataFrame, options=None) -> DataFrame:
    """Per instruction: whether the registry knows it, and which of the given
    argument names it takes. The registry is a small fixed table."""
    rows = parsed_instructions(samples, options)
    valid = F.when(F.col("args").isNotNull(), F.col("raw"))
    given = F.coalesce(F.json_object_keys(valid), F.array().cast("array<string>"))
    return rows.join(F.broadcast(registry), "inst_id", "left").select(
        *ROW_KEYS, "inst_pos", "inst_id",
        F.coalesce("enabled", F.lit(False)).alias("known"),
        F.array_intersect(given, F.coalesce("arg_keys", F.array().cast("array<string>"))).alias("accepted"),
    )


def describe_instructions(samples: DataFrame, options=None) -> DataFrame:
    """The wording of every known instruction, one row each."""
    options = options or _DEFAULT
    rows = with_instructions(samples, options)
    return unnest(rows, ROW_KEYS, options.columns("descriptions", _descriptions))


def _descriptions(options):
    checks = [c for c in options.registry.enabled() if c.describe is not None]

    def described(x):
        inst = view(x, options)
        text = dispatch(
            x["inst_id"], checks, lambda c: c.describe(inst), F.lit(None).cast("string")
        )
        return F.struct(
            x["inst_pos"].alias("inst_pos"), x["inst_id"].alias("inst_id"), text.alias("description")
        )

    return F.transform("_instructions", described)


def _passes(name):
    return F.size(F.filter("scores", lambda s: s[name]))


def _ratio(part, whole):
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def accuracy(scored: DataFrame, by=("run_file",)) -> DataFrame:
    """Instruction- and prompt-level accuracy per group, in one pass."""
    counts = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum(F.size("scores")).alias("num_instructions"),
        F.sum(_passes("strict")).alias("inst_strict_pass"),
        F.sum(_passes("loose")).alias("inst_loose_pass"),
        F.count_if("prompt_strict_pass").alias("prompt_strict_pass"),
        F.count_if("prompt_loose_pass").alias("prompt_loose_pass"),
        F.sum("dropped_instructions").alias("dropped_instructions"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracies next to the counts they come from."""
    return counts.withColumns(
        {
            "inst_level_strict_acc": _ratio(F.col("inst_strict_pass"), F.col("num_instructions")),
            "inst_level_loose_acc": _ratio(F.col("inst_loose_pass"), F.col("num_instructions")),
            "prompt_level_strict_acc": _ratio(F.col("prompt_strict_pass"), F.col("num_samples")),
            "prompt_level_loose_acc": _ratio(F.col("prompt_loose_pass"), F.col("num_samples")),
        }
    )


def sample_outcomes(scored: DataFrame) -> DataFrame:
    """Per sample: the outcome lists and the two verdicts."""
    pick = lambda name: F.transform("scores", lambda s: s[name])
    return scored.withColumn("strict", pick("strict")).withColumn("loose", pick("loose"))
