"""The registry of instruction checks.

A check is a set of column builders over one instruction of one response. All
checks end up as branches of a single CASE over the instruction id, so the data
are read once whatever the number of instruction types, and only the matching
branch of a row is evaluated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adherence.functions import text as t
from adherence.functions.draws import draw_between, draw_from, sample_words
from adherence.functions.python_checks import task, wanted

# Fixed values of the checks.
RELATIONS = ["less than", "at least"]
CONSTRAINED_RESPONSES = ["My answer is yes.", "My answer is no.", "My answer is maybe."]
STARTER_OPTIONS = [
    "I would say", "My answer is", "I believe", "In my opinion", "I think", "I reckon",
    "I feel", "From my perspective", "As I see it", "According to me",
    "As far as I'm concerned", "To my understanding", "In my view", "My take on it is",
    "As per my perception",
]
ENDING_OPTIONS = ["Any other questions?", "Is there anything else I can help with?"]
SECTION_SPLITERS = ["Section", "SECTION"]
POSTSCRIPT_MARKERS = ["P.S.", "P.P.S"]
DEFAULT_KEY_SENTENCES = ["For now, this is fine."]
LANGUAGE_NAMES = {
    "en": "English", "es": "Spanish", "pt": "Portuguese", "ar": "Arabic", "hi": "Hindi",
    "fr": "French", "ru": "Russian", "de": "German", "ja": "Japanese", "it": "Italian",
    "bn": "Bengali", "uk": "Ukrainian", "th": "Thai", "ur": "Urdu", "ta": "Tamil",
    "te": "Telugu", "bg": "Bulgarian", "ko": "Korean", "pl": "Polish", "he": "Hebrew",
    "fa": "Persian", "vi": "Vietnamese", "ne": "Nepali", "sw": "Swahili", "kn": "Kannada",
    "mr": "Marathi", "gu": "Gujarati", "pa": "Punjabi", "ml": "Malayalam", "fi": "Finnish",
}
LETTERS = list("abcdefghijklmnopqrstuvwxyz")

# Words a missing keyword is drawn from, unless the caller passes a pool.
DEFAULT_KEYWORD_POOL = [
    "answer", "bridge", "candle", "distance", "engine", "family", "garden", "harbor",
    "island", "journey", "kitchen", "letter", "mountain", "notebook", "orange", "paper",
    "question", "river", "season", "travel", "umbrella", "village", "window", "yellow",
]


@dataclass(frozen=True)
class Instruction:
    """One instruction of one response, as columns."""

    text: Column
    args: Column
    raw: Column
    row_id: Column
    outcome: Column | None = None
    language: Column | None = None
    languages: tuple = ()
    keyword_pool: tuple = tuple(DEFAULT_KEYWORD_POOL)
    sentences: object = None

    def arg(self, name):
        return self.args[name]

    def unset(self, name):
        """Missing or, for a number, negative."""
        return self.arg(name).isNull() | (self.arg(name) < 0)

    def number(self, name, low, high):
        drawn = draw_between(self.row_id, name, low, high)
        return F.when(self.unset(name), drawn).otherwise(self.arg(name))

    def choice(self, name, options, clean=lambda c: c):
        return F.coalesce(clean(self.arg(name)), draw_from(self.row_id, name, options))

    def relation(self, name="relation"):
        return self.choice(name, RELATIONS)

    def keywords(self, name, n):
        given = self.arg(name)
        drawn = sample_words(self.row_id, name, self.keyword_pool, n)
        return F.when(F.size(given) > 0, given).otherwise(drawn)

    def keyword(self, name, missing):
        drawn = F.get(sample_words(self.row_id, name, self.keyword_pool, 1), F.lit(0))
        return F.when(missing, drawn).otherwise(self.arg(name))

    @property
    def n(self):
        """What Python found for this instruction, null if it had no task."""
        return self.outcome["n"]

    def compare(self, count, threshold, relation):
        """`count < threshold` for "less than", its negation for "at least"."""
        return (count < threshold) == (relation == RELATIONS[0])


@dataclass(frozen=True)
class Check:
    inst_id: str
    arg_keys: tuple
    strict: Callable[[Instruction], Column]
    describe: Callable[[Instruction], Column] | None = None
    loose: Callable[[Instruction], Column] | None = None
    problem: Callable[[Instruction], Column] | None = None
    defaulted: Callable[[Instruction], Column] | None = None
    task: Callable[[Instruction], Column] | None = None
    patterns: Callable[[Instruction], Column] | None = None
    enabled: bool = True
    arg_types: dict = field(default_factory=dict)

    def error(self, inst: Instruction) -> Column:
        """Why this instruction cannot be checked; null if it can."""
        problems = [
            F.when(
                inst.arg(k).isNull() & F.get_json_object(inst.raw, f"$.{k}").isNotNull(),
                F.lit(f"TypeError: argument {k} has the wrong type"),
            )
            for k in self.arg_keys
        ]
        if self.problem is not None:
            problems.append(self.problem(inst))
        if (self.task is not None or self.patterns is not None) and inst.outcome is not None:
            problems.append(inst.outcome["error"])
        return F.coalesce(*problems) if problems else F.lit(None).cast("string")


# --- shared builders ---------------------------------------------------------


def _bad_relation(name="relation"):
    def problem(i):
        return F.when(~i.arg(name).isin(RELATIONS), F.lit(f"ValueError: unknown {name}"))

    return problem


def _required(message, *names):
    def problem(i):
        missing = F.lit(False)
        for name in names:
            missing = missing | i.arg(name).isNull() | (i.arg(name).cast("string") == "")
        return F.when(missing, F.lit(f"ValueError: {message}"))

    return problem


def _unset(*numbers, null=(), empty=()):
    def defaulted(i):
        out = F.lit(False)
        for name in numbers:
            out = out | i.unset(name)
        for name in null:
            out = out | i.arg(name).isNull()
        for name in empty:
            out = out | i.arg(name).isNull() | (F.size(i.arg(name)) <= 0)
        return out

    return defaulted


def _counted(count, name, low, high):
    return lambda i: count(i.text) >= i.number(name, low, high)


def _fragments(pieces, verdict):
    """Split text where blank pieces may stand at the two ends only."""

    def body(p):
        full = F.size(F.filter(p, lambda x: ~t.is_blank(x)))
        ends = t.is_blank(F.get(p, F.lit(0))).cast("int") + F.when(
            F.size(p) > 1, t.is_blank(F.element_at(p, -1)).cast("int")
        ).otherwise(0)
        return (F.size(p) - full == ends) & verdict(p, full)

    return t.let(pieces, body)


def _paragraphs(i):
    pieces = t.split_all(i.text, rf"{t.WS}?\*\*\*{t.WS}?")
    return _fragments(pieces, lambda p, full: full == i.number("num_paragraphs", 1, 5))


def _two_responses(i):
    def verdict(p, full):
        kept = F.filter(p, lambda x: ~t.is_blank(x))
        return (full == 2) & t.let(
            kept, lambda k: t.strip(F.get(k, F.lit(0))) != t.strip(F.get(k, F.lit(1)))
        )

    return _fragments(t.split_all(i.text, r"\*{6}"), verdict)


def _nth_paragraph(i):
    total = i.number("num_paragraphs", 1, 5)
    given = i.arg("nth_paragraph")
    nth = F.when(
        given.isNull() | (given <= 0) | (given > total),
        draw_between(i.row_id, "nth_paragraph", F.lit(1), total + 1),
    ).otherwise(given)
    wanted = F.lower(i.keyword("first_word", i.arg("first_word").isNull()))

    def body(p):
        full = F.size(F.filter(p, lambda x: ~t.is_blank(x)))
        paragraph = t.strip(F.get(p, (nth - 1).cast("int")))
        token = F.regexp_extract(paragraph, f"^{t.NOT_WS}+", 0)
        token = F.ltrim(F.ltrim(token, F.lit("'")), F.lit('"'))
        first = F.lower(F.regexp_extract(token, "^[^.,?!'\"]*", 0))
        return (nth <= full) & (paragraph != "") & (full == total) & (first == wanted)

    return t.let(t.split_all(i.text, "\n\n"), body)


def _highlights(text):
    def full(pattern):
        return F.size(F.filter(t.find_all(text, pattern, 1), lambda x: ~t.is_blank(x)))

    return full(r"\*([^\n*]*)\*") + full(r"\*\*([^\n*]*)\*\*")


def _bullets(text):
    return t.count_matches(text, rf"(?md)^{t.WS}*\*[^*].*$") + t.count_matches(
        text, rf"(?md)^{t.WS}*-.*$"
    )


def _title(i):
    titles = t.find_all(i.text, r"<<[^\n]+>>")
    return F.exists(
        titles, lambda x: ~t.is_blank(F.rtrim(F.ltrim(x, F.lit("<")), F.lit(">")))
    )


def _letter(i):
    given = i.arg("letter")
    usable = (F.length(given) == 1) & t.matches(F.lower(given), "^[a-z]$")
    return F.when(usable, F.lower(given)).otherwise(draw_from(i.row_id, "letter", LETTERS))


def _letter_defaulted(i):
    given = i.arg("letter")
    usable = (F.length(given) == 1) & t.matches(F.lower(given), "^[a-z]$")
    return ~F.coalesce(usable, F.lit(False)) | i.unset("let_frequency") | i.arg("let_relation").isNull()


def _quotation(i):
    return t.let(
        t.strip(i.text),
        lambda s: (F.length(s) > 1) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"')),
    )


def _ending(i):
    text = F.lower(F.btrim(t.strip(i.text), F.lit('"')))
    phrase = i.choice("end_phrase", ENDING_OPTIONS, t.strip)
    return F.endswith(text, F.lower(t.strip(phrase)))


# Keyword checks: native for plain words; other patterns are translated or go to Python's own engine.
IGNORE_CASE = "(?iud)"


def _any_pattern(list_):
    return F.exists(list_, lambda k: ~t.is_plain(k))


def _existence(i):
    keywords = i.keywords("keywords", 2)
    native = F.forall(keywords, lambda k: t.matches(i.text, F.concat(F.lit(IGNORE_CASE), k)))
    return F.when(i.n.isNotNull(), i.n == F.size(keywords)).otherwise(native)


def _existence_patterns(i):
    given = i.arg("keywords")
    return F.when(_any_pattern(given), wanted("found", given, "i"))


def _forbidden(i):
    bounded = lambda w: F.concat(F.lit(IGNORE_CASE + t.BOUNDARY), w, F.lit(t.BOUNDARY))
    banned = i.keywords("forbidden_words", 2)
    native = ~F.exists(banned, lambda w: t.matches(i.text, bounded(w)))
    return F.when(i.n.isNotNull(), i.n == 0).otherwise(native)


def _forbidden_patterns(i):
    given = i.arg("forbidden_words")
    patterns = F.transform(given, lambda w: F.concat(F.lit(r"\b"), w, F.lit(r"\b")))
    return F.when(_any_pattern(given), wanted("found", patterns, "i"))


def _no_keyword(i):
    return i.arg("keyword").isNull() | (i.arg("keyword") == "")


def _frequency(i):
    keyword = t.strip(i.keyword("keyword", _no_keyword(i)))
    native = t.count_matches(i.text, F.concat(F.lit(IGNORE_CASE), keyword))
    return i.compare(
        F.coalesce(i.n, native.cast("bigint")), i.number("frequency", 1, 3), i.relation()
    )


def _frequency_patterns(i):
    given = t.strip(i.arg("keyword"))
    return F.when(~t.is_plain(given), wanted("count", F.array(given), "i"))


def _postscript(i):
    marker = i.choice("postscript_marker", POSTSCRIPT_MARKERS, t.strip)
    low = F.lower(i.text)
    return (
        F.when(marker == "P.P.S", t.matches(low, rf"p\.{t.WS}?p\.{t.WS}?s"))
        .when(marker == "P.S.", t.matches(low, rf"p\.{t.WS}?s\."))
        .when(i.n.isNotNull(), i.n > 0)
        .otherwise(t.matches(low, F.concat(F.lit("(?d)"), F.lower(marker))))
    )


def _postscript_patterns(i):
    marker = t.strip(i.arg("postscript_marker"))
    pattern = F.concat(F.lit(r"\s*"), F.lower(marker), F.lit(".*$"))
    return F.when(
        ~t.is_plain(marker) & ~marker.isin(POSTSCRIPT_MARKERS),
        wanted("count", F.array(pattern), "m", lower=True),
    )


def _sections(i):
    spliter = i.choice("section_spliter", SECTION_SPLITERS, t.strip)
    pattern = F.concat(F.lit(f"(?d){t.WS}?"), spliter, F.lit(f"{t.WS}?{t.DIGIT}+{t.WS}?"))
    native = t.count_matches(i.text, pattern)
    return F.coalesce(i.n, native.cast("bigint")) >= i.number("num_sections", 1, 5)


def _sections_patterns(i):
    given = t.strip(i.arg("section_spliter"))
    pattern = F.concat(F.lit(r"\s?"), given, F.lit(r"\s?\d+\s?"))
    return F.when(~t.is_plain(given), wanted("splits", F.array(pattern)))


def _start(i):
    starter = i.choice("starter", STARTER_OPTIONS, t.strip)
    native = t.matches(i.text, F.concat(F.lit(rf"(?md)^{t.WS}*"), starter))
    return F.when(i.n.isNotNull(), i.n > 0).otherwise(native)


def _start_patterns(i):
    given = t.strip(i.arg("starter"))
    pattern = F.concat(F.lit(r"^\s*"), given, F.lit(".*$"))
    return F.when(~t.is_plain(given), wanted("found", F.array(pattern), "m"))


def _json_task(i):
    return t.let(t.json_body(i.text), lambda b: F.when(t.may_be_json(b), task("json", b)))


def _sentence_count(i):
    return t.sentence_count(i.text) if i.sentences is None else i.sentences.count(i.text)


CHANGE = r"(?d)\*.*\*"


def _rephrase(i):
    kept = lambda c: F.regexp_replace(c, CHANGE, "")
    return kept(i.text) == kept(i.arg("original_message"))


def _rephrase_problem(i):
    original = i.arg("original_message")
    return (
        F.when(original.isNull(), F.lit("TypeError: original_message is missing"))
        .when(~t.matches(original, CHANGE), F.lit("ValueError: original_message holds no *change*"))
        .when(~t.matches(i.text, CHANGE), F.lit("ValueError: response holds no *change*"))
    )


def _key_sentences(i):
    given = F.when(F.size(i.arg("key_sentences")) > 0, i.arg("key_sentences")).otherwise(
        t.constants(DEFAULT_KEY_SENTENCES)
    )

    def body(wanted):
        return t.let(
            t.sentences(i.text),
            lambda have: F.size(F.filter(wanted, lambda s: F.array_contains(have, s)))
            == _key_sentence_number(i, wanted),
        )

    return t.let(given, body)


def _key_sentence_number(i, wanted):
    number = i.arg("num_sentences")
    drawn = draw_between(i.row_id, "num_sentences", F.lit(1), F.size(wanted))
    return F.when(number.isNull() | (number == 0), drawn).otherwise(number)


def _language(i):
    return F.coalesce(i.language == _wanted_language(i), F.lit(True))


def _in_english(i):
    return F.coalesce(i.language == "en", F.lit(True))


def _needs_language(wanted):
    """A language the model does not know cannot be judged."""

    def problem(i):
        if i.language is None:
            return F.lit("ValueError: no language model given")
        code = wanted(i)
        unknown = ~code.isin(list(i.languages)) if i.languages else F.lit(True)
        return F.when(unknown, F.concat(F.lit("ValueError: language not in the model: "), code))

    return problem


def _wanted_language(i):
    return i.choice("language", list(LANGUAGE_NAMES))


def _english(i):
    return F.lit("en")


def _relation_and(*numbers, **kw):
    return _unset(*numbers, null=("relation",), **kw)


# --- the registry ----------------------------------------------------------


_CHECKS = [
    Check("keywords:existence", ("keywords",), _existence,
          defaulted=_unset(empty=("keywords",)), patterns=_existence_patterns),
    Check("keywords:frequency", ("keyword", "frequency", "relation"), _frequency,
          problem=_bad_relation(), patterns=_frequency_patterns,
          defaulted=lambda i: _no_keyword(i) | _relation_and("frequency")(i)),
    Check("keywords:forbidden_words", ("forbidden_words",), _forbidden,
          defaulted=_unset(empty=("forbidden_words",)), patterns=_forbidden_patterns),
    Check("keywords:letter_frequency", ("letter", "let_frequency", "let_relation"),
          lambda i: i.compare(t.letter_count(i.text, _letter(i)),
                              i.number("let_frequency", 1, 10), i.relation("let_relation")),
          problem=_bad_relation("let_relation"), defaulted=_letter_defaulted),
    Check("language:response_language", ("language",),
          lambda i: _language(i) if i.language is not None else F.lit(False),
          problem=_needs_language(_wanted_language), defaulted=_unset(null=("language",))),
    Check("length_constraints:number_sentences", ("num_sentences", "relation"),
          lambda i: i.compare(_sentence_count(i), i.number("num_sentences", 1, 20), i.relation()),
          problem=_bad_relation(), defaulted=_relation_and("num_sentences")),
    Check("length_constraints:number_paragraphs", ("num_paragraphs",), _paragraphs,
          defaulted=_unset("num_paragraphs")),
    Check("length_constraints:number_words", ("num_words", "relation"),
          lambda i: i.compare(t.word_count(i.text), i.number("num_words", 100, 500), i.relation()),
          problem=_bad_relation(), defaulted=_relation_and("num_words")),
    Check("length_constraints:nth_paragraph_first_word",
          ("num_paragraphs", "nth_paragraph", "first_word"), _nth_paragraph,
          defaulted=lambda i: _unset("num_paragraphs", null=("nth_paragraph", "first_word"))(i)
          | F.coalesce((i.arg("nth_paragraph") <= 0)
                       | (i.arg("nth_paragraph") > i.arg("num_paragraphs")), F.lit(False))),
    Check("detectable_content:number_placeholders", ("num_placeholders",),
          _counted(lambda c: t.count_matches(c, r"(?d)\[.*?\]"), "num_placeholders", 1, 4),
          defaulted=_unset("num_placeholders")),
    Check("detectable_content:postscript", ("postscript_marker",), _postscript,
          defaulted=_unset(null=("postscript_marker",)), patterns=_postscript_patterns),
    Check("detectable_format:number_bullet_lists", ("num_bullets",),
          lambda i: _bullets(i.text) == i.number("num_bullets", 1, 5),
          defaulted=_unset("num_bullets")),
    Check("detectable_format:constrained_response", (),
          lambda i: F.exists(t.constants(CONSTRAINED_RESPONSES), lambda o: F.contains(i.text, o))),
    Check("detectable_format:number_highlighted_sections", ("num_highlights",),
          _counted(_highlights, "num_highlights", 1, 4), defaulted=_unset("num_highlights")),
    Check("detectable_format:multiple_sections", ("section_spliter", "num_sections"), _sections,
          defaulted=_unset("num_sections", null=("section_spliter",)), patterns=_sections_patterns),
    Check("detectable_format:json_format", (), lambda i: i.n == 1, task=_json_task),
    Check("detectable_format:title", (), _title),
    Check("combination:two_responses", (), _two_responses),
    Check("combination:repeat_prompt", ("prompt_to_repeat",),
          lambda i: F.startswith(F.lower(t.strip(i.text)),
                                 F.lower(t.strip(i.arg("prompt_to_repeat")))),
          problem=_required("prompt_to_repeat must be set", "prompt_to_repeat")),
    Check("startend:end_checker", ("end_phrase",), _ending, defaulted=_unset(null=("end_phrase",))),
    Check("change_case:capital_word_frequency", ("capital_frequency", "capital_relation"),
          lambda i: i.compare(
              t.capital_word_count(i.text),
              F.coalesce(i.arg("capital_frequency"),
                         draw_between(i.row_id, "capital_frequency", 1, 20)),
              i.relation("capital_relation")),
          problem=_bad_relation("capital_relation"),
          defaulted=_unset(null=("capital_frequency", "capital_relation"))),
    Check("change_case:english_capital", (),
          lambda i: t.is_upper(i.text) & _in_english(i) if i.language is not None else F.lit(False),
          problem=_needs_language(_english)),
    Check("change_case:english_lowercase", (),
          lambda i: t.is_lower(i.text) & _in_english(i) if i.language is not None else F.lit(False),
          problem=_needs_language(_english)),
    Check("punctuation:no_comma", (), lambda i: ~F.contains(i.text, F.lit(","))),
    Check("startend:quotation", (), _quotation),
    # complete checks that are off unless asked for
    Check("multi-turn:constrained_start", ("starter",), _start, enabled=False,
          defaulted=_unset(null=("starter",)), patterns=_start_patterns),
    Check("detectable_format:rephrase", ("original_message",), _rephrase, enabled=False,
          problem=_rephrase_problem),
    Check("keywords:key_sentences", ("key_sentences", "num_sentences"), _key_sentences,
          enabled=False,
          defaulted=lambda i: _unset(empty=("key_sentences",), null=("num_sentences",))(i)
          | (i.arg("num_sentences") == 0)),
    Check("detectable_content:rephrase_paragraph", ("original_paragraph", "low", "high"),
          lambda i: t.let(t.shared_word_count(i.arg("original_paragraph"), i.text),
                          lambda n: n.between(i.arg("low"), i.arg("high"))),
          enabled=False,
          problem=lambda i: F.when(
              i.arg("original_paragraph").isNull() | i.arg("low").isNull() | i.arg("high").isNull(),
              F.lit("TypeError: original_paragraph, low and high must be set"))),
]

LANGUAGE_CHECKS = [
    "language:response_language", "change_case:english_capital", "change_case:english_lowercase",
]


class Registry:
    """Checks by instruction id. A copy is cheap; scoring takes any registry."""

    def __init__(self, checks=()):
        self._checks = {c.inst_id: c for c in checks}

    def __iter__(self):
        return iter(self._checks.values())

    def __getitem__(self, inst_id):
        return self._checks[inst_id]

    def enabled(self):
        return [c for c in self if c.enabled]

    def enable(self, *inst_ids) -> "Registry":
        """A copy with the named checks switched on (all, if none is named)."""
        wanted = inst_ids or tuple(self._checks)
        return Registry([replace(c, enabled=c.enabled or c.inst_id in wanted) for c in self])

    def register_check(self, inst_id, arg_keys, strict, loose=None, enabled=True,
                       describe=None, arg_types=None):
        """Add a check given as column builders `(response, args) -> Column`.

        `arg_types` names the SQL types of arguments the data contract lacks."""
        wrap = lambda f: None if f is None else (lambda i: f(i.text, i.args))
        self._checks[inst_id] = Check(
            inst_id, tuple(arg_keys), wrap(strict), describe=wrap(describe), loose=wrap(loose),
            enabled=enabled, arg_types=dict(arg_types or {}),
        )
        return self

    def extra_arg_types(self):
        return {k: v for c in self for k, v in c.arg_types.items()}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a small dimension table."""
        rows = [(c.inst_id, c.inst_id.split(":")[0], list(c.arg_keys), c.enabled) for c in self]
        return spark.createDataFrame(
            rows, "inst_id string, category string, arg_keys array<string>, enabled boolean"
        )


def default_registry() -> Registry:
    from adherence.operators.descriptions import DESCRIPTIONS

    return Registry([replace(c, describe=DESCRIPTIONS[c.inst_id]) for c in _CHECKS])
