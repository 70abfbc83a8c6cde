"""Sentence ends learned from text without labels.

An abbreviation is a word that a full stop follows almost always; a sentence starter is
a word that comes after a sentence end more often than elsewhere. Both are decided by
log-likelihood ratios of token counts (Kiss and Strunk, 2006): one aggregation over the
tokens for abbreviations, one over neighbouring tokens for starters. What remains is a
small table of words; the decision about a text is row-local and native.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adherence.functions import text as t
from adherence.session import written

# The thresholds of the method and its share of full stops after an abbreviation.
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
STOP_SHARE = 0.99

# Characters that may stand around a word; TRAILING is what t.CLOSERS names, OPENING its counterpart.
AROUND = "\"'“”‘’()[]{}«»,;:*_<>-"
OPENING = "[\"'“”‘’(\\[{«*_<-]*"
TYPE = r"\p{L}(?:[\p{L}.]*\p{L})?"
INITIALS = r"\A(?:\p{L}[.])*\p{L}\z"

_SHORT = rf"(?<![\p{{L}}\p{{N}}.])({TYPE})[.]{t.WS}+(?={OPENING}([\p{{L}}\p{{N}}]*))"
_ENDS = rf"[.?!]+{t.CLOSERS}{t.WS}+"
_RUNNING = rf"[.]{{2,}}{t.WS}+(?=[^\p{{Lu}}{t.SPACES}])"


def _words(text) -> Column:
    """The tokens of a text, empty for a blank one."""
    stripped = t.strip(F.coalesce(text, F.lit("")))
    return F.filter(F.split(stripped, f"{t.WS}+", -1), lambda w: w != "")


def _core(token) -> Column:
    return F.btrim(token, F.lit(AROUND))


def _stopped(core) -> Column:
    """One full stop at the end, not several."""
    return t.matches(core, r"(?:\A|[^.])[.]\z")


def _type(core) -> Column:
    """The word in lower case without its full stop; null for what is no word."""
    word = F.when(_stopped(core), F.left(core, F.length(core) - 1)).otherwise(core)
    return F.when(t.matches(word, rf"\A{TYPE}\z"), F.lower(word))


def _first_word(token) -> Column:
    return F.lower(F.regexp_extract(token, rf"\A{OPENING}([\p{{L}}\p{{N}}]+)", 1))


def _log_odds(k, n, p) -> Column:
    """k ln p + (n - k) ln (1 - p), where a count of zero adds nothing."""
    part = lambda c, q: F.when(c > 0, c * F.ln(q)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def abbreviation_scores(texts: DataFrame, text_col="text") -> DataFrame:
    """word, n, n_stop, score of every word that a full stop follows somewhere: how much
    better a share of STOP_SHARE explains its full stops than the share of all tokens,
    less for long words, more for inner stops, less for each occurrence without one."""
    # Counted as they stand first, so that patterns meet distinct tokens only.
    tokens = texts.select(F.explode(_words(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    cores = tokens.select(_core(F.col("token")).alias("core"), "n")
    typed = cores.select(_type(F.col("core")).alias("word"), F.when(_stopped(F.col("core")), F.col("n")).otherwise(0).alias("stop"), "n")
    counts = typed.groupBy("word").agg(F.sum("n").alias("n"), F.sum("stop").alias("n_stop"))
    counts = written(counts, "word-counts")  # a row a word, read twice
    total = counts.agg(F.sum("n").alias("tokens"), F.sum("n_stop").alias("stops"))
    k, n = F.col("n_stop").cast("double"), F.col("n").cast("double")
    ratio = -2 * (_log_odds(k, n, F.col("stops") / F.col("tokens")) - _log_odds(k, n, F.lit(STOP_SHARE)))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - inner).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, k - n)
    found = counts.where(F.col("word").isNotNull() & (F.col("n_stop") > 0))
    return found.join(F.broadcast(total), how="cross").select("word", "n", "n_stop", score.alias("score"))


def starter_scores(texts: DataFrame, abbreviations, text_col="text") -> DataFrame:
    """word, n, n_start, score of every word that follows a sentence end somewhere: the
    log-likelihood ratio of word and sentence end, where they attract each other."""
    words = texts.select(_words(F.col(text_col)).alias("w"))
    neighbours = words.select(F.explode(F.arrays_zip(
        F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("before"),
        F.col("w").alias("token"))).alias("x"))
    core = _core(F.col("x.before"))
    kind = _type(core)
    short = F.coalesce(kind.isin(list(abbreviations)) | t.matches(kind, INITIALS), F.lit(False)) & _stopped(core)
    ended = F.coalesce(t.matches(core, r"[.?!]\z") & ~short & ~t.matches(core, r"[.]{2}\z"), F.lit(False))
    marked = F.contains(F.col("x.before"), F.lit(".")) | F.contains(F.col("x.before"), F.lit("?")) | F.contains(F.col("x.before"), F.lit("!"))
    rows = neighbours.select(F.col("x.token").alias("token"), F.when(marked, ended).otherwise(False).alias("start"))
    rows = rows.groupBy("token", "start").agg(F.count("*").alias("n"))
    rows = rows.select(_first_word(F.col("token")).alias("word"), F.when(F.col("start"), F.col("n")).otherwise(0).alias("start"), "n")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("start").alias("n_start"))
    counts = written(counts, "start-counts")
    total = counts.agg(F.sum("n").alias("tokens"), F.sum("n_start").alias("starts"))
    n, k = F.col("n").cast("double"), F.col("n_start").cast("double")
    tokens, starts = F.col("tokens").cast("double"), F.col("starts").cast("double")
    p, p1, p2 = n / tokens, k / starts, (n - k) / F.greatest(tokens - starts, F.lit(1.0))
    ratio = -2 * (_log_odds(k, starts, p) + _log_odds(n - k, tokens - starts, p)
                  - _log_odds(k, starts, p1) - _log_odds(n - k, tokens - starts, p2))
    found = counts.where((F.col("word") != "") & (F.col("n_start") > 0)).join(F.broadcast(total), how="cross")
    return found.where(p1 > p).select("word", "n", "n_start", ratio.alias("score"))


@dataclass(frozen=True)
class SentenceModel:
    """Abbreviations and sentence starters, in lower case. Their number is that of words
    which a full stop or a sentence end marks out, not that of the vocabulary."""

    abbreviations: tuple = ()
    starters: tuple = ()

    @staticmethod
    def fit(texts: DataFrame, text_col="text", known=()) -> "SentenceModel":
        """Learned from all texts; `known` abbreviations are added. Null texts count as
        empty, repeated rows each count; no texts give the known ones and no starters."""
        pick = lambda rows, least: tuple(sorted(r.word for r in rows.where(F.col("score") >= least).select("word").collect()))
        learned = pick(abbreviation_scores(texts, text_col), ABBREVIATION_SCORE)
        abbreviations = tuple(sorted({*learned, *(w.lower() for w in known)}))
        return SentenceModel(abbreviations, pick(starter_scores(texts, abbreviations, text_col), STARTER_SCORE))

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows (kind, word); SentenceModel.read takes them back."""
        rows = [("abbreviation", w) for w in self.abbreviations] + [("starter", w) for w in self.starters]
        return spark.createDataFrame(rows, "kind string, word string")

    @staticmethod
    def read(rows: DataFrame) -> "SentenceModel":
        found = {"abbreviation": [], "starter": []}
        for r in rows.collect():
            found[r.kind].append(r.word)
        return SentenceModel(*(tuple(sorted(found[kind])) for kind in ("abbreviation", "starter")))

    def count(self, text) -> Column:
        """Number of sentences. A run of end marks before white space ends one, unless it is
        the full stop of an abbreviation (and no capitalised starter follows) or of
        initials, or an ellipsis that no capital follows."""

        def within(pair):
            kind, after = F.lower(pair["word"]), pair["after"]
            opens = t.matches(after, r"\A\p{Lu}") & F.lower(after).isin(list(self.starters))
            return t.matches(kind, INITIALS) | (kind.isin(list(self.abbreviations)) & ~opens)

        def counted(s):
            pairs = F.arrays_zip(t.find_all(s, _SHORT, 1).alias("word"), t.find_all(s, _SHORT, 2).alias("after"))
            ends = t.count_matches(s, _ENDS) - t.count_matches(s, _RUNNING)
            return F.when(s == "", 0).otherwise(ends - F.size(F.filter(pairs, within)) + 1)

        return t.let(t.strip(text), counted)
