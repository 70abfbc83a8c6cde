"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words (a word is a run of
letters, padded with a space on both sides), with up to four characters of
context. Grams that start a word keep their counts; other lower orders use the
number of distinct left extensions; every order has its own discount and is
interpolated with the next lower one, the lowest with a uniform share for unseen
characters. All grams lie in one sorted array of 64-bit hashes; beside it stand,
per language, the log probability and the log back-off weight.

A text goes to the language with the lowest cross-entropy per character. Held-out
rows of the fit give each language's usual cross-entropy and its spread; a text
far above that is rejected.
"""

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from adherence.llm.common import keyed_texts, schema, written

ORDER = 5
#: Labelled rows per language that the fit reads, in expectation: a bounded sample
#: by a hash of the id. One fifth of them calibrates the rejection.
ROWS_PER_LANGUAGE = 1_000
#: The model has a column per language; more labels than this are an error.
MAX_LANGUAGES = 1_000
#: Standard deviations beyond the usual cross-entropy at which a text is rejected.
REJECT_AT = 8.0
#: Words kept with their scores in a worker.
KEPT_WORDS = 250_000
#: Characters of new words scored at once.
BLOCK = 50_000

WORD = re.compile(r"[^\W\d_]+")
# Odd multipliers of the gram hash, by a rule: powers of one 64-bit constant.
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(ORDER)], np.uint64)
_LENGTHS = np.array([pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j in range(ORDER)], np.uint64)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ (hashes >> np.uint64(29))
    hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def gram_hashes(words: list[str]):
    """For every character after the padding at the start of each word: the hashes of
    the grams of length 1 to ORDER that end there (ORDER columns), how many of them
    exist, and each word's first row. The hash of a shorter gram is a suffix sum."""
    padded = " " + "  ".join(words) + " "
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(first, sizes)
    total = np.zeros(len(codes), np.uint64)
    columns = []
    for back in range(ORDER):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[back:] = codes[: len(codes) - back]
        total = total + np.where(place >= back, (shifted + np.uint64(1)) * _MULTIPLIERS[back], np.uint64(0))
        columns.append(_mixed(total + _LENGTHS[back]))
    return np.stack(columns, axis=1), np.minimum(place + 1, ORDER), place, first


@dataclass
class LanguageModel:
    """keys: sorted gram hashes; logp, backoff: (grams, languages), NaN and 0 where a
    language has not seen a gram; unseen: log probability of an unseen character."""

    languages: list = field(default_factory=list)
    keys: np.ndarray = None
    logp: np.ndarray = None
    backoff: np.ndarray = None
    unseen: np.ndarray = None
    usual: np.ndarray = None
    spread: np.ndarray = None
    short: np.ndarray = None

    @staticmethod
    def from_counts(counts: dict) -> "LanguageModel":
        """counts: language -> {gram of the longest context: count}."""
        languages = sorted(counts)
        alphabet = {c for grams in counts.values() for g in grams for c in g}
        tables = [kneser_ney(counts[lang], len(alphabet) + 1) for lang in languages]
        grams = sorted({g for logp, backoff, _ in tables for g in logp} | {g for _, backoff, _ in tables for g in backoff})
        at = {g: k for k, g in enumerate(grams)}
        logp = np.full((len(grams), len(languages)), np.nan, np.float32)
        backoff = np.zeros((len(grams), len(languages)), np.float32)
        for k, (probabilities, weights, _) in enumerate(tables):
            for g, value in probabilities.items():
                logp[at[g], k] = value
            for g, value in weights.items():
                backoff[at[g], k] = value
        hashes = hash_grams(grams)
        order = np.argsort(hashes)
        return LanguageModel(
            languages, hashes[order], logp[order], backoff[order],
            np.array([unseen for _, _, unseen in tables], np.float32),
            *np.full((3, len(languages)), np.inf),
        )

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, end mark included, per language."""
        hashes, available, place, first = gram_hashes(words)
        found = np.searchsorted(self.keys, hashes)
        found[found == len(self.keys)] = 0
        known = (self.keys[found] == hashes) & (np.arange(ORDER)[None, :] < available[:, None])
        score = np.where(known[:, :1], self.logp[found[:, 0]], np.nan)
        score = np.where(np.isnan(score), self.unseen[None, :], score)
        for length in range(2, ORDER + 1):
            exists = available >= length
            own = np.where(known[:, length - 1: length], self.logp[found[:, length - 1]], np.nan)
            # The context of a gram is the gram that ends one character earlier.
            context = np.roll(found[:, length - 2], 1)
            seen = np.roll(known[:, length - 2], 1)
            lower = score + np.where(seen[:, None], self.backoff[context], 0)
            score = np.where(exists[:, None], np.where(np.isnan(own), lower, own), score)
        score[place == 0] = 0  # the padding before a word is given
        return np.add.reduceat(score, first, axis=0)


def hash_grams(grams: list[str]) -> np.ndarray:
    """The same hash as gram_hashes, for whole grams."""
    out = np.zeros(len(grams), np.uint64)
    for k, gram in enumerate(grams):
        total = int(_LENGTHS[len(gram) - 1])
        for back, c in enumerate(reversed(gram)):
            total += (ord(c) + 1) * int(_MULTIPLIERS[back])
        out[k] = total & 0xFFFFFFFFFFFFFFFF
    return _mixed(out)


def kneser_ney(raw: dict, alphabet: int):
    """Interpolated Kneser-Ney from counts of longest grams. Returns log probabilities
    of seen grams, log back-off weights of seen contexts, and the log probability of
    an unseen character."""
    levels = [dict() for _ in range(ORDER + 1)]
    for gram, count in raw.items():
        levels[len(gram)][gram] = count
    for length in range(ORDER, 1, -1):
        for gram in levels[length]:
            shorter = gram[1:]
            if not (len(shorter) > 1 and shorter[0] == " "):
                levels[length - 1][shorter] = levels[length - 1].get(shorter, 0) + 1
    probability, weight = {}, {}
    unseen = None
    for length in range(1, ORDER + 1):
        level = levels[length]
        ones = sum(1 for c in level.values() if c == 1)
        twos = sum(1 for c in level.values() if c == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        totals, kinds = {}, {}
        for gram, count in level.items():
            totals[gram[:-1]] = totals.get(gram[:-1], 0) + count
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        for context, total in totals.items():
            weight[context] = discount * kinds[context] / total
        if length == 1:
            unseen = weight.get("", 1.0) / alphabet
        for gram, count in level.items():
            context = gram[:-1]
            share = unseen if length == 1 else weight[context] * probability.get(gram[1:], unseen)
            probability[gram] = (count - discount) / totals[context] + share
    weight.pop("", None)
    log = lambda table: {g: float(np.log(v)) for g, v in table.items()}
    return log(probability), log(weight), float(np.log(unseen))


def longest_grams(word: str):
    padded = f" {word} "
    return [padded[max(0, k - ORDER + 1): k + 1] for k in range(1, len(padded))]


def _word_counts(batches):
    """Words of labelled texts, counted per batch before the shuffle."""
    for batch in batches:
        counts = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word in words_of(text):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
            pa.array(list(counts.values()), pa.int64()),
        ], names=["lang", "word", "n"])


def _gram_counts(batches):
    for batch in batches:
        counts = {}
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for gram in longest_grams(word):
                counts[lang, gram] = counts.get((lang, gram), 0) + n
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
            pa.array(list(counts.values()), pa.int64()),
        ], names=["lang", "gram", "n"])


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows=ROWS_PER_LANGUAGE) -> LanguageModel:
    """Models from the labelled rows of docs; rows without label or text do not count.

    Reads about `rows` rows per language, taken by a hash of the id, whole texts. The
    counts are reduced in Spark; the driver gets the grams of that sample."""
    labelled = docs.select(
        docs[lang_col].alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
        (F.pmod(F.xxhash64(docs[id_col], F.lit("language")), F.lit(1 << 40)) / float(1 << 40)).alias("draw"),
    ).where("lang is not null")
    per_language = labelled.groupBy("lang").count()
    if per_language.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # At most MAX_LANGUAGES rows.
    sample = written(
        labelled.join(F.broadcast(per_language), "lang")
        .withColumn("rank", F.col("draw") * F.greatest(F.col("count"), F.lit(rows))).where(F.col("rank") < rows)
        .select("lang", "text", ((F.col("rank") >= 0.8 * rows) & (F.col("count") > 20)).alias("calibrates")),
        "language-sample",
    )
    words = sample.where("not calibrates").select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = {}
    for lang, gram, n in grams.collect():  # bounded by the sample
        counts.setdefault(lang, {})[gram] = n
    if not counts:
        return LanguageModel()
    model = LanguageModel.from_counts(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = F.element_at("entropies", F.col("at") + 1)
    position = F.create_map(*[F.lit(x) for k, lang in enumerate(model.languages) for x in (lang, k)])
    judged = (
        sample.where("calibrates")
        .mapInArrow(_entropies(shared, ["lang"]), "lang string, entropies array<double>, chars long, letters boolean")
        .where("chars > 0").withColumn("at", position[F.col("lang")]).where("at is not null")
        .select("at", "chars", own.alias("e"))
    )
    usual = F.broadcast(judged.groupBy("at").agg(F.avg("e").alias("usual")))
    rows_of = judged.join(usual, "at").groupBy("at").agg(
        F.first("usual").alias("usual"), F.sqrt(F.avg((F.col("e") - F.col("usual")) ** 2)).alias("spread"),
        F.sqrt(F.avg((F.col("e") - F.col("usual")) ** 2 * F.col("chars"))).alias("short")).collect()
    for r in rows_of:  # a row per language
        model.usual[r["at"]], model.spread[r["at"]], model.short[r["at"]] = r["usual"], r["spread"], r["short"]
    shared.unpersist()
    return model


_SCORED = []


class _Words(dict):
    """word -> row of its scores in a growing matrix."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def learn(self, words):
        new = list(words)
        blocks, block, size = [], [], 0
        for word in new:
            block.append(word)
            size += len(word) + 2
            if size >= BLOCK:
                blocks.append(self.model.score_words(block))
                block, size = [], 0
        if block:
            blocks.append(self.model.score_words(block))
        base = len(self)
        for k, word in enumerate(new):
            self[word] = base + k
        self.scores = np.concatenate([self.scores, *[b.astype(np.float32) for b in blocks]])


def _entropies(shared, keep):
    """Cross-entropy per character (word ends included) in every language."""

    def run(batches):
        model = shared.value
        if not _SCORED or _SCORED[0].model is not model:
            _SCORED[:] = [_Words(model)]
        table = _SCORED[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                entropies, chars, letters = [], [], []
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                new = set().union(*texts).difference(table) if model.languages else ()
                if len(table) + len(new) > KEPT_WORDS:
                    table.clear()
                    table.scores = table.scores[:0]
                    new = set().union(*texts)
                if new:
                    table.learn(sorted(new))
                for words in texts:
                    n = sum(map(len, words)) + len(words)
                    total = np.zeros(len(model.languages))
                    if words and model.languages:
                        rows = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
                        total = table.scores[rows].sum(axis=0, dtype=np.float64)
                    entropies.append((-total / max(n, 1)).tolist())
                    chars.append(n)
                    letters.append(any(c.isalpha() for w in words for c in w))
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in keep], pa.array(entropies, pa.list_(pa.float64())),
                    pa.array(chars, pa.int64()), pa.array(letters, pa.bool_()),
                ], names=[*keep, "entropies", "chars", "letters"])

    return run


def decide(model: LanguageModel, entropies: list, chars: int, letters: bool):
    """(language, score, rejected) of one text."""
    if not letters or not model.languages:
        return "und", 0.0, not letters
    values = np.array(entropies)
    best = int(values.argmin())
    share = np.exp((values[best] - values) * min(chars, 40))
    limit = model.usual[best] + REJECT_AT * (model.spread[best] + model.short[best] / np.sqrt(chars))
    return model.languages[best], float(1 / share.sum()), bool(values[best] > limit)


def identify_column(model: LanguageModel, spark, text):
    """A text column's struct (lang_pred, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)
    kind = "struct<lang_pred:string,score:double,rejected:boolean>"

    @F.arrow_udf(kind)
    def judge(texts: pa.Array) -> pa.Array:
        known = shared.value
        scored = _entropies(shared, [])(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))
        rows = []
        for part in scored:
            for e, n, letters in zip(*(part.column(c).to_pylist() for c in ("entropies", "chars", "letters"))):
                rows.append(dict(zip(("lang_pred", "score", "rejected"), decide(known, e, n, letters))))
        return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    return judge(F.coalesce(text, F.lit("")))


def identify(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected.

    `und`, score 0 and rejected for texts without a letter (null and empty texts
    too); every other text gets a learned language, rejected or not. A model without
    languages (nothing labelled) says `und`, score 0, and rejects only texts without
    a letter. Repeated rows each get a row; other columns are not read."""
    base = keyed_texts(docs, id_col, text_col)
    judged = base.select("doc_id", identify_column(model, docs.sparkSession, base.text).alias("judged"))
    return judged.select("doc_id", "judged.lang_pred", "judged.score", "judged.rejected")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col="text") -> DataFrame:
    """The rows of docs that are not rejected, all columns as they came."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    judged = row.withColumn("judged", identify_column(model, docs.sparkSession, F.col("row")[text_col]))
    return judged.where("not judged.rejected").select("row.*")
