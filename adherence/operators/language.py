"""Language identification: a naive Bayes model over character trigrams.

Training counts the trigrams of all labelled texts with one aggregation, and keeps every
one. Applying the model is row-local, so nothing is shuffled; rows without a text to judge
pass null. Trigrams are counted and weighed as numbers (functions/trigrams.py). The model
is bounded by distinct trigrams x number of languages, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import CountVectorizerModel, StringIndexerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adherence.functions import language_samples, trigrams

_DEFAULT = {}

# Addresses say nothing about the language around them.
ADDRESS = r"https?://[-_.?&~;+=/#0-9A-Za-z]+|[-_.0-9A-Za-z]+@[-_0-9A-Za-z]+[-_.0-9A-Za-z]+"
# A model has a number per language and trigram; more labels than this are an error.
MAX_LANGUAGES = 1_000


def clean(text) -> Column:
    """Lower case, without addresses; a text that holds none of their marks is not searched."""
    marked = F.contains(text, F.lit("@")) | F.contains(text, F.lit("://"))
    return F.lower(F.when(marked, F.regexp_replace(text, ADDRESS, " ")).otherwise(text))


def _judge(grams, weights, prior):
    """A function of cleaned texts: the place of their language."""

    @F.pandas_udf("int")
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in trigrams.best_classes(texts, grams, weights, prior):
            yield pd.Series(found, dtype="Int32")

    return best


class LanguageModel:
    def __init__(self, labels: StringIndexerModel, terms: CountVectorizerModel, bayes: NaiveBayesModel):
        self.labels, self.terms, self.bayes, self._judge = labels, terms, bayes, None

    @classmethod
    def fit(cls, labelled: DataFrame, text="text", label="lang") -> "LanguageModel":
        rows = labelled.select(F.col(label).alias("_label"), F.col(text).alias("_text")).where(
            F.col("_label").isNotNull()
        )
        texts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().limit(MAX_LANGUAGES + 1).collect()}
        if len(texts) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        names = sorted(texts)
        # counted per task before the shuffle
        grams = rows.select("_label", clean(F.col("_text")).alias("_text")).mapInArrow(
            trigrams.counts_by_label, "_label string, _gram long, _n long")
        counts = grams.groupBy("_gram", "_label").agg(F.sum("_n").alias("count")).toArrow()

        # from here on: trigrams x languages numbers
        gram, labels = counts["_gram"].to_numpy(), counts["_label"].combine_chunks().dictionary_encode()
        found = np.unique(gram)
        vocabulary = [trigrams.string(int(g)) for g in found]
        row = np.array([names.index(n) for n in labels.dictionary.to_pylist()], np.int64)[labels.indices.to_numpy()]
        means = np.zeros((len(names), len(found)))
        means[row, np.searchsorted(found, gram)] = counts["count"].to_numpy()
        sums = [(float(y), float(texts[n]), Vectors.dense(means[y] / texts[n])) for y, n in enumerate(names)]
        spark = labelled.sparkSession
        bayes = NaiveBayes(
            featuresCol="_counts", labelCol="_y", predictionCol="_best", weightCol="_texts",
            rawPredictionCol="_scores", probabilityCol="_shares",
        ).fit(spark.createDataFrame(sums, ["_y", "_texts", "_counts"]))
        return cls(
            StringIndexerModel.from_labels(names, inputCol="_label", outputCol="_y"),
            CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_grams", outputCol="_counts"),
            bayes,
        )

    @classmethod
    def default(cls, spark: SparkSession) -> "LanguageModel":
        """A model of the languages a check may ask for, fitted once per session on a little
        text of each (functions/language_samples.py). It tells scripts apart, and languages of
        one script in texts of a few sentences; a model of the caller's own is better."""
        key = spark.sparkContext.applicationId
        if key not in _DEFAULT:
            _DEFAULT[key] = cls.fit(spark.createDataFrame(language_samples.rows(), "lang string, text string").coalesce(1))
        return _DEFAULT[key]

    @property
    def names(self) -> list:
        """The languages the model knows."""
        return list(self.labels.labels)

    def detect(self, rows: DataFrame, text: Column, out="detected") -> DataFrame:
        """Add the language of `text`; null where the text shows none."""
        if self._judge is None:
            numbers = np.array([int(trigrams.numbers(g)[0]) for g in self.terms.vocabulary], np.int64)
            order = np.argsort(numbers)
            weights = np.ascontiguousarray(self.bayes.theta.toArray()[:, order])
            self._judge = _judge(numbers[order], weights, self.bayes.pi.toArray())
        lettered = F.when(F.rlike("_clean", F.lit(r"\p{L}")), F.col("_clean"))
        judged = rows.withColumn("_clean", clean(text)).withColumn("_best", self._judge(lettered))
        names = F.array(*[F.lit(x) for x in self.labels.labels])
        return judged.withColumn(out, F.get(names, F.col("_best"))).drop("_clean", "_best")

    def save(self, folder):
        for name in ("labels", "terms", "bayes"):
            getattr(self, name).write().overwrite().save(f"{folder}/{name}")

    @classmethod
    def load(cls, folder) -> "LanguageModel":
        return cls(
            StringIndexerModel.load(f"{folder}/labels"),
            CountVectorizerModel.load(f"{folder}/terms"),
            NaiveBayesModel.load(f"{folder}/bayes"),
        )
