"""A quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that cover the whole
text. Each filter is max-pooled over a chunk; a text's features are the largest and
the mean of its chunks' values, and a logistic layer makes them one probability.
A filter is a table per tap, indexed by the byte, so a convolution is a few table
look-ups and sums.

The fit runs on a bounded sample of labelled rows (about ROWS of them, fewer where their
texts are long: about BYTES), each learned from as a whole; scoring runs in Spark tasks
over every chunk of every text, in blocks of bounded size.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adherence.llm.common import keyed_texts, written

TAPS = 6
FILTERS = 16
CHUNK = 512
OVERLAP = 64
#: Labelled rows that the fit reads, in expectation, by a hash of the id; and bytes of their texts.
ROWS = 4_000
BYTES = 24_000_000
EPOCHS = 14
BATCH = 64
RATE = 0.01
#: Chunks convolved at once.
BLOCK = 32

_FILLER = 256  # stands after the end of a text; no filter fires across it


def chunks_of(text: str) -> np.ndarray:
    """The text's UTF-8 bytes as overlapping chunks (n, CHUNK), filled up at the end."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").ljust(TAPS), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    filled = np.full((n - 1) * step + CHUNK, _FILLER, np.uint16)
    filled[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(filled, CHUNK)[::step]


@dataclass
class QualityModel:
    taps: np.ndarray  # (TAPS, 257, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float
    _pairs: list = None

    def pairs(self):
        """Tables of two neighbouring taps, by two bytes, for scoring."""
        if self._pairs is None:
            self._pairs = [
                (self.taps[k][:, None, :] + self.taps[k + 1][None, :, :]).reshape(257 * 257, FILTERS)
                for k in range(0, TAPS, 2)]
        return self._pairs

    def pooled(self, chunks: np.ndarray, where=False):
        """Max-pooled filter values (n, FILTERS), and with `where` their places."""
        values, places = [], []
        width = CHUNK - TAPS + 1
        tables, step = (self.taps, 1) if where else (self.pairs(), 2)
        for at in range(0, len(chunks), BLOCK):
            block = chunks[at: at + BLOCK].astype(np.intp)
            if not where:
                block = block[:, :-1] * 257 + block[:, 1:]
            total = tables[0][block[:, :width]]
            for k in range(1, len(tables)):
                total += tables[k][block[:, step * k: step * k + width]]
            values.append(total.max(axis=1))
            if where:
                places.append(total.argmax(axis=1))
        values = np.maximum(np.concatenate(values) + self.bias, 0)
        return (values, np.concatenate(places)) if where else values

    def score(self, text: str) -> float:
        chunks = chunks_of(text)
        largest, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for at in range(0, len(chunks), 64 * BLOCK):
            values = self.pooled(chunks[at: at + 64 * BLOCK])
            largest, total = np.maximum(largest, values.max(axis=0)), total + values.sum(axis=0)
        return self.probability(largest, total / len(chunks))

    def probability(self, largest, mean) -> float:
        return float(1 / (1 + np.exp(-(np.concatenate([largest, mean]) @ self.weights + self.offset))))


def start_model(rng) -> QualityModel:
    taps = rng.normal(0, 0.3, (TAPS, 257, FILTERS)).astype(np.float32)
    taps[:, _FILLER] = -1e4
    return QualityModel(
        taps, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)


def train(texts: list[np.ndarray], labels: np.ndarray, epochs=EPOCHS, seed=7) -> QualityModel:
    """texts: chunks (n, CHUNK) of each text; labels: 0 or 1. Adam on the log loss; the
    gradient of a max goes to its place."""
    rng = np.random.default_rng(seed)
    model = start_model(rng)
    share = labels.mean()
    model.offset = float(np.log((share + 0.01) / (1.01 - share)))
    if share in (0, 1):
        model.weights[:] = 0
        return model
    parameters = [model.taps, model.bias, model.weights]
    first = [np.zeros_like(p) for p in parameters] + [0.0]
    second = [np.zeros_like(p) for p in parameters] + [0.0]
    step, total_steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at: at + BATCH]
            counts = np.array([len(texts[r]) for r in rows])
            chunks = np.concatenate([texts[r] for r in rows])
            values, places = model.pooled(chunks, where=True)
            starts = np.cumsum(counts) - counts
            largest = np.maximum.reduceat(values, starts, axis=0)
            mean = np.add.reduceat(values, starts, axis=0) / counts[:, None]
            features = np.concatenate([largest, mean], axis=1)
            odds = 1 / (1 + np.exp(-(features @ model.weights + model.offset)))
            error = (odds - labels[rows]) / len(rows)
            by_feature = error[:, None] * model.weights[None, :]
            owner = np.repeat(np.arange(len(rows)), counts)
            # Of equal maxima the gradient is shared by all chunks that reach it.
            by_chunk = by_feature[owner, FILTERS:] / counts[owner, None] + by_feature[owner, :FILTERS] * (values == largest[owner])
            by_chunk = np.where(values > 0, by_chunk, 0)
            taps = np.zeros_like(model.taps)
            rows_at, filters = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
            for k in range(TAPS):
                np.add.at(taps[k], (chunks[rows_at, places + k], filters), by_chunk)
            taps[:, _FILLER] = 0
            gradients = [taps, by_chunk.sum(axis=0), features.T @ error + 1e-4 * model.weights, error.sum()]
            step += 1
            rate = RATE * (1 - 0.9 * step / total_steps)
            for n, g in enumerate(gradients):
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                change = rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
                if n < 3:
                    parameters[n] -= change.astype(np.float32)
                else:
                    model.offset -= float(change)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col="quality", id_col="doc_id", text_col="text",
        rows=ROWS, size=BYTES, epochs=EPOCHS) -> QualityModel:
    """A model from the rows of docs that labels (id_col, label_col) names. Null labels
    do not count, an id labelled more than once has the mean of its labels, rounded.
    About `rows` labelled rows are read, by a hash of the id, and fewer where their texts
    have more than `size` bytes together; their texts are read whole. Without labels the
    model says one half of everything."""
    known = (
        labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("label is not null and id is not null")
        .groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    )
    known = written(known, "quality-known")
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    share = min(1.0, rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 40)) / float(1 << 40)
    # About `rows` rows of two numbers.
    chosen = written(known.where(draw < share), "quality-labels")
    labelled = written(texts.join(F.broadcast(chosen), "id").select("id", "label", "text"), "quality-texts")
    bytes_ = labelled.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = labelled.where(draw < share * min(1.0, size / max(1, bytes_))).select("label", "text").collect()
    if not found:
        model = start_model(np.random.default_rng(0))
        model.weights[:] = 0
        return model
    found.sort(key=lambda r: (r.label, r.text))  # the same fit whatever the order of tasks
    return train([chunks_of(r.text) for r in found], np.array([r.label for r in found], np.float64), epochs)


def score_column(model: QualityModel, spark, text):
    """The probability of label 1 for a text column; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        known = shared.value
        return pa.array([known.score(t.as_py()) for t in texts], pa.float64())

    return scores(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, model: QualityModel, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, score, predicted (1 from one half on).

    Whole texts; null, empty and very short texts are filled up with spaces to the
    width of a filter and scored like any other. Repeated rows each get a row, other
    columns are not read, an empty table gives no rows."""
    base = keyed_texts(docs, id_col, text_col)
    scored = base.select("doc_id", score_column(model, docs.sparkSession, base.text).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
