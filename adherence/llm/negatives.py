"""Hard negatives of anchors by exact integer inner products.

Components become whole numbers (floor of SCALE times the value). A tile of anchors times a
tile of candidates is one matrix product, taken by Strassen's recursion: odd sides get a
row or column of zeros, seven products of half the size replace eight, and all sums are
exact 64-bit integers. An anchor's positives are the best rows of its label; a negative's
score lies within a window of the positive's score. Both are kept as bounded heaps per
task, which are merged by anchor.

The candidates are read where they lie and never shuffled. The anchors are the stated
query set: they go to the tasks in groups of at most GROUP_BYTES, one after another, each
against all candidates. What a group sends to the driver and back is bounded by its size.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from adherence.llm.common import schema, scratch_folder, written

SCALE = 256
POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 5, 10, 30, 90
#: Sides up to this length are multiplied directly.
CUT = 32
#: Rows of a tile of anchors and of candidates, and bytes of the anchors handed out at once.
ANCHOR_ROWS, CANDIDATE_ROWS, GROUP_BYTES = 512, 2_048, 16 << 20

_NONE = np.iinfo(np.int64).min + 1  # no score is as low


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact product; in floating point where every sum is a whole number below 2^53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, exact where every entry fits 64 bits (sums inside
    may wrap around and come back)."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= CUT:
        return _direct(a, b)
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    p, q, r = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * p, 2 * r), np.int64)
    out[:p, :r], out[:p, r:] = m1 + m4 - m5 + m7, m3 + m5
    out[p:, :r], out[p:, r:] = m2 + m4, m1 - m2 + m3 + m6
    return out[:m, :n]


class Heaps:
    """The best k (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.scores = np.full((slots, k), _NONE, np.int64)
        self.ids = np.zeros((slots, k), np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores, allowed: (slots, candidates); ids of the candidates, in ascending order."""
        k, n = self.scores.shape[1], scores.shape[1]
        last = self.scores[slots, -1][:, None]
        allowed = allowed & (scores >= last)
        some = np.flatnonzero(allowed.any(axis=1))
        if not len(some):
            return
        slots, scores = slots[some], np.where(allowed[some], scores[some], _NONE)
        if n > k:
            if np.abs(scores[scores != _NONE]).max(initial=0) < 2 ** 61 // n:
                # Score and place as one number, so that the k largest are the right ones.
                key = np.where(scores == _NONE, _NONE, scores * n + np.arange(n - 1, -1, -1))
                best = np.argpartition(key, n - k, axis=1)[:, n - k:]
            else:
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores, ids = np.take_along_axis(scores, best, axis=1), ids[best]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        scores = np.concatenate([self.scores[slots], scores], axis=1)
        ids = np.concatenate([self.ids[slots], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.scores[slots] = np.take_along_axis(scores, order, axis=1)
        self.ids[slots] = np.take_along_axis(ids, order, axis=1)

    def kept(self):
        """(slot, score, id) arrays."""
        slot, place = np.nonzero(self.scores != _NONE)
        return slot, self.scores[slot, place], self.ids[slot, place]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The rows as whole numbers; shorter ones are filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(SCALE * flat)
    if np.abs(whole).max(initial=0) >= 2.0 ** 62:
        raise OverflowError("components are too large for exact 64-bit scores")
    length = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = whole.astype(np.int64)
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


class AnchorGroup:
    """Anchors with their vectors; with their positives once these are known."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.number, self.ids = (rows.column(c).to_numpy() for c in ("number", "id"))
        self.label_codes = {}
        labels = rows.column("label").to_pylist()
        self.labels = np.array([self.label_codes.setdefault(x, len(self.label_codes)) for x in labels], np.int64)
        vectors = rows.column("vector")
        self.vectors = _matrix(vectors.chunk(0)) if vectors.num_chunks else np.zeros((0, 0), np.int64)

    def tiles(self, batches):
        """Scores of tiles: (anchors' slice, candidates' ids in ascending order, same label, scores)."""
        for block in _blocks(batches):
            order = np.argsort(block["id"], kind="stable")
            ids, candidates = block["id"][order], block["vector"][order]
            labels = np.array([self.label_codes.get(block["label"][k], -1) for k in order], np.int64)
            width = max(candidates.shape[1], self.vectors.shape[1])
            largest = [float(np.abs(x).max(initial=0)) for x in (candidates, self.vectors)]
            if largest[0] * largest[1] * width >= 2.0 ** 63:
                raise OverflowError("components are too large for exact 64-bit scores")
            turned = np.ascontiguousarray(_widened(candidates, width).T)
            for low in range(0, len(self.ids), ANCHOR_ROWS):
                part = slice(low, min(low + ANCHOR_ROWS, len(self.ids)))
                scores = strassen(_widened(self.vectors[part], width), turned)
                yield part, ids, labels == self.labels[part, None], scores

    def positives(self, batches, k):
        heaps = Heaps(len(self.ids), k)
        for part, ids, same, scores in self.tiles(batches):
            heaps.offer(np.arange(part.start, part.stop), scores, same & (ids != self.ids[part, None]), ids)
        slot, scores, ids = heaps.kept()
        yield _batch(number=slot, score=scores, id=ids)

    def with_positives(self, rows: pa.Table, k: int) -> None:
        """rows: number (place in this group), rank from 1, score, id."""
        self.positive_scores, self.positive_ids = np.full((len(self.ids), k), _NONE, np.int64), np.zeros((len(self.ids), k), np.int64)
        place = rows.column("number").to_numpy(), rows.column("rank").to_numpy() - 1
        self.positive_scores[place], self.positive_ids[place] = (rows.column(c).to_numpy() for c in ("score", "id"))

    def negatives(self, batches, k, low, high):
        n = self.positive_scores.shape[1]
        heaps = Heaps(len(self.ids) * n, k)
        known = self.positive_scores != _NONE
        # low% <= score <= high% of the positive's score, in whole numbers.
        bounds = [[(-(-low * int(p) // 100), high * int(p) // 100) for p in row] for row in self.positive_scores]
        bounds = np.array(bounds, np.int64).reshape(len(self.ids), n, 2)
        for part, ids, same, scores in self.tiles(batches):
            for slot in range(n):
                at = np.arange(part.start, part.stop)
                inside = (scores >= bounds[part, slot, 0, None]) & (scores <= bounds[part, slot, 1, None])
                heaps.offer(at * n + slot, scores, inside & ~same & known[part, slot, None], ids)
        slot, scores, ids = heaps.kept()
        anchor, place = slot // n, slot % n
        yield _batch(number=self.number[anchor], slot=place, anchor_id=self.ids[anchor], positive_id=self.positive_ids[anchor, place],
                     positive_score=self.positive_scores[anchor, place], score=scores, id=ids)


def _batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def _longs(*names):
    return schema(**{name: T.LongType() for name in names})


def _blocks(batches):
    """Arrow batches as blocks of at most CANDIDATE_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_ROWS):
            part = batch.slice(at, CANDIDATE_ROWS)
            yield {"id": np.asarray(part.column("id")), "label": part.column("label").to_pylist(), "vector": _matrix(part.column("vector"))}


def _prepared(vectors: DataFrame, id_col, vector_col, label_col) -> DataFrame:
    """id, label, vector of the rows that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _first(rows: DataFrame, keys: list, k: int) -> DataFrame:
    """The best k rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor, id_col="vec_id", vector_col="embedding", label_col="label",
                   positives=POSITIVES, negatives=NEGATIVES, low=LOW_PERCENT, high=HIGH_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor(id column) says which rows are anchors. Ids are whole numbers. Rows with a null
    id, label or vector, or a null or non-finite component take no part; vectors of different
    lengths are filled up with zeros. A row with the anchor's id is not another row; any
    other repeated rows count each, and a repeated anchor gives its rows again. Anchors
    without positives and positives without negatives give no rows, nor does an empty table.
    Components so large that a score might exceed 64 bits are an error."""
    spark = vectors.sparkSession
    rows = _prepared(vectors, id_col, vector_col, label_col)
    anchors = written(rows.where(is_anchor(F.col("id"))).withColumn("number", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    groups = -(-size.n * 8 * max(1, size.width or 0) // GROUP_BYTES)
    folder, paths = f"{scratch_folder(spark)}/negatives-{uuid.uuid4().hex}", []
    out = _longs("number", "slot", "anchor_id", "positive_id", "positive_score", "score", "id")
    # Numbers count from 0 within each partition that wrote anchors, so a remainder makes even groups.
    place = F.col("number").bitwiseAND((1 << 33) - 1)
    for g in range(groups):
        paths.append(f"{folder}/{g}")
        _write_group(rows, anchors.where(place % groups == g), positives, negatives, low, high, out, paths[-1])
    return spark.read.schema(_result_schema()).parquet(*paths) if paths else spark.createDataFrame([], _result_schema())


def _result_schema():
    kinds = {"rank": T.IntegerType()}
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return schema(**{name: kinds.get(name, T.LongType()) for name in names})


def _write_group(rows, anchors, positives, negatives, low, high, out, path):
    """One group of anchors against all rows: positives first, then the windows they set.
    What the tasks were given goes when the group's rows are written."""
    context = rows.sparkSession.sparkContext
    group = AnchorGroup(anchors.toArrow())
    sent = context.broadcast(group)
    near = rows.mapInArrow(lambda batches: sent.value.positives(batches, positives), _longs("number", "score", "id"))
    group.with_positives(_first(near, ["number"], positives).select("number", "rank", "score", "id").toArrow(), positives)
    again = context.broadcast(group)
    found = rows.mapInArrow(lambda batches: again.value.negatives(batches, negatives, low, high), out)
    _first(found, ["number", "slot"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")).write.parquet(path)
    sent.unpersist()
    again.unpersist()


def every_hundredth(key: Column) -> Column:
    return key % 100 == 0
