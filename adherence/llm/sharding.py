"""Sharding by a minimax contiguous partition.

Documents with equal texts are one atomic group; groups are ordered by their bytes,
largest first (so that a large group does not leave a small rest before it), then by
their smallest id. The smallest capacity is sought, by binary search with a greedy check,
for which the ordered groups fit into the given number of contiguous shards; then
the sequence is cut at that capacity, each cut as close to an even share of what is
left as the capacity allows.

Running sums are made in range partitions of the order; only a partition's totals
go to the driver. The search needs the places where a group may begin, which are as
many as there are texts: the driver holds a bounded selection of them, and bounds
the answer from both sides (only the known places; all places inside stretches not
yet known). While the bounds differ, the stretches a cut may fall into are read
again in finer pieces.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from adherence.llm.common import written

#: Pieces that one look at the places asks for.
PIECES = 20_000


class Places:
    """What the driver knows of the places where a group begins: sorted places, and
    stretches (between two known places) that hold further ones."""

    def __init__(self, total: int):
        self.total = total
        self.known = np.array([0, total], np.int64)
        self.set_open([(0, total)])

    def set_open(self, stretches):
        self.open = sorted(stretches)
        self.lows = np.array([s[0] for s in self.open], np.int64)

    def add(self, rows, stretches):
        """rows: (stretch, first, last, count) of the pieces of each stretch."""
        new = [p for _, first, last, _ in rows for p in (first, last)]
        self.known = np.unique(np.concatenate([self.known, np.array(new, np.int64)]))
        self.set_open([s for s in self.open if s not in stretches]
                      + [(first, last) for _, first, last, count in rows if count > 2])

    def floor(self, at: int, all_open: bool) -> int:
        """The last place up to `at`; with all_open every byte of an open stretch is one."""
        if all_open:
            k = np.searchsorted(self.lows, at, "right") - 1
            if k >= 0 and at < self.open[k][1]:
                return at
        return int(self.known[np.searchsorted(self.known, at, "right") - 1])

    def cuts(self, capacity: int, shards: int, all_open: bool) -> list[int]:
        """Greedy ends of the shards."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.floor(min(at + capacity, self.total), all_open)
            ends.append(at)
        return ends

    def capacity(self, shards: int, all_open: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, all_open)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low


def even_cuts(known: np.ndarray, total: int, capacity: int, shards: int) -> list[int]:
    """Starts of shards 1 and on: known places, no shard over the capacity, each as
    near to an even share of the rest as that allows."""
    latest = [total] * (shards + 1)  # the first place from which shards - k shards reach the end
    for k in range(shards - 1, -1, -1):
        latest[k] = int(known[np.searchsorted(known, latest[k + 1] - capacity, "left")]) if latest[k + 1] > capacity else 0
    starts, at = [], 0
    for k in range(1, shards):
        target = at + (total - at) // (shards - k + 1)
        low = np.searchsorted(known, max(latest[k], at), "left")
        high = np.searchsorted(known, min(at + capacity, total), "right") - 1
        near = np.searchsorted(known, target, "left")
        best = min((min(max(n, low), high) for n in (near, near - 1)), key=lambda n: abs(int(known[n]) - target))
        at = int(known[best])
        starts.append(at)
    return starts


def _running(id_type):
    out = pa.schema([
        ("part", pa.int32()), ("doc_id", id_type), ("size", pa.int64()), ("crc", pa.int64()),
        ("at_row", pa.int64()), ("at_byte", pa.int64()), ("begins", pa.bool_()), ("edge", pa.binary()),
    ])

    def run(batches):
        """Row and byte offsets within the partition; `begins` marks the first row of a
        group, `edge` the digest of the partition's first row and, by itself, its last."""
        part, rows, size, before = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            digests = batch.column("digest").to_pylist()
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            sums = np.cumsum(sizes)
            begins = [a != b for a, b in zip(digests, [before, *digests[:-1]])]
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * n, pa.int32()), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                batch.column("crc"), pa.array(np.arange(rows, rows + n)), pa.array(size + sums - sizes),
                pa.array(begins), pa.array([d if rows + k == 0 else None for k, d in enumerate(digests)], pa.binary()),
            ], schema=out)
            before, rows, size = digests[-1], rows + n, size + int(sums[-1])
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.nulls(1, id_type), pa.array([size], pa.int64()), pa.array([0], pa.int64()),
                pa.array([rows], pa.int64()), pa.array([-1], pa.int64()), pa.array([False]), pa.array([before], pa.binary()),
            ], schema=out)

    return run


def placed_rows(docs: DataFrame, id_col: str, text_col: str):
    """(rows with part, doc_id, size, crc, at_row, at_byte, begins; part totals)."""
    from pyspark.sql.pandas.types import to_arrow_type

    text = F.coalesce(docs[text_col], F.lit(""))
    base = written(docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("digest")), "shard-rows")
    first = written(base.groupBy("digest").agg(F.sum("size").alias("total"), F.min("doc_id").alias("first")), "shard-groups")
    order = [F.col("total").desc(), "first", "digest", "doc_id"]
    dealt = base.join(first, "digest").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType
    out = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("size", T.LongType()),
        T.StructField("crc", T.LongType()), T.StructField("at_row", T.LongType()), T.StructField("at_byte", T.LongType()),
        T.StructField("begins", T.BooleanType()), T.StructField("edge", T.BinaryType()),
    ])
    rows = written(dealt.mapInArrow(_running(to_arrow_type(kind)), out), "shard-order")
    # Two short rows per partition.
    edges = rows.where("edge is not null").orderBy("part", F.col("at_byte") < 0).collect()
    totals, row, byte, before = [], 0, 0, None
    for head, tail in zip(edges[::2], edges[1::2]):
        totals.append((head["part"], row, byte, head["edge"] == before))
        row, byte, before = row + tail["at_row"], byte + tail["size"], tail["edge"]
    return rows.where("at_byte >= 0").drop("edge"), totals, byte


def shard_documents(docs: DataFrame, shards=16, id_col="doc_id", text_col="text", pieces=PIECES) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot
    (gapless from 0 in its shard, in the order of the groups and ids).

    Null and empty texts are one group of size 1 a row. Equal texts share a shard, so a
    group larger than an even share sets the capacity, and shards may stay empty where
    there are fewer groups than shards. Rows that repeat an id are rows like any other;
    null ids come first in a group. Other columns are not read; an empty table gives no
    rows."""
    spark = docs.sparkSession
    rows, totals, total = placed_rows(docs, id_col, text_col)
    offsets = spark.createDataFrame(
        totals, "part int, rows_before long, bytes_before long, goes_on boolean")
    # A row per partition.
    rows = rows.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "crc",
        (F.col("rows_before") + F.col("at_row")).alias("row"),
        (F.col("bytes_before") + F.col("at_byte")).alias("byte"),
        (F.col("begins") & ~(F.col("goes_on") & (F.col("at_row") == 0))).alias("begins"),
    )
    starts = cut_places(rows.where("begins").select("byte"), total, shards, pieces) if total else []
    # A group begins at a cut, and all its rows follow: the last group begun decides, and it began at or before the row.
    counts = rows.agg(*[F.count_if(F.col("byte") < s).alias(f"s{k}") for k, s in enumerate(starts)]).first() if starts else []
    marks = F.array(*[F.struct(F.lit(s).cast("long").alias("byte"), F.lit(c).cast("long").alias("row")) for s, c in
                      zip([0, *starts], [0, *counts])])
    reached = F.filter(marks, lambda m: m["byte"] <= F.col("byte"))
    return rows.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), (F.size(reached) - 1).alias("shard"),
        (F.col("row") - F.array_max(F.transform(reached, lambda m: m["row"]))).alias("slot"),
    )


def cut_places(begins: DataFrame, total: int, shards: int, pieces: int) -> list[int]:
    """Starts of shards 1 and on. begins: a long column `byte`, where groups begin."""
    places = Places(total)
    stretches = list(places.open)
    while True:
        width = max(2, pieces // len(stretches))
        bounds = [(low, high, max(1, -(-(high - low) // width))) for low, high in stretches]
        lows, highs, steps = (F.array(*[F.lit(x).cast("long") for x in column]) for column in zip(*bounds))
        stretch = F.size(F.filter(lows, lambda low: low <= F.col("byte"))) - 1
        piece = F.floor((F.col("byte") - F.get(lows, F.col("stretch"))) / F.get(steps, F.col("stretch")))
        found = (
            begins.select("byte", stretch.alias("stretch"))
            .where((F.col("stretch") >= 0) & (F.col("byte") < F.get(highs, F.col("stretch"))))
            .groupBy("stretch", piece.alias("piece"))
            .agg(F.min("byte").alias("first"), F.max("byte").alias("last"), F.count("*").alias("n")).collect()
        )
        places.add([(r["stretch"], r["first"], r["last"], r["n"]) for r in found], set(stretches))
        best, least = places.capacity(shards, False), places.capacity(shards, True)
        if best == least:
            return even_cuts(places.known, total, best, shards)
        low_cuts, high_cuts = places.cuts(least, shards, False), places.cuts(best, shards, True)
        stretches = [s for s in places.open if any(s[0] <= high and low <= s[1] for low, high in zip(low_cuts, high_cuts))]
