"""Exact dedup by content sort.

Sampled splitters deal the rows out by the bytes of the normalised text, each
partition is sorted (Spark spills the sort to disk), equal texts end up next to
each other, and full comparisons of neighbours find the runs of equal texts.

The sort key is (leading characters, SHA-256 of the normalised text, more code
points first, smaller id first). Splitters are therefore short whatever the
texts' length, the first row of a run is the one that stays, and a group that
holds a third of all rows is spread over as many partitions as its size needs:
only its pieces at partition edges have to be stitched, by comparing the last
text of a partition with the first of the next one. Texts are shuffled once.
"""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from adherence.llm.common import WHITE_SPACE, written

#: Leading characters of a text in the sort key; the rest of the order is the digest's.
LEADING = 32
#: Rows per Arrow batch that a task hands back.
ROWS_OUT = 8192


def normalised(text):
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sorted_by_content(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Rows (doc_id, norm, digest[, row]) in content order: range partitions in
    order, each sorted. carry keeps the whole input row as a struct."""
    text = docs[text_col]
    norm = normalised(text)
    kept = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else [norm.alias("norm")]
    keyed = docs.select(
        docs[id_col].alias("doc_id"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("points"),
        F.substring(norm, 1, LEADING).alias("leading"),
        F.sha2(norm, 256).alias("digest"),
        *kept,
    )
    order = [F.col("leading"), F.col("digest"), F.col("points").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    if carry:
        return dealt.select("doc_id", normalised(F.col("row")[text_col]).alias("norm"), "digest", "row")
    return dealt.select("doc_id", "norm", "digest")


def new_run_flags(texts: pa.Array, before) -> list:
    """True where a text differs from the one before it; `before` is the text that
    precedes the batch, or None at the start of a partition."""
    first = before is None or texts[0].as_py() != before
    if len(texts) == 1:
        return [first]
    return [first, *pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist()]


def classify_runs(id_type: pa.DataType):
    out = pa.schema([
        ("part", pa.int32()), ("doc_id", id_type), ("digest", pa.string()), ("keep_id", id_type),
        ("run_size", pa.int64()), ("head", pa.bool_()), ("first_run", pa.bool_()), ("last_run", pa.bool_()),
        ("first_row", pa.bool_()), ("last_row", pa.bool_()), ("edge_text", pa.string()),
    ])

    def run(batches):
        """Holds ids (not texts) of one partition; a run's size is known at its end."""
        part = TaskContext.get().partitionId()
        ids, heads, digests, first_text, last_text = [], [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("norm")
            flags = new_run_flags(texts, last_text)
            if first_text is None:
                first_text = texts[0].as_py()
            last_text = texts[-1].as_py()
            base = sum(len(x) for x in ids)
            starts = [k for k, flag in enumerate(flags) if flag]
            heads += [base + k for k in starts]
            digests += batch.column("digest").take(pa.array(starts, pa.int64())).to_pylist()
            ids.append(batch.column("doc_id"))
        if not ids:
            return
        ids = pa.chunked_array(ids, type=id_type).combine_chunks()
        total, runs = len(ids), len(heads)
        ends = [*heads[1:], total]
        at = 0
        for start in range(0, total, ROWS_OUT):
            stop = min(start + ROWS_OUT, total)
            run_of = []
            for k in range(start, stop):
                while k >= ends[at]:
                    at += 1
                run_of.append(at)
            rows = range(start, stop)
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * (stop - start), pa.int32()),
                ids.slice(start, stop - start),
                pa.array([digests[r] for r in run_of], pa.string()),
                ids.take(pa.array([heads[r] for r in run_of], pa.int64())),
                pa.array([ends[r] - heads[r] for r in run_of], pa.int64()),
                pa.array([heads[r] == k for r, k in zip(run_of, rows)], pa.bool_()),
                pa.array([r == 0 for r in run_of], pa.bool_()),
                pa.array([r == runs - 1 for r in run_of], pa.bool_()),
                pa.array([k == 0 for k in rows], pa.bool_()),
                pa.array([k == total - 1 for k in rows], pa.bool_()),
                pa.array([first_text if k == 0 else last_text if k == total - 1 else None for k in rows], pa.string()),
            ], schema=out)

    return run


def continued_parts(edges: DataFrame) -> DataFrame:
    """One row per non-empty partition: whether its first text equals the last text
    of the partition before. Two short rows per partition are put in order; their
    texts meet in a join, not in one task. edges: part, first_row, edge_text (the
    partition's last text where first_row is false)."""
    firsts = edges.where("first_row").select("part", F.col("edge_text").alias("first_text"))
    lasts = edges.where("last_row").select(F.col("part").alias("before"), F.col("last_text"))
    order = firsts.select("part").withColumn("before", F.lag("part").over(Window.orderBy("part")))
    return (
        order.join(firsts, "part")
        .join(lasts, "before", "left")
        .select("part", "before", F.coalesce(F.col("first_text") == F.col("last_text"), F.lit(False)).alias("continued"))
    )


def exact_dedup(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts, and texts of white space only, are one group. Of equal
    texts the row with the most code points stays, then the smallest id (null ids
    last). Of repeated rows with one id exactly one is kept; all name that id as
    keep_id. Other columns of docs are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    ordered = sorted_by_content(docs, id_col, text_col, carry=False)
    id_type = docs.schema[id_col].dataType
    out = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("doc_id", id_type),
        T.StructField("digest", T.StringType()), T.StructField("keep_id", id_type),
        T.StructField("run_size", T.LongType()), *[
            T.StructField(n, T.BooleanType()) for n in ("head", "first_run", "last_run", "first_row", "last_row")
        ], T.StructField("edge_text", T.StringType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_type

    runs = written(ordered.mapInArrow(classify_runs(to_arrow_type(id_type)), out), "exact-runs")

    # A partition of one row is its own first and last row.
    edges = runs.where("first_row or last_row").select(
        "part", "keep_id", "run_size", "first_run", "last_run", "first_row", "last_row", "edge_text",
        F.col("edge_text").alias("last_text"),
    )
    flags = continued_parts(edges)
    firsts = edges.where("first_row").select(
        "part", F.col("run_size").alias("first_size"), F.col("last_run").alias("single"))
    lasts = edges.where("last_row").select("part", F.col("keep_id").alias("last_keep"), F.col("run_size").alias("last_size"))
    parts = flags.join(firsts, "part").join(lasts, "part")
    # The run that is open at the end of a partition began in `opened`.
    by_part = Window.orderBy("part")
    parts = parts.withColumn(
        "opened", F.max(F.when(~(F.col("single") & F.col("continued")), F.col("part"))).over(by_part)
    ).withColumn("opened_before", F.lag("opened").over(by_part))
    pieces = parts.where("continued").groupBy(F.col("opened_before").alias("opened")).agg(
        F.sum("first_size").alias("more"))
    chains = (
        parts.where(F.col("opened") == F.col("part"))
        .select("opened", "last_keep", "last_size")
        .join(pieces, "opened", "left")
        .select("opened", F.col("last_keep").alias("chain_keep"),
                (F.col("last_size") + F.coalesce("more", F.lit(0))).alias("chain_size"))
    )
    at_end = parts.join(chains, "opened").select("part", F.lit(True).alias("at_end"), "chain_keep", "chain_size", "continued")
    at_start = (
        parts.where("continued").select("part", "continued", F.col("opened_before").alias("opened"))
        .join(chains, "opened")
        .select("part", F.lit(False).alias("at_end"), "chain_keep", "chain_size", "continued")
    )
    # At most two rows per partition, whatever the number of documents.
    stitched = at_end.unionByName(at_start)
    result = runs.withColumn("at_end", F.when(F.col("last_run"), True).when(F.col("first_run"), False))
    result = result.join(F.broadcast(stitched), ["part", "at_end"], "left")
    return result.select(
        "doc_id",
        F.when(F.col("chain_size").isNotNull(), F.col("chain_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("chain_size", "run_size").alias("group_size"),
        (F.col("head") & ~(F.col("first_run") & F.coalesce("continued", F.lit(False)))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def pick_heads(row_type: pa.DataType):
    out = pa.schema([
        ("part", pa.int32()), ("first_row", pa.bool_()), ("last_row", pa.bool_()),
        ("first_text", pa.string()), ("last_text", pa.string()), ("row", row_type),
    ])

    def run(batches):
        """Streams: hands on the first row of each run, and one marker with the partition's last text."""
        part = TaskContext.get().partitionId()
        last_text, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("norm")
            heads = batch.filter(pa.array(new_run_flags(texts, last_text)))
            last_text = texts[-1].as_py()
            n = heads.num_rows
            if n:
                starts = [first, *[False] * (n - 1)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * n, pa.int32()), pa.array(starts), pa.array([False] * n),
                    pa.array([texts[0].as_py() if s else None for s in starts], pa.string()),
                    pa.nulls(n, pa.string()), heads.column("row").cast(row_type),
                ], schema=out)
                first = False
        if last_text is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([False]), pa.array([True]), pa.nulls(1, pa.string()),
                pa.array([last_text]), pa.nulls(1, row_type),
            ], schema=out)

    return run


def drop_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs that stay, all columns as they came; same rules as exact_dedup."""
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = sorted_by_content(docs, id_col, text_col, carry=True)
    row_type = ordered.schema["row"].dataType
    out = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first_row", T.BooleanType()),
        T.StructField("last_row", T.BooleanType()), T.StructField("first_text", T.StringType()),
        T.StructField("last_text", T.StringType()), T.StructField("row", row_type),
    ])
    heads = written(ordered.mapInArrow(pick_heads(to_arrow_type(row_type)), out), "exact-heads")
    edges = heads.where("first_row or last_row").select(
        "part", "first_row", "last_row", F.col("first_text").alias("edge_text"), "last_text")
    # At most one row per partition.
    again = continued_parts(edges).where("continued").select("part", F.lit(True).alias("first_row"))
    stay = heads.where(~F.col("last_row")).join(F.broadcast(again), ["part", "first_row"], "left_anti")
    return stay.select("row.*")
