"""JSON documents with one long array, written and read without holding them whole.

Writing streams the sorted elements of a document into one file (a Python data source
with a commit protocol: tasks write temporary files, the commit renames them). Reading
cuts a file into byte ranges, reads them in parallel and finds the array's elements in
them: a first pass counts quotes and brackets of every range, running sums of those tell
each range whether it begins inside a string and how deep, and a second pass hands out
the elements that begin in it. Parsing them is left to Spark's own JSON functions.

Files are opened by executors through Arrow's file systems, so their scheme must be one
of those (local, HDFS, object stores).
"""

from __future__ import annotations

import re
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from adherence.session import written

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "json_documents"
BYTES_PER_RANGE = 4 << 20
#: Bytes of ranges that a task reads one after another, and the tasks that small inputs have at least.
BYTES_PER_TASK = 8 << 20
LEAST_TASKS = 32
#: Bytes read at first, and at most at once, where an element goes on behind its range.
FIRST_STEP, STEP = 8 << 10, 1 << 20


def _file_system(path: str):
    """(file system, path in it) of a path or URI as Spark writes them."""
    if re.match(r"file:/(?!//)", path):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


# --- writing -------------------------------------------------------------------


class _Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names  # (temporary, final)


class _DocumentWriter(DataSourceWriter):
    """Rows (document, pos, head, element), sorted by the first two; a document's first row
    holds its head, a JSON object, the others the elements of its array in order."""

    def __init__(self, path, array):
        self.path, self.array = path.rstrip("/"), array

    def write(self, iterator):
        system, folder = _file_system(self.path)
        system.create_dir(folder)
        names, out, document, first = [], None, None, True
        try:
            for row in iterator:
                if out is None or row.document != document:
                    if row.head is None:
                        raise ValueError(f"document {row.document} has elements but no head")
                    if out is not None:
                        out.write(b"]}")
                        out.close()
                    document, first = row.document, True
                    names.append((f"{folder}/_temporary-{uuid.uuid4().hex}", f"{folder}/{document}"))
                    out = system.open_output_stream(names[-1][0])
                    head = row.head.strip()[:-1].rstrip()
                    out.write((head + (", " if head != "{" else "") + f'"{self.array}": [').encode())
                if row.element is not None:
                    out.write((("" if first else ",\n") + row.element).encode())
                    first = False
            if out is not None:
                out.write(b"]}")
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            self.abort([_Files(names)])
            raise
        return _Files(names)

    def commit(self, messages):
        system, _ = _file_system(self.path)
        for message in filter(None, messages):
            for temporary, final in message.names:
                if system.get_file_info(final).type != fs.FileType.NotFound:
                    system.delete_file(final)
                system.move(temporary, final)

    def abort(self, messages):
        system, _ = _file_system(self.path)
        for message in filter(None, messages):
            for temporary, _ in message.names:
                if system.get_file_info(temporary).type != fs.FileType.NotFound:
                    system.delete_file(temporary)


class JsonDocuments(DataSource):
    """The format `json_documents`; options: path, array."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "document string, pos bigint, head string, element string"

    def writer(self, schema, overwrite):
        return _DocumentWriter(self.options["path"], self.options["array"])


def write_documents(heads: DataFrame, elements: DataFrame, path, array) -> None:
    """One file per document under `path`, named after it; one written again is replaced.

    heads: document, head (a JSON object); elements: document, pos, element (JSON texts).
    A document without elements gets an empty array. A document's rows meet in one task,
    which sorts them outside of memory and keeps one of them at a time. Null names are
    left out."""
    rows = heads.select("document", F.lit(-1).cast("long").alias("pos"), "head", F.lit(None).cast("string").alias("element")).unionByName(
        elements.select("document", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("string").alias("head"), "element"))
    rows = rows.where(F.col("document").isNotNull())
    spark = rows.sparkSession
    spark.dataSource.register(JsonDocuments)
    sorted_ = rows.repartition("document").sortWithinPartitions("document", F.asc("pos"), F.asc_nulls_last("element"))
    sorted_.write.format(FORMAT).mode("append").option("path", path).option("array", array).save()


# --- reading -------------------------------------------------------------------


class Scan:
    """Quotes and brackets of some bytes that begin inside a string or not, and at a depth."""

    def __init__(self, data: bytes, backslashes: int, inside=0, depth=0):
        """backslashes: how many stand directly before the bytes."""
        self.bytes = byte = np.frombuffer(data, np.uint8)
        slash = byte == 92
        at = np.arange(len(byte), dtype=np.int32)
        plain = np.maximum.accumulate(np.where(slash, np.int32(-1), at)) if len(byte) else at
        # Backslashes before each byte: since the last other one, or since the beginning.
        before = np.concatenate(([-1], plain[:-1])).astype(np.int64) if len(byte) else np.zeros(0, np.int64)
        run = np.where(before >= 0, at - before - 1, at + backslashes)
        self.quote = (byte == 34) & (run % 2 == 0)
        # Whether a byte, other than a quote, is inside a string.
        self.inside = (np.cumsum(self.quote, dtype=np.int32) + inside) % 2 == 1
        opens, closes = (byte == 123) | (byte == 91), (byte == 125) | (byte == 93)
        self.step = opens.astype(np.int32) - closes
        self.depth = depth + np.cumsum(np.where(self.inside, 0, self.step), dtype=np.int32)

    def summary(self):
        """(parity of the quotes, change of depth if it begins outside a string, and inside)."""
        return int(self.quote.sum()) % 2, int(self.step[~self.inside].sum()), int(self.step[self.inside].sum())


def _backslashes(file, start: int) -> int:
    """How many backslashes stand directly before a place."""
    n = 0
    while start > 0:
        low = max(0, start - 4096)
        file.seek(low)
        part = file.read(start - low)
        left = len(part.rstrip(b"\\"))
        n += len(part) - left
        if left:
            break
        start = low
    return n


def _opened(path):
    system, place = _file_system(path)
    return system.open_input_file(place)


def _range(file, start, end, inside=0, depth=0) -> Scan:
    before = _backslashes(file, start)
    file.seek(start)
    return Scan(file.read(end - start), before, inside, depth)


def _batch(names_types, rows):
    columns = list(zip(*rows)) if rows else [[] for _ in names_types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names_types)], names=[n for n, _ in names_types])


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _summaries(batches):
    out = [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("length", pa.int64()),
           ("quotes", pa.int32()), ("outside", pa.int64()), ("within", pa.int64())]
    for r in _rows(batches):
        with _opened(r["path"]) as file:
            yield _batch(out, [(r["path"], r["start"], r["end"], r["length"], *_range(file, r["start"], r["end"]).summary())])


def _sections(batches):
    """Where the members of the outermost object that are objects or arrays begin and end."""
    out = [("path", pa.string()), ("at", pa.int64()), ("kind", pa.string())]
    for r in _rows(batches):
        with _opened(r["path"]) as file:
            scan = _range(file, r["start"], r["end"], r["inside"], r["depth"])
            change = ~scan.inside & (scan.step != 0)
            rows = []
            for k in np.flatnonzero(change & (scan.depth == np.where(scan.step > 0, 2, 1))).tolist():
                kind = "end"
                if scan.step[k] > 0:
                    at = r["start"] + k
                    file.seek(max(0, at - 1024))
                    name = re.search(rb'"([^"\\]*)"\s*:\s*\Z', file.read(at - max(0, at - 1024)))
                    kind = chr(scan.bytes[k]) + (name[1].decode() if name else "")
                rows.append((r["path"], r["start"] + k, kind))
            yield _batch(out, rows)


def _elements(batches):
    """The elements that begin in a range of the array; one that is no object makes `bad`."""
    out = [("path", pa.string()), ("start", pa.int64()), ("ord", pa.int64()), ("element", pa.string()), ("bad", pa.bool_())]
    for r in _rows(batches):
        with _opened(r["path"]) as file:
            scan = _range(file, r["start"], r["end"], r["inside"], r["depth"])
            place = np.arange(r["start"], r["end"])
            ours = (place > r["first"]) & (place < r["last"])
            outside = ~scan.inside & ours
            between = outside & (scan.depth == 2) & ~scan.quote & (scan.step == 0)
            bad = bool((between & ~np.isin(scan.bytes, np.frombuffer(b" \t\r\n,", np.uint8))).any()
                       or (ours & scan.quote & (scan.depth == 2)).any() or (outside & (scan.depth == 3) & (scan.bytes == 91)).any())
            begins = np.flatnonzero(outside & (scan.depth == 3) & (scan.bytes == 123))
            closes = np.flatnonzero(outside & (scan.depth == 2) & (scan.bytes == 125))
            closes = closes[np.searchsorted(closes, begins[0]):] if len(begins) else closes[:0]
            data = scan.bytes.tobytes()
            rows = [(r["path"], r["start"], k, data[a:b + 1].decode("utf-8", "replace"), bad)
                    for k, (a, b) in enumerate(zip(begins.tolist(), closes.tolist()))]
            if len(begins) > len(closes):
                last = _whole(file, data[int(begins[-1]):], r["end"], r["last"])
                rows.append((r["path"], r["start"], len(closes), last.decode("utf-8", "replace"), bad))
            if bad and not rows:
                rows = [(r["path"], r["start"], 0, None, True)]
            for at in range(0, len(rows), 256):
                yield _batch(out, rows[at:at + 256])


def _whole(file, begun: bytes, at: int, last: int) -> bytes:
    """An element that goes on behind its range."""
    parts, scan = [begun], Scan(begun, 0)
    depth, inside, tail, step = int(scan.depth[-1]), int(scan.inside[-1]), begun, FIRST_STEP
    while at < last:
        file.seek(at)
        more = file.read(min(step, last - at))
        step = min(2 * step, STEP)
        slashes = len(tail) - len(tail.rstrip(b"\\"))
        scan = Scan(more, slashes, inside, depth)
        ends = np.flatnonzero(~scan.inside & (scan.depth == 0))
        if len(ends):
            parts.append(more[:int(ends[0]) + 1])
            break
        parts.append(more)
        tail = more if more.rstrip(b"\\") else tail + more
        depth, inside, at = int(scan.depth[-1]), int(scan.inside[-1]), at + len(more)
    return b"".join(parts)


def _heads(batches):
    """The document without the elements of its array, which are bytes first..last."""
    out = [("path", pa.string()), ("head", pa.string())]
    for r in _rows(batches):
        with _opened(r["path"]) as file:
            first, last = (r["first"] + 1, r["last"]) if r["first"] is not None else (r["length"], r["length"])
            file.seek(0)
            head = file.read(first)
            file.seek(last)
            yield _batch(out, [(r["path"], (head + file.read(r["length"] - last)).decode("utf-8", "replace"))])


def files(spark: SparkSession, path) -> DataFrame:
    """path, length of the files under a path; none if it is missing."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long")


def _tasks(n_ranges: int, n_bytes: int) -> int:
    """Tasks grow with the bytes, not with the ranges, which may be small."""
    return max(1, min(n_ranges, max(LEAST_TASKS, n_bytes // BYTES_PER_TASK), 100_000))


def read_documents(spark: SparkSession, path, array, bytes_per_range=BYTES_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """(heads, elements) of the JSON documents under a path.

    heads: path, file, head (the document with an empty array); elements: path, pos (from
    0), element (JSON text). Documents that do not close every string and bracket, or whose
    array holds something other than objects, are left out of both. Their elements are
    written once to the shared folder. Any encoding but UTF-8 is not supported."""
    found = files(spark, path)
    step = F.lit(bytes_per_range).cast("long")
    ranges = found.where(F.col("length") > 0).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + step, F.col("length")))
    n_ranges, n_bytes = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    spread = _tasks(n_ranges, n_bytes)
    ranges = ranges.select("path", "start", "end", "length").repartition(spread, "path", "start")
    summaries = written(ranges.mapInArrow(_summaries, "path string, start long, end long, length long, quotes int, outside long, within long"), "ranges")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = summaries.withColumn("inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    # Depths: what the range adds, given whether it begins inside a string. `outside` and `within` are
    # counted as if it began outside.
    states = states.withColumn("adds", F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within")))
    states = written(states.withColumn("depth", F.coalesce(F.sum("adds").over(before), F.lit(0)).cast("int")), "states")
    closed = states.groupBy("path").agg(F.max("length").alias("length"), F.sum("adds").alias("depth"), F.sum("quotes").alias("quotes")).where(
        (F.col("depth") == 0) & (F.col("quotes") % 2 == 0))
    spots = states.select("path", "start", "end", "inside", "depth").repartition(spread, "path", "start").mapInArrow(
        _sections, "path string, at long, kind string")
    ordered = Window.partitionBy("path").orderBy("at")
    sections = spots.withColumn("until", F.lead("at").over(ordered)).where(F.col("kind") == f"[{array}")
    # As with any JSON reader, the last member of a name counts.
    arrays = written(sections.groupBy("path").agg(F.max(F.struct("at", "until")).alias("s")).select(
        "path", F.col("s.at").alias("first"), F.col("s.until").alias("last")), "sections")
    inside = states.join(arrays, "path").where((F.col("end") > F.col("first")) & (F.col("start") < F.col("last")))
    elements = written(
        inside.select("path", "start", "end", "inside", "depth", "first", "last").repartition(spread, "path", "start").mapInArrow(
            _elements, "path string, start long, ord long, element string, bad boolean"), "elements")
    bad = elements.where("bad").select("path").distinct()
    good = written(closed.join(bad, "path", "left_anti").join(arrays, "path", "left").select("path", "length", "first", "last"), "documents")
    counts = elements.groupBy("path", "start").agg(F.count("*").alias("n"))
    offsets = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = elements.join(offsets, ["path", "start"]).join(good.select("path"), "path", "left_semi")
    heads = good.mapInArrow(_heads, "path string, head string").select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "head")
    return heads, placed.select("path", (F.col("offset") + F.col("ord")).alias("pos"), "element")
