"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into three segments of 22, 21 and 21 bits. Of two
or fewer wrong bits at least one segment has none (pigeonhole), and every other
segment has at most two. A segment, read as a word of 23 bits, is decoded by the
perfect binary Golay code to the indices of nearby codewords: one where the
nearest codeword is at most two bits away, else that one and the five at distance
four. Two words that differ in at most two bits always share an index. So the keys
(segment s as it is, index of the next segment) bring all links together, about
16 keys of 33 to 34 bits per fingerprint; candidates are verified by their bits.

Keys are made for distinct fingerprints, so copies cost one row. A key that many
fingerprints share is not paired up: its members get the 65 words within one bit
of themselves as keys. Two fingerprints share such a word exactly if they differ
in at most two bits, and a word has at most 65 owners, so linking the owners to
the smallest of them keeps every component, without pairs.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from adherence.llm.common import keyed_texts, written
from adherence.llm.components import stars

# The contract's hash seed, and the generator of the binary Golay code,
# x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
SEED = 42
GENERATOR = 0b101011100011
MAX_DISTANCE = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared with each other; larger groups go by neighbouring words.
PAIRED = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str, shingle: int) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at: at + BLOCK], ends[at: at + BLOCK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprint_column(text, shingle: int):
    """The fingerprint of a text column as a signed long; null counts as empty."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return prints(F.coalesce(text, F.lit("")))


class Golay:
    """Tables of the [23, 12, 7] code, built from its generator."""

    def __init__(self):
        single = []
        for bit in range(23):
            word = 1 << bit
            for high in range(22, 10, -1):
                if word >> high & 1:
                    word ^= GENERATOR << (high - 11)
            single.append(word)
        self.remainders = np.zeros((3, 256), np.int32)
        for part in range(3):
            for byte in range(256):
                for bit in range(8):
                    if byte >> bit & 1 and part * 8 + bit < 23:
                        self.remainders[part, byte] ^= single[part * 8 + bit]
        errors = [[] for _ in range(2048)]
        for weight in range(5):
            for places in combinations(range(23), weight):
                syndrome = word = 0
                for place in places:
                    syndrome ^= single[place]
                    word |= 1 << place
                if weight < 4 or bin(errors[syndrome][0]).count("1") == 3:
                    errors[syndrome].append(word)
        self.count = np.array([len(e) for e in errors], np.int8)
        self.errors = np.array([e + [e[0]] * (6 - len(e)) for e in errors], np.int32)

    def indices(self, words: np.ndarray):
        """Codeword indices of words of 23 bits: an array (n, 6), and which entries count."""
        syndrome = (
            self.remainders[0, words & 255] ^ self.remainders[1, words >> 8 & 255] ^ self.remainders[2, words >> 16 & 255]
        )
        codewords = words[:, None] ^ self.errors[syndrome]
        return codewords >> 11, np.arange(6)[None, :] < self.count[syndrome][:, None]


def golay_keys(fps: np.ndarray):
    """(keys, positions of their fingerprints) of an array of signed longs."""
    golay = _golay()
    bits = fps.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, owners = [], []
    for s in range(3):
        index, used = golay.indices(parts[(s + 1) % 3].astype(np.int32))
        key = (np.int64(s) << np.int64(36)) | (parts[s][:, None] << 12) | index.astype(np.int64)
        owner = np.broadcast_to(np.arange(len(fps))[:, None], used.shape)
        keys.append(key[used])
        owners.append(owner[used])
    return np.concatenate(keys), np.concatenate(owners)


_TABLES = []


def _golay() -> Golay:
    if not _TABLES:
        _TABLES.append(Golay())
    return _TABLES[0]


def _key_rows(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at: at + 4096]
            keys, owners = golay_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], names=["key", "fp"])


def fingerprint_links(fps: DataFrame, paired=PAIRED) -> DataFrame:
    """fps: distinct fingerprints (fp long). Links (a, b) whose components are those
    of all pairs that differ in two or fewer bits; each link is such a pair."""
    keys = fps.select("fp").mapInArrow(_key_rows, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(keys.join(sizes, "key"), "simhash-shared")
    few = shared.where(F.col("size") <= paired)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")
    many = written(shared.where(F.col("size") > paired).select("fp").distinct(), "simhash-many")
    words = many.select(
        "fp", F.explode(F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("least"), F.count("*").alias("owners")).where("owners > 1")
    linked = words.join(least, "word").where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(linked)


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """prints: (doc_id, fp). One row per distinct fingerprint: fp, component_id, the
    smallest doc_id that can be reached over links."""
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    star = stars(fingerprint_links(fps))
    members = written(star.join(fps, star.node == fps.fp).select("fp", "root", "first"), "simhash-members")
    roots = star.select(F.col("root").alias("fp")).distinct().join(fps, "fp").select("fp", F.col("fp").alias("root"), "first")
    ids = written(
        members.unionByName(roots).groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ids")
    linked = members.select("fp", "root").unionByName(roots.select("fp", "root")).join(ids, "root").select("fp", "component_id")
    return written(
        fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")),
        "simhash-components")


def _check(max_distance):
    if max_distance != MAX_DISTANCE:
        raise ValueError("the keys are built for a distance of two bits")


def simhash_components(docs: DataFrame, shingle=3, max_distance=MAX_DISTANCE, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Whole texts, A-Z in lower case, words between white space; a text of fewer words
    than a shingle is one shingle, one without words (null, empty, blank) has
    fingerprint zero and is linked like any other. Rows that repeat an id, or a row,
    each get their row. Null ids take part; they name a component only if it has no
    other id. Other columns are not read; an empty table gives no rows."""
    _check(max_distance)
    base = keyed_texts(docs, id_col, text_col)
    prints = written(base.select("doc_id", fingerprint_column(base.text, shingle).alias("fp")), "simhash")
    found = fingerprint_components(prints)
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle=3, max_distance=MAX_DISTANCE, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest
    id, all columns as they came. Rows that repeat that id with the same fingerprint all
    stay, equal ones too. Rows without an id stay where their component has no id at all."""
    _check(max_distance)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    marked = written(row.withColumn("fp", fingerprint_column(F.col("row")[text_col], shingle)), "simhash-rows")
    found = fingerprint_components(marked.select(F.col("row")[id_col].alias("doc_id"), "fp"))
    ids = marked.select(F.col("row")[id_col].alias("doc_id"), "fp")
    stay = ids.join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("stay_id"), F.col("fp").alias("stay_fp")).distinct()
    same = marked.row[id_col].eqNullSafe(stay.stay_id) & (marked.fp == stay.stay_fp)
    return marked.join(stay, same, "left_semi").select("row.*")
