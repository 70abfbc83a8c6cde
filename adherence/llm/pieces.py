"""SentencePiece (merge type) encoding by a table of prefixes, and decoding.

Encoding merges, again and again, the neighbours whose joint piece has the best score,
the leftmost first. A sequence of pieces is that encoding just if every two neighbours
are: if none of the merges that build them would have joined across their border. So
each prefix of a text has one last piece only. An automaton over the vocabulary reports
the pieces that end at a place; the one that is compatible with the last piece of the
prefix before it is stored, and the ids are read from the table backwards. That is one
pass over the text, whatever its length.

Two neighbours are compatible if, going back through the merges that built them from
the latest to the earliest, no joint piece of the two border parts comes before the
merge undone last. Pieces whose merges do not come in the order of their scores are
compared by merging the characters of both.

A border that no piece of the vocabulary crosses (before a space mark that follows
another character) is kept from the start: what lies between two is encoded once and kept
in a bounded table. A character outside the vocabulary is a border too, and becomes its
byte pieces, or the unknown piece where the model has none.
"""

import heapq
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from adherence.llm.common import keyed_texts, schema

#: Stretches kept with their ids in a worker (and as many older ones), the longest kept, and pairs kept.
KEPT_STRETCHES = 150_000
KEPT_LENGTH = 64
KEPT_PAIRS = 1_000_000

#: The mark that stands for a space in pieces.
MARK = "▁"

_CODERS = {}


def merged(text: str, rank: dict) -> tuple[list[str], list[tuple[int, str, str]]]:
    """The pieces that merging leaves, and the merges made as (rank, left, right)."""
    parts = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    made, queue = [], []

    def offer(left):
        right = after[left]
        if right < len(parts) and (r := rank.get(parts[left] + parts[right])) is not None:
            heapq.heappush(queue, (r, left, right, parts[left], parts[right]))

    for left in range(len(parts)):
        offer(left)
    while queue:
        r, left, right, a, b = heapq.heappop(queue)
        if parts[left] != a or after[left] != right or parts[right] != b:
            continue
        made.append((r, a, b))
        parts[left], parts[right], after[left] = a + b, None, after[right]
        if after[left] < len(parts):
            before[after[left]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    return [p for p in parts if p is not None], made


class _Followers(dict):
    """Whether a piece may stand after a certain one: looked up or tested."""

    def __init__(self, table, prior):
        super().__init__()
        self.table, self.prior = table, prior

    def __missing__(self, piece):
        may = self[piece] = self.table.follows(self.prior, piece)
        return may


class PrefixTable:
    """The encoder of one vocabulary: {id: (piece, score)}."""

    def __init__(self, vocabulary: dict):
        order = {score: k for k, score in enumerate(sorted({score for _, score in vocabulary.values()}, reverse=True))}
        self.rank = {piece: order[score] for piece, score in vocabulary.values()}
        self.start = max(vocabulary, default=-1) + 1  # stands before a text and for a character outside the vocabulary
        self.names, self.sizes = [""] * self.start, [1] * (self.start + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (piece, _) in vocabulary.items():
            self.names[k], self.sizes[k] = piece, len(piece)
            self.automaton.add_word(piece, k)
        if vocabulary:
            self.automaton.make_automaton()
        self.histories = {}
        self._forget()

    def _forget(self):
        self.followers, self.n_kept = [_Followers(self, k) for k in range(self.start + 1)], 0

    def history(self, piece: str):
        """(rank of its last merge, left part, right part, whether its merges come in the
        order of their ranks); None if merging never gives this piece."""
        if piece not in self.histories:
            parts, made = merged(piece, self.rank)
            ranks = [m[0] for m in made]
            ordered = all(a < b for a, b in zip(ranks, ranks[1:]))
            self.histories[piece] = (*(made[-1] if made else (-1, "", "")), ordered) if len(parts) == 1 else None
        return self.histories[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of both leaves just them."""
        if not (self.history(a)[3] and self.history(b)[3]):
            return merged(a + b, self.rank)[0] == [a, b]
        # Until: the merge after which the two border parts are no longer neighbours. At the
        # same rank the merge further left goes first.
        until, on_left = float("inf"), True
        while True:
            joint = self.rank.get(a + b)
            if joint is not None and (joint < until or joint == until and not on_left):
                return False
            formed_a, _, inner_a, _ = self.history(a)
            formed_b, inner_b, _, _ = self.history(b)
            if formed_a < 0 and formed_b < 0:
                return True
            on_left = formed_a > formed_b
            if on_left:
                until, a = formed_a, inner_a
            else:
                until, b = formed_b, inner_b

    def follows(self, prior: int, piece: int) -> bool:
        """Whether a piece may stand after another one, or at the start."""
        self.n_kept += 1
        if self.history(self.names[piece]) is None:
            return False
        return prior == self.start or self.compatible(self.names[prior], self.names[piece])

    def ids(self, text: str) -> list[int]:
        """The encoding of a text; a character outside the vocabulary is -1 - its code point."""
        if self.n_kept >= KEPT_PAIRS:
            self._forget()
        start, sizes, followers = self.start, self.sizes, self.followers
        last = [start] * (len(text) + 1)  # by the place of the prefix's last character; at -1 the empty one
        if start:
            for end, piece in self.automaton.iter(text):
                if last[end] == start and followers[last[end - sizes[piece]]][piece]:
                    last[end] = piece
        backwards, end = [], len(text) - 1
        while end >= 0:
            piece = last[end]
            backwards.append(piece if piece != start else -1 - ord(text[end]))
            end -= sizes[piece]
        backwards.reverse()
        return backwards


class Coder(dict):
    """One model file: stretches of normalised text to ids (little-endian, unsigned 32-bit).
    The table is bounded: when it is full it becomes the older one, which is asked once more."""

    def __init__(self, model_file: str):
        super().__init__()
        self.older = {}
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(m.get_piece_size())
        if any(map(m.is_unused, every)):
            raise ValueError("a vocabulary with unused pieces is not supported")
        known = [k for k in every if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k))]
        self.table = PrefixTable({k: (m.id_to_piece(k), m.get_score(k)) for k in known})
        bytes_ = {m.id_to_piece(k): k for k in every if m.is_byte(k)}
        self.of_byte = [bytes_[f"<0x{b:02X}>"] for b in range(256)] if bytes_ else None
        cuts = not any(MARK in piece.lstrip(MARK) for piece in self.table.rank)
        self.stretches = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cuts else "(?s:.+)").findall
        self.first = np.array([m.bos_id()], "<u4").tobytes()
        self.last = np.array([m.eos_id()], "<u4").tobytes()

    def _of_unknown(self, character):
        if self.of_byte is None:
            return [self.model.unk_id()]
        return [self.of_byte[b] for b in character.encode("utf-8", "surrogatepass")]

    def __missing__(self, stretch):
        packed = self.older.get(stretch)
        if packed is None:
            ids = self.table.ids(stretch)
            if min(ids) < 0:
                ids = [k for i in ids for k in ([i] if i >= 0 else self._of_unknown(chr(-1 - i)))]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(stretch) <= KEPT_LENGTH:
            if len(self) >= KEPT_STRETCHES:
                self.older = dict(self)
                self.clear()
            self[stretch] = packed
        return packed

    def encode(self, text: str) -> bytes:
        inner = map(self.__getitem__, self.stretches(self.model.normalize(text)))
        return b"".join([self.first, *inner, self.last])

    def decode(self, packed: bytes) -> str:
        return self.model.decode(np.frombuffer(packed, "<u4").tolist())


def coder(model_file: str) -> Coder:
    """One coder with its tables per worker process."""
    if model_file not in _CODERS:
        _CODERS[model_file] = Coder(model_file)
    return _CODERS[model_file]


def encode_pieces(docs: DataFrame, model_file: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit, with the
    begin and end ids), decoded (string).

    Null texts count as empty: begin and end ids alone, decoded to an empty text. Repeated
    rows each get a row, null ids stay, other columns are not read, an empty table gives no
    rows. The model file must be at the same path on every executor."""
    out = schema(doc_id=docs.schema[id_col].dataType, ids=T.BinaryType(), decoded=T.StringType())

    def run(batches):
        code = coder(model_file)
        for batch in batches:
            packed = [code.encode(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array(map(code.decode, packed), pa.string())],
                names=["doc_id", "ids", "decoded"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, out)


def piece_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_pieces' rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
