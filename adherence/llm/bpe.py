"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The library encodes; texts beyond a length are first cut at safe boundaries, so
that its pattern never meets a long text at once. A boundary is safe where no
match of the pattern can reach across and no look-ahead looks across:

- between a character that is no white space and a white-space character: white
  space occurs only at the start of a match, or in matches of white space alone;
- between a letter and a digit, in either order: no match holds both.

A stretch without such a boundary is one match, or white space before one; long
runs of one class are cut by the pattern's own rules and handed to the library
one match at a time.
"""

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from adherence.llm.common import keyed_texts, schema

#: Texts up to this many characters go to the library whole.
WHOLE = 20_000

_ENCODERS = {}


class Encoder:
    """One rank file: encode a text to ids, decode ids to bytes."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.by_pattern = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.one_match = tiktoken.Encoding("ranks-whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.safe = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

    def chunks(self, text: str):
        """The text in pieces of about WHOLE characters, cut at safe boundaries only."""
        start = 0
        while len(text) - start > WHOLE:
            cut = self.safe.search(text, start + WHOLE)
            if cut is None:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= WHOLE:
            return self.by_pattern.encode_ordinary(text)
        ids = []
        for chunk in self.chunks(text):
            if len(chunk) <= 2 * WHOLE:
                ids += self.by_pattern.encode_ordinary(chunk)
            else:
                for match in self.matches.finditer(chunk):
                    ids += self.one_match.encode_ordinary(match.group())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.by_pattern.decode_bytes(ids)


def encoder(rank_file: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    key = (rank_file, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rank_file, pattern)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit),
    decoded (binary, the bytes the ids stand for).

    Null texts count as empty and give no ids. Ids, repeated rows and other columns
    do not matter; an empty table gives no rows. The rank file must be at the same
    path on every executor."""
    out = schema(doc_id=docs.schema[id_col].dataType, ids=T.BinaryType(), decoded=T.BinaryType())

    def run(batches):
        enc = encoder(rank_file, pattern)
        for batch in batches:
            packed, decoded = [], []
            for value in batch.column("text"):
                ids = enc.encode(value.as_py())
                packed.append(np.asarray(ids, dtype="<u4").tobytes())
                decoded.append(enc.decode(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, out)


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_texts' rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
