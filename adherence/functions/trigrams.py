"""Trigrams of code points as numbers: counted by label, and weighed by a model's rows.

A trigram is one integer, 21 bits a code point. Texts are handled in pieces, so that a long
one costs no more memory than PIECE code points.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 21
MASK = (1 << BITS) - 1
PIECE = 1 << 18
#: Trigrams that are gathered before their counts are taken.
GATHERED = 1 << 20
#: Entries of a table of all trigrams of an alphabet, at most.
TABLE = 1 << 21


def numbers(text: str) -> np.ndarray:
    """The overlapping trigrams of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:] if len(points) > 2 else points[:0]


def string(number: int) -> str:
    return chr(number >> 2 * BITS) + chr(number >> BITS & MASK) + chr(number & MASK)


def pieces(text: str):
    """The numbers of a text, PIECE of them at a time."""
    for at in range(0, max(1, len(text) - 2), PIECE):
        yield numbers(text[at:at + PIECE + 2])


def counts_by_label(batches):
    """Rows (label, text) to rows (label, gram, n): partial counts, one row for each label,
    trigram and group of texts."""
    waiting, n = {}, 0

    def counted():
        for label, parts in waiting.items():
            found, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(times, pa.int64())],
                names=["_label", "_gram", "_n"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in pieces(text or ""):
                waiting.setdefault(label, []).append(part)
                n += len(part)
                if n >= GATHERED:
                    yield from counted()
                    waiting, n = {}, 0
    yield from counted()


def places(grams: np.ndarray):
    """A function of a text's numbers: the places of those among `grams` (sorted), or
    len(grams). A small alphabet is looked up in one table, a large one by halving."""
    points = np.unique(np.concatenate([grams >> 2 * BITS, grams >> BITS & MASK, grams & MASK]))
    size = len(points) + 1
    if size ** 3 > TABLE:
        padded = np.append(grams, -1)

        def halved(part):
            at = np.searchsorted(grams, part)
            return np.where(padded[at] == part, at, len(grams))

        return halved
    letter = np.full(1 << BITS, size - 1, np.int32)
    letter[points] = np.arange(size - 1)

    def key(part):
        return (letter[part >> 2 * BITS] * size + letter[part >> BITS & MASK]) * size + letter[part & MASK]

    table = np.full(size ** 3, len(grams), np.int32)
    table[key(grams)] = np.arange(len(grams))
    return lambda part: table[key(part)]


def best_classes(texts, grams: np.ndarray, weights: np.ndarray, prior: np.ndarray):
    """Per text (null: null) the class of the highest prior + sum of the weights of its known
    trigrams, the first of equal ones. grams: sorted numbers; weights: a row a class."""
    place, known = places(grams), np.concatenate([weights, np.zeros((len(prior), 1))], axis=1)
    for column in texts:
        found = []
        for text in column:
            scores = prior.copy()
            for part in pieces(text or ""):
                scores += known.take(place(part), axis=1).sum(axis=1)
            found.append(None if text is None else int(scores.argmax()))
        yield found
