"""Token counts by a linear longest-match automaton.

Greedy word pieces take, from the start of a word, the longest vocabulary entry that
fits, again and again. A trie over the entries' bytes gets failure links: where a
byte leads nowhere, the link goes to the node of what is left after the pieces that
are then certain, and their number is stored with the link (Song et al., 2021). One
pass over a word's bytes then adds up stored numbers; no piece is ever built. What
remains at the end of a word also has its number of pieces stored with its node.
"""

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from adherence.llm.common import keyed_texts, schema

#: Words kept with their counts in a worker, and the longest word kept.
KEPT_WORDS = 150_000
KEPT_LENGTH = 64

_COUNTERS = {}


class PieceCounter:
    """The automaton of one vocabulary (byte strings)."""

    def __init__(self, vocabulary):
        self.step = {}  # node * 256 + byte -> node; node 0 is the root
        ends, last = set(), 0
        for entry in vocabulary:
            node = 0
            for byte in entry:
                key = node << 8 | byte
                if key not in self.step:
                    last += 1
                    self.step[key] = last
                node = self.step[key]
            if node:
                ends.add(node)
        self.link = [-1] * (last + 1)  # -1: no way on, the word has no pieces
        self.popped = [0] * (last + 1)
        self.rest = [0] + [-1] * last  # pieces of what a node stands for; -1: none
        # Parents come before their children in this order, by depth.
        layer, children = [0], {}
        for key, node in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        while layer:
            deeper = []
            for parent in layer:
                for byte, node in children.get(parent, ()):
                    if node in ends:
                        self.link[node], self.popped[node] = 0, 1
                    else:
                        at, popped = self.link[parent], self.popped[parent]
                        while at >= 0 and (at << 8 | byte) not in self.step:
                            popped += self.popped[at]
                            at = self.link[at]
                        if at >= 0:
                            self.link[node], self.popped[node] = self.step[at << 8 | byte], popped
                    onward = self.link[node]
                    if onward >= 0 and self.rest[onward] >= 0:
                        self.rest[node] = self.popped[node] + self.rest[onward]
                    deeper.append(node)
            layer = deeper

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word; a word that cannot be cut into entries is one unknown piece."""
        step, link, popped, node, total = self.step, self.link, self.popped, 0, 0
        for byte in word:
            onward = step.get(node << 8 | byte)
            while onward is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                onward = step.get(node << 8 | byte)
            node = onward
        return total + self.rest[node] if self.rest[node] >= 0 else 1


class _WordCounts(dict):
    def __init__(self, counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word):
        n = self.counter.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def read_vocabulary(rank_file: str) -> list[bytes]:
    with open(rank_file, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


def counter(rank_file: str) -> _WordCounts:
    """One automaton with its word table per worker process."""
    if rank_file not in _COUNTERS:
        _COUNTERS[rank_file] = _WordCounts(PieceCounter(read_vocabulary(rank_file)))
    return _COUNTERS[rank_file]


def count_tokens(docs: DataFrame, rank_file: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens. Words are the matches of the
    pattern in the whole text; each is cut greedily by itself.

    Null and empty texts have no words and no tokens. Repeated rows each get a row,
    other columns are not read, an empty table gives no rows. The vocabulary file must
    be at the same path on every executor."""
    out = schema(doc_id=docs.schema[id_col].dataType, n_words=T.LongType(), n_tokens=T.LongType())

    def run(batches):
        counts, matches = counter(rank_file), regex.compile(pattern)
        for batch in batches:
            words, tokens = [], []
            for value in batch.column("text"):
                n = total = 0
                for match in matches.finditer(value.as_py()):
                    n += 1
                    total += counts[match.group()]
                words.append(n)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, out)
