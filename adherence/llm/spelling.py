"""Spelling variants of the words of a corpus by a trie of letter-group counts.

Two words are near if one inserted, deleted or replaced code point makes one the other.
The letters are dealt to GROUPS groups of about equal use. A word's vector says how many
of its letters fall into each group; between near words at most one group has one more
(surplus) and at most one has one less (deficit). The vectors are a trie, one level a
group. A depth-first search goes along counts that are equal, or one more or one less
while that budget is not spent; words at its leaves are verified. A pair is searched from
one side: the surplus is spent before the deficit, so that the other side need not look.

The trie is cut where a node holds few enough words. The nodes above the cut are few, a
bounded share of the words, and are handed to all tasks, which send each word to the
nodes it can reach; each node's words then become the lower trie of a task, met by the
words sent there. Hot words are counted on the map side; afterwards a word is one row.

The form of a word is its near word of most occurrences (ties: the smallest in code-point
order), if it has RATIO times as many; forms of forms lead to the root. A chain of forms
grows RATIO-fold with each step, so its length is bounded by the digits of a count.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from adherence.llm.common import schema, written

GROUPS = 16
#: The letters of a word, and the letters whose case is folded.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words a node of the cut holds, unless that makes more than so many nodes.
NODE_WORDS, NODES = 10_000, 4_096
#: Distinct code points that are dealt by their use; others go by their remainder.
DEALT = 4_096
#: States of the search and pairs verified at once, and the longest word compared as a row of a matrix.
STATES, PAIRS, WIDE = 100_000, 200_000, 64


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text", change=None,
                min_length=MIN_LENGTH, min_count=MIN_COUNT) -> DataFrame:
    """word, n: the runs of letters in whole texts, A-Z in lower case, of enough code points
    and occurrences. change(id, run) may replace a run by another one that is no longer.

    Null texts have no words, null ids count as an empty id; repeated rows count each."""
    runs = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(docs[text_col], F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if change is not None:
        lowered = lowered.select(change(F.col("id"), F.col("run")).alias("run")).where(F.length("run") >= min_length)
    return lowered.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def without_one(key: Column, run: Column, modulus=31) -> Column:
    """The run; where modulus divides crc32 of `key:run`, without its code point crc32 % length."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % modulus == 0, cut).otherwise(run)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.fromiter(map(len, words), np.int64, len(words))


class Groups:
    """Which group a letter belongs to: the most used letters first, each to the group that is used least so far."""

    def __init__(self, used: dict[int, int]):
        load, self.of = [0] * GROUPS, np.arange(65_536) % GROUPS
        for point, n in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            group = load.index(min(load))
            load[group] += n
            self.of[point & 0xFFFF] = group

    def vectors(self, words: list[str]) -> np.ndarray:
        points, lengths = _points(words)
        row = np.repeat(np.arange(len(words)), lengths)
        counts = np.bincount(row * GROUPS + self.of[points & 0xFFFF], minlength=len(words) * GROUPS)
        return np.minimum(counts, 255).astype(np.uint8).reshape(-1, GROUPS)


class CountTrie:
    """Sorted distinct vectors, or prefixes of vectors, as a trie: per level the sorted keys
    parent * 512 + count; a node's number is its key's place. Leaves may be at any depth."""

    def __init__(self, rows: list[bytes] | np.ndarray):
        self.levels, self.leaf = [], []
        if isinstance(rows, np.ndarray):
            change, parent = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
            change[:1] = True
            for level in range(rows.shape[1]):
                change[1:] |= rows[1:, level] != rows[:-1, level]
                self.levels.append((parent * 512 + rows[:, level])[change])
                parent = np.cumsum(change) - 1
                leaves = np.arange(len(rows)) if level == rows.shape[1] - 1 else -1
                self.leaf.append(np.broadcast_to(leaves, len(self.levels[-1])))
            return
        places, level = {b"": 0}, 0
        while any(len(row) > level for row in rows):
            level += 1
            at = sorted({row[:level] for row in rows if len(row) >= level})
            self.levels.append(np.array([places[p[:-1]] * 512 + p[-1] for p in at], np.int64))
            places = {p: k for k, p in enumerate(at)}
            whole = {row: k for k, row in enumerate(rows) if len(row) == level}
            self.leaf.append(np.array([whole.get(p, -1) for p in at], np.int64))

    def search(self, vectors, surplus, deficit):
        """Yields (row of vectors, leaf, surplus, deficit) arrays. surplus, deficit: what of
        the budget is spent before; a deficit comes after the surplus only."""
        stack = [(0, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), surplus, deficit)]
        while stack:
            level, row, node, more, less = stack.pop()
            if len(row) > STATES:
                half = len(row) // 2
                stack += [(level, *(x[part] for x in (row, node, more, less))) for part in (slice(half, None), slice(half))]
                continue
            keys, leaf = self.levels[level], self.leaf[level]
            base, found = node * 512 + vectors[row, level], []
            for delta, free in ((0, slice(None)), (1, ~more), (-1, more & ~less & (vectors[row, level] > 0))):
                key = base[free] + delta
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[place] == key
                found.append((row[free][hit], place[hit], more[free][hit] | (delta == 1), less[free][hit] | (delta == -1)))
            row, node, more, less = map(np.concatenate, zip(*found))
            ends = leaf[node] >= 0
            if ends.any():
                yield row[ends], leaf[node[ends]], more[ends], less[ends]
            if not ends.all():
                on = ~ends
                stack.append((level + 1, row[on], node[on], more[on], less[on]))


class Lexicon:
    """Words in a form that compares many pairs at once."""

    def __init__(self, words: list[str], min_length: int):
        self.words, self.half = np.array(words, object), min(4, (min_length - 1) // 2)
        points, self.length = _points(words)
        start = np.cumsum(self.length) - self.length
        width = int(min(WIDE, self.length.max(initial=1)))
        offset = np.arange(width)
        inside = offset < self.length[:, None]
        points = np.append(points, 0)
        self.forward = np.where(inside, points[np.minimum(start[:, None] + offset, len(points) - 1)], 0)
        self.backward = np.where(inside, points[np.maximum(start[:, None] + self.length[:, None] - 1 - offset, 0)], 0)
        weights = 1 << (16 * np.arange(self.half, dtype=np.uint64)) if self.half else None
        pack = lambda side: (side[:, :self.half].astype(np.uint64) & 0xFFFF) @ weights
        self.head, self.tail = (pack(self.forward), pack(self.backward)) if self.half and width >= self.half else (None, None)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a word the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns that agree from the left, row by row."""
    width = min(a.shape[1], b.shape[1])
    differ = a[:, :width] != b[:, :width]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def near_pairs(a: Lexicon, i: np.ndarray, b: Lexicon, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) are near."""
    near = np.abs(a.length[i] - b.length[j]) <= 1
    if a.head is not None and b.head is not None:
        # One edit leaves the first or the last half of the shorter word alone.
        near &= (a.head[i] == b.head[j]) | (a.tail[i] == b.tail[j])
    at = np.flatnonzero(near)
    x, y = i[at], j[at]
    shorter = np.minimum(a.length[x], b.length[y])
    left = np.minimum(_common(a.forward[x], b.forward[y]), shorter)
    right = np.minimum(_common(a.backward[x], b.backward[y]), shorter)
    same = a.length[x] == b.length[y]
    good = np.where(same, left + right == shorter - 1, left + right >= shorter)
    for k in np.flatnonzero(np.maximum(a.length[x], b.length[y]) > WIDE):
        good[k] = one_edit(a.words[x[k]], b.words[y[k]])
    near[at] = good
    return near


def _distinct(vectors: np.ndarray):
    """Sorted distinct rows, and each row's place among them."""
    filled = np.zeros((len(vectors), -(-vectors.shape[1] // 8) * 8), np.uint8)
    filled[:, :vectors.shape[1]] = vectors
    order = np.lexsort(filled.view(">u8").T[::-1]) if filled.shape[1] else np.arange(len(vectors))
    ordered, change = vectors[order], np.ones(len(vectors), bool)
    change[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(vectors), np.int64)
    place[order] = np.cumsum(change) - 1
    return ordered[change], place


class Node:
    """The words of one node of the cut, as the lower trie."""

    def __init__(self, prefix: bytes, words, counts, vectors, min_length):
        self.prefix, self.min_length = np.frombuffer(prefix, np.uint8).astype(np.int64), min_length
        rows, place = _distinct(vectors)
        order = np.argsort(place, kind="stable")
        self.words, self.counts = Lexicon([words[k] for k in order], min_length), counts[order]
        self.start = np.searchsorted(place[order], np.arange(len(rows) + 1))
        self.trie = CountTrie(rows[:, len(prefix):]) if len(prefix) < GROUPS else None

    def near(self, words, counts, vectors):
        """Yields (word, n, near word, its n) arrays: pairs of words sent here and words of the node."""
        sent = Lexicon(words, self.min_length)
        rows, place = _distinct(vectors)
        order = np.argsort(place, kind="stable")
        start = np.searchsorted(place[order], np.arange(len(rows) + 1))
        change = self.prefix - rows[:, :len(self.prefix)]
        spent = (change == 1).any(axis=1), (change == -1).any(axis=1)
        if self.trie is None:
            found = [(np.arange(len(rows)), np.zeros(len(rows), np.int64), *spent)]
        else:
            found = self.trie.search(rows[:, len(self.prefix):], *spent)
        for row, leaf, more, less in found:
            here, there = start[row + 1] - start[row], self.start[leaf + 1] - self.start[leaf]
            ends = np.cumsum(here * there)
            first = 0
            while first < len(row):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                part = slice(first, last)
                first = last
                for i, j, k in self._expanded(row[part], start, here[part], leaf[part], there[part]):
                    i, even = order[i], ~(more[part] | less[part])[k]
                    good = near_pairs(sent, i, self.words, j)
                    # Words of equal vectors are both sent to their own leaf.
                    good[even] &= (sent.words[i[even]] < self.words.words[j[even]]).astype(bool)
                    i, j = i[good], j[good]
                    if len(i):
                        yield sent.words[i], counts[i], self.words.words[j], self.counts[j]

    def _expanded(self, row, start, here, leaf, there):
        """All pairs of the words of each row and each leaf, at most about PAIRS at once."""
        sizes = here * there
        if len(sizes) > 1 or sizes[0] <= PAIRS:
            bounds = [(0, int(sizes.sum()))]
        else:
            bounds = [(at, min(at + PAIRS, int(sizes[0]))) for at in range(0, int(sizes[0]), PAIRS)]
        ends = np.cumsum(sizes)
        for low, high in bounds:
            pair = np.arange(low, high)
            k = np.searchsorted(ends, pair, "right")
            inside = pair - (ends[k] - sizes[k])
            yield start[row[k]] + inside // there[k], self.start[leaf[k]] + inside % there[k], k


def _vectors_of(batch) -> np.ndarray:
    data = b"".join(batch.column("vector").to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, GROUPS)


def _groups(words: DataFrame) -> Groups:
    """Counts every letter of every word; at most DEALT of them come to the driver."""
    def run(batches):
        for batch in batches:
            points, n = np.unique(_points(batch.column("word").to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(points, pa.int64()), pa.array(n, pa.int64())], names=["point", "n"])

    used = words.select("word").mapInArrow(run, schema(point=T.LongType(), n=T.LongType()))
    top = used.groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(DEALT)
    return Groups({r.point: r.n for r in top.collect()})


def _cut(words: DataFrame, groups: Groups, total: int) -> list[bytes]:
    """The prefixes at which the trie is cut: below them at most NODE_WORDS words, or the
    share of all words that keeps the nodes few, or equal vectors. Two levels at a time are
    counted, below the nodes that are still too large."""
    most, cut, open_ = max(NODE_WORDS, total // NODES), [], {b""} if total else set()
    if total <= most:
        return [b""] if total else []
    depth = 0
    while open_ and depth < GROUPS:
        here, depth = frozenset(open_), min(depth + 2, GROUPS)

        def run(batches, here=here, upper=depth - 2, lower=depth):
            for batch in batches:
                vectors = groups.vectors(batch.column("word").to_pylist())
                found, place = _distinct(vectors[:, :lower])
                n = np.bincount(place, minlength=len(found))
                rows = [(v.tobytes(), int(k)) for v, k in zip(found, n) if v[:upper].tobytes() in here]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["prefix", "n"])

        counted = words.select("word").mapInArrow(run, schema(prefix=T.BinaryType(), n=T.LongType()))
        rows = counted.groupBy("prefix").agg(F.sum("n").alias("n")).collect()
        between = {}
        for r in rows:
            upper = bytes(r.prefix[:-1])
            between[upper] = between.get(upper, 0) + r.n
        large = {p for p, n in between.items() if n > most}
        cut += [p for p in between if p not in large]
        below = [(bytes(r.prefix), r.n) for r in rows if bytes(r.prefix[:-1]) in large]
        open_ = {p for p, n in below if n > most}
        cut += [p for p, n in below if n <= most]
    return sorted(cut + list(open_))


def _sent(words: DataFrame, groups: Groups, cut: list[bytes], n_parts: int) -> DataFrame:
    """Each word once as a word of its own node (kind 0) and as a sent one (kind 1) for each
    node that it reaches, dealt by node and sorted so that the node's own words come first."""
    out = schema(node=T.BinaryType(), kind=T.IntegerType(), word=T.StringType(), n=T.LongType(), vector=T.BinaryType())

    def run(batches):
        upper = CountTrie(cut)
        names = np.array(cut, object)
        for batch in batches:
            words, n = np.array(batch.column("word").to_pylist(), object), np.asarray(batch.column("n"))
            if not len(words):
                continue
            vectors = groups.vectors(list(words))
            packed = np.array([v.tobytes() for v in vectors], object)
            none = np.zeros(len(words), bool)
            for row, leaf, more, less in (
                    upper.search(vectors, none, none) if upper.levels else [(np.arange(len(words)), np.zeros(len(words), int), none, none)]):
                own = np.flatnonzero(~(more | less))
                both = np.concatenate([row, row[own]]), np.concatenate([leaf, leaf[own]])
                kind = np.repeat([1, 0], [len(row), len(own)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[both[1]], pa.binary()), pa.array(kind, pa.int32()), pa.array(words[both[0]], pa.string()),
                     pa.array(n[both[0]], pa.int64()), pa.array(packed[both[0]], pa.binary())],
                    names=["node", "kind", "word", "n", "vector"])

    sent = words.select("word", "n").mapInArrow(run, out)
    return sent.repartition(n_parts, "node").sortWithinPartitions("node", "kind")


def near_words(words: DataFrame, min_length=1) -> DataFrame:
    """word, near, near_n: each word with each word that is near to it, both ways round.

    words: word, n, one row a word, none shorter than min_length."""
    total = words.count()
    groups = _groups(words)
    cut = _cut(words, groups, total)
    n_parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(cut), 2 * NODES) // 4)
    out = schema(word=T.StringType(), near=T.StringType(), near_n=T.LongType())

    def run(batches):
        name, own, node = None, [], None
        for batch in batches:
            names, kinds = batch.column("node").to_pylist(), np.asarray(batch.column("kind"))
            starts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1] or kinds[k] != kinds[k - 1]), len(names)]
            for low, high in zip(starts, starts[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                rows = part.column("word").to_pylist(), np.asarray(part.column("n")), _vectors_of(part)
                if names[low] != name:
                    name, own, node = names[low], [], None
                if kinds[low] == 0:
                    own.append(rows)
                    continue
                if node is None:
                    node = Node(name, sum((r[0] for r in own), []), *(np.concatenate([r[k] for r in own]) for k in (1, 2)), min_length)
                    own = []
                for a, n_a, b, n_b in node.near(*rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([a, b]), pa.string()), pa.array(np.concatenate([b, a]), pa.string()),
                         pa.array(np.concatenate([n_b, n_a]), pa.int64())], names=["word", "near", "near_n"])

    return _sent(words, groups, cut, n_parts).mapInArrow(run, out)


def variant_groups(words: DataFrame, ratio=RATIO, min_length=1) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    words: word (not null, distinct), n; other columns are not read. form and form_n are
    null where no near word has ratio times the word's occurrences (ratio above 1); root is
    then the word itself. An empty table gives no rows."""
    words = words.select("word", F.col("n").cast("long").alias("n"))
    nothing = F.lit(None)
    rows = words.select("word", "n", nothing.cast("string").alias("near"), nothing.cast("long").alias("near_n")).unionByName(
        near_words(words, min_length).withColumn("n", nothing.cast("long")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    told = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = written(told.select(
        "word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    return formed.join(_roots(formed), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: each round, a word goes on to where its root leads."""
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = written(roots.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")
