"""Benchmark decontamination by template canonicalisation.

Words lose case and surrounding punctuation; numbers, names and units become typed
placeholders, whose own values are kept as slots. Windows of eight canonical words
are hash-joined between documents and benchmark items and compared in full. Within
one (document, item, offset), a value of the item that stands for several values of the
document is in conflict: windows that hold it are dropped, unless all their slots are
the item's own. Different values may become equal. So a question with other numbers or
names is caught, and one with some of its numbers changed by its verbatim rest.

Capitals and line breaks leave open what is a name, so each window also goes by its
other readings: with a sentence start at a line break, without names, and by its own
words; an item's first word also as one inside a sentence.

A window in which placeholders outnumber the words says little, so it is joined by
its own words instead. An item shorter than a window is one window.

A pair (document, item) is reported if the windows that are left cover at least
`coverage` of the item's windows, or `run` words of it in a row.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from adherence.llm.common import schema, text_blocks, written

WINDOW = 8
COVERAGE = 0.8
RUN = 13
#: Up to so many benchmark windows their hashes (8 bytes each) travel to the tasks and
#: thin the document windows out before the join; beyond, all windows are joined.
FILTERED = 4_000_000
#: Words kept with their canonical form in a worker.
KEPT_WORDS = 200_000
#: Characters of texts taken at once.
BLOCK_CHARACTERS = 400_000

# Units of measure and currency, as written after or before a number.
UNITS = frozenset("""
mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds gram grams
kilogram kilograms ton tons ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute
minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv ma kb mb gb tb pb
byte bytes bit bits c f k percent pct usd eur gbp jpy dollar dollars cent cents euro euros meter meters metre metres
kilometer kilometers kilometre kilometres centimeter centimeters degree degrees mph kmh kph
""".split())
SIGNS = "%$€£¥°"

NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
GLUED = re.compile(r"([+-]?\d[\d.,:/]*)([^\W\d_]+|[%$€£¥°]+)")
CURRENCY = re.compile(r"([$€£¥])([+-]?\d[\d.,:/]*)")
EDGES = re.compile(rf"^[^\w+\-{SIGNS}]+|[^\w{SIGNS}]+$")

# Kinds of a canonical word.
WORD, NUM, UNIT, NAME, NOTHING, SPLIT = range(6)
_KIND_HASH = np.array([0] + [xxhash.xxh64_intdigest(f"<{k}>") for k in ("num", "unit", "name")], np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)
_OWN_WORDS = np.uint64(0xD6E8FEB86659FD93)


def split_word(raw: str) -> list[str]:
    """A number glued to its unit is two words."""
    word = EDGES.sub("", raw)
    for pattern in (GLUED, CURRENCY):
        parts = pattern.fullmatch(word)
        if parts:
            return list(parts.groups())
    return [raw]


class Forms(dict):
    """raw word -> number of its canonical form; the forms' properties lie in arrays."""

    def __init__(self):
        super().__init__()
        self.rows, self.values = [], []
        self.table = np.zeros(0, [("kind", np.int8), ("own", np.uint64), ("title", bool), ("stop", bool)])

    def __missing__(self, raw):
        # Most new words are letters, or letters and one mark: no pattern is needed.
        word = raw if raw.isalpha() else raw[:-1] if raw[-1] in ",.;:!?" and raw[:-1].isalpha() else None
        if word is not None:
            value = word.lower()
            return self.add(raw, UNIT if value in UNITS else WORD, value, word, raw[-1] in ".!?:")
        word = EDGES.sub("", raw)
        value = word.lower()
        if len(split_word(raw)) > 1:
            kind = SPLIT
        elif NUMBER.fullmatch(word):
            kind, value = NUM, word.rstrip(".,:/")
        elif not any(c.isalnum() or c in SIGNS for c in word):
            kind = NOTHING
        elif value in UNITS or all(c in SIGNS for c in word):
            kind = UNIT
        else:
            kind = WORD
        return self.add(raw, kind, value, word, bool(re.search(r"[.!?:]\W*$", raw)))

    def add(self, raw, kind, value, word, stop):
        self[raw] = at = len(self.values)
        self.values.append(value)
        title = kind == WORD and len(word) > 1 and word[0].isupper() and word[1:].islower()
        self.rows.append((kind, xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")), title, stop))
        return at

    def properties(self):
        """The table of all forms met so far."""
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, self.table.dtype)])
            self.rows = []
        return self.table


_FORMS = []


def _line_numbers(text, size):
    lines = text.splitlines() if size else []
    if len(lines) < 2:
        return np.zeros(size, np.int64)
    return np.repeat(np.arange(len(lines)), [len(line.split()) for line in lines])


def templates(kinds, own):
    return np.where(kinds == WORD, own, _KIND_HASH[np.where(kinds == WORD, 0, kinds)])


class Canonical:
    """The canonical words of several texts, one after another: kinds, join hashes as a
    template and as they are, and the number of words of each text."""

    def __init__(self, texts: list[str]):
        if not _FORMS or len(_FORMS[0]) > KEPT_WORDS:
            _FORMS[:] = [Forms()]  # a worker keeps a bounded table
        self.forms = forms = _FORMS[0]
        lists = [text.split() for text in texts]
        lines = [_line_numbers(text, len(words)) for text, words in zip(texts, lists)]
        ids = [np.fromiter(map(forms.__getitem__, words), np.int64, len(words)) for words in lists]
        table = forms.properties()
        for k, words in enumerate(lists):
            if (table["kind"][ids[k]] == SPLIT).any():
                parts = [part for w in words for part in split_word(w)]
                ids[k] = np.fromiter(map(forms.__getitem__, parts), np.int64, len(parts))
                lines[k] = np.repeat(lines[k], [len(split_word(w)) for w in words])
        del lists
        table = forms.properties()
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        there = table["kind"][flat] != NOTHING
        self.ids, owner = flat[there], owner[there]
        line = (np.concatenate(lines) if lines else np.zeros(0, np.int64))[there]
        self.sizes = np.bincount(owner, minlength=len(texts))
        rows = table[self.ids]
        kinds = rows["kind"].copy()
        # A name stands inside a sentence; a text's first word does not.
        after = np.zeros(len(kinds), bool)
        after[1:] = (owner[1:] == owner[:-1]) & ~rows["stop"][:-1]
        title = rows["title"]
        kinds[title & after] = NAME
        inside = np.zeros(len(kinds), bool)
        inside[1:] = (owner[1:] == owner[:-1]) & (line[1:] == line[:-1])
        first = np.ones(len(kinds), bool)
        first[1:] = owner[1:] != owner[:-1]
        # A unit is one only beside a number of the same text.
        number, same = kinds == NUM, owner[1:] == owner[:-1]
        beside = np.zeros(len(kinds), bool)
        beside[1:] |= number[:-1] & same
        beside[:-1] |= number[1:] & same
        kinds[(kinds == UNIT) & ~beside] = WORD
        self.kinds, self.own = kinds, rows["own"]
        self.template = templates(kinds, self.own)
        # The same words read in other ways: a line break starts a sentence, the text's first
        # word stands inside one, capitals say nothing, every word is itself.
        named = (kinds == WORD) | (kinds == NAME)

        def read(names):
            return np.where(named, np.where(names, NAME, WORD), kinds).astype(kinds.dtype)

        self.readings = [read(title & after & inside), read(np.zeros(len(kinds), bool)), np.zeros_like(kinds)]
        self.first_readings = [read(title & (after | first)), read(title & ((after & inside) | first))]

    def value(self, k: int) -> str:
        return self.forms.values[self.ids[k]]


def window_hashes(kinds, template, own, length):
    """The join keys of all windows of a length, and which of them are templates."""
    n = len(kinds) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    words = np.concatenate(([0], np.cumsum(kinds == WORD)))
    is_template = 2 * (words[length:] - words[:-length]) >= length
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += template[j: j + n] * _POWERS[j]
    few = np.flatnonzero(~is_template)
    if len(few):
        raw = np.zeros(len(few), np.uint64)
        for j in range(length):
            raw += own[few + j] * _POWERS[j]
        total[few] = raw ^ _OWN_WORDS
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29)), is_template


def other_hashes(base, kinds, own, length):
    """(places, join keys, which are templates) of the windows that another reading changes."""
    n = len(kinds) - length + 1
    differ = np.concatenate(([0], np.cumsum(base != kinds)))
    at = np.flatnonzero(differ[length:] != differ[:-length]) if n > 0 else np.zeros(0, np.int64)
    template, plain = templates(kinds, own), np.concatenate(([0], np.cumsum(kinds == WORD)))
    words = plain[at + length] - plain[at]
    is_template = 2 * words >= length
    total, raw = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(length):
        total += template[at + j] * _POWERS[j]
        raw += own[at + j] * _POWERS[j]
    total = np.where(is_template, total, raw ^ _OWN_WORDS)
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return at, total ^ (total >> np.uint64(29)), is_template


def window_row(texts: Canonical, kinds, at, length, is_template):
    """(canonical text, slots) of one window."""
    names = {NUM: "<num>", UNIT: "<unit>", NAME: "<name>"}
    words, slots = [], []
    for k in range(at, at + length):
        kind = int(kinds[k])
        if is_template and kind != WORD:
            words.append(names[kind])
            slots.append(names[kind] + texts.value(k))
        else:
            words.append(texts.value(k))
    return " ".join(words), slots


_WINDOW_FIELDS = [
    ("pos", pa.int32()), ("length", pa.int32()), ("hash", pa.int64()), ("canonical", pa.string()),
    ("slots", pa.list_(pa.string())), ("reading", pa.int32()),
]


def _windows(id_type, wanted, lengths):
    """Windows of every text. wanted: a broadcast of sorted hashes to thin them out by,
    or None; lengths: the window lengths to make, or None for an item's own one."""
    out = pa.schema([("id", id_type), *_WINDOW_FIELDS, ("windows", pa.int32()), ("words", pa.int32())])

    def block_rows(ids, texts, allowed):
        words = Canonical(texts)
        ends = np.cumsum(words.sizes)
        firsts = ends - words.sizes
        owner = np.repeat(np.arange(len(texts)), words.sizes)
        rows, owners = [], []
        for length in lengths if lengths is not None else sorted({min(int(n), WINDOW) for n in words.sizes if n}):
            for reading, kinds in enumerate([words.kinds, *words.readings, *(words.first_readings if lengths is None else [])]):
                if reading:
                    places, hashes, is_template = other_hashes(words.kinds, kinds, words.own, length)
                else:
                    hashes, is_template = window_hashes(kinds, words.template, words.own, length)
                    places = np.arange(len(hashes))
                hits = np.arange(len(hashes))
                if allowed is not None:
                    found = np.searchsorted(allowed, hashes)
                    found[found == len(allowed)] = 0
                    hits = np.flatnonzero(allowed[found] == hashes)
                hits = hits[places[hits] + length <= ends[owner[places[hits]]]]
                if lengths is None:
                    hits = hits[np.minimum(words.sizes[owner[places[hits]]], WINDOW) == length]
                for h in hits.tolist():
                    p = int(places[h])
                    k, n = int(owner[p]), int(words.sizes[owner[p]])
                    text, slots = window_row(words, kinds, p, length, is_template[h])
                    rows.append((p - int(firsts[k]), length, int(hashes[h].astype(np.int64)), text, slots,
                                 int(reading > 0), n - length + 1, n))
                    owners.append(k)
        if rows:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owners, pa.int64()))]
                + [pa.array(c, f.type) for c, f in zip(columns, list(out)[1:])], schema=out)

    def run(batches):
        allowed = wanted.value if wanted is not None else None
        for batch in batches:
            for first, texts in text_blocks(batch.column("text"), BLOCK_CHARACTERS):
                rows = block_rows(batch.column("id").slice(first, len(texts)), texts, allowed)
                if rows is not None:
                    yield rows

    return run


def _window_table(df, id_col, text_col, wanted, lengths):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    out = schema(
        id=kind, pos=T.IntegerType(), length=T.IntegerType(), hash=T.LongType(), canonical=T.StringType(),
        slots=T.ArrayType(T.StringType()), reading=T.IntegerType(), windows=T.IntegerType(), words=T.IntegerType())
    texts = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return texts.mapInArrow(_windows(to_arrow_type(kind), wanted, lengths), out)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                 item_text_col="text", coverage=COVERAGE, run=RUN, filtered=FILTERED) -> DataFrame:
    """One row per (document, item) that match: doc_id, item_id, windows_matched,
    windows_total, coverage, words_in_a_row, reparameterised (some slot differs).

    Null and empty texts, and texts without a word, match nothing. Rows that repeat
    an id count as one document or item with the windows of all of them. Null ids
    are an id like any other. Other columns are not read; empty tables give no rows."""
    spark = docs.sparkSession
    items = written(_window_table(benchmark, item_col, item_text_col, None, None), "benchmark-windows")
    size = items.count()
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most WINDOW values
    wanted = None
    if size <= filtered:
        hashes = np.array([r[0] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes) if len(hashes) else np.zeros(1, np.uint64))
    found = _window_table(docs, id_col, text_col, wanted, lengths)
    found = found.select(F.col("id").alias("doc"), F.col("pos").alias("doc_pos"), "length", "hash", "canonical",
                         F.col("slots").alias("doc_slots"), F.col("reading").alias("doc_reading"))
    item_windows = items.select(
        F.col("id").alias("item"), F.col("pos").alias("item_pos"), "length", "hash", "canonical",
        F.col("slots").alias("item_slots"), F.col("reading").alias("item_reading"), "windows", "words")
    matches = found.join(item_windows, ["hash", "length", "canonical"])
    # Per offset: the item's windows with their slots and what stands there in the document,
    # bounded by the item's length.
    slots = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    window = F.struct(F.col("item_pos").alias("pos"), slots.alias("slots"))
    as_read = (F.col("doc_reading") == 0) & (F.col("item_reading") == 0)
    offsets = matches.groupBy("doc", "item", (F.col("doc_pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set(window).alias("all"), F.collect_set(F.when(as_read, window)).alias("own"),
        F.max("windows").alias("windows"), F.max("length").alias("length"),
    )
    # Other readings add windows; where their slots are in conflict with the windows as they
    # are, these still count by themselves.
    for name in ("all", "own"):
        offsets = _without_conflicts(offsets, name)
    pairs = offsets.select("doc", "item", "windows", "length", F.concat("all", "own").alias("kept")).where(F.size("kept") > 0)
    changed = F.exists("kept", lambda w: F.exists(w["slots"], lambda s: s["i"] != s["d"]))
    pairs = pairs.groupBy("doc", "item").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("kept", lambda w: w["pos"]))))).alias("positions"),
        F.max("windows").alias("windows_total"), F.max("length").alias("length"), F.max(changed).alias("reparameterised"),
    )
    longest = F.expr(
        "aggregate(positions, named_struct('last', -2, 'len', 0, 'best', 0),"
        " (a, p) -> named_struct('last', p, 'len', if(p = a.last + 1, a.len + 1, 1),"
        " 'best', greatest(a.best, if(p = a.last + 1, a.len + 1, 1))), a -> a.best)")
    pairs = pairs.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"),
        F.size("positions").alias("windows_matched"), "windows_total",
        (F.size("positions") / F.col("windows_total")).alias("coverage"),
        (longest + F.col("length") - 1).alias("words_in_a_row"), "reparameterised",
    )
    return pairs.where((F.col("coverage") >= coverage) | (F.col("words_in_a_row") >= run))


def _without_conflicts(offsets: DataFrame, name) -> DataFrame:
    """The windows of column `name` whose slots are the item's own, or hold no value that
    stands for several."""
    slots = F.array_sort(F.array_distinct(F.flatten(F.transform(name, lambda w: w["slots"]))))
    sorted_ = offsets.withColumn("_slots", slots)
    twice = F.filter("_slots", lambda s, k: s["i"] == F.get("_slots", k + 1)["i"])
    found = sorted_.withColumn("_conflicts", F.array_distinct(F.transform(twice, lambda s: s["i"])))
    kept = F.filter(name, lambda w: F.forall(w["slots"], lambda s: s["i"] == s["d"])
                    | ~F.exists(w["slots"], lambda s: F.array_contains("_conflicts", s["i"])))
    return found.withColumn(name, kept).drop("_slots", "_conflicts")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """The rows of docs that match no benchmark item, all columns as they came."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("bad_id")).distinct()
    bad = written(bad, "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad.bad_id), "left_anti")
