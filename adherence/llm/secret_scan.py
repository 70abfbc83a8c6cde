"""Secret scans judged by corpus-wide ownership frequency.

Candidates are found per row with SQL's regular expressions; their positions come
from the lengths of the pieces between the matches. Hashes of the candidates' values
are aggregated over the corpus by distinct owners, and by distinct repositories where the
rows name theirs: what many hold is a copied example, what one owner holds looks live. Three base kinds are
always reported; opaque runs (long, with letters and digits, no base value) are
added where the frequency says that one owner holds them.

DataFrame functions only. Candidates are written once, as short rows without texts;
a value that a third of all documents hold is reduced on the map side.
"""

from pyspark.sql import Column, DataFrame, functions as F

from adherence.llm.common import written

# The contract's patterns and lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 16
# The contract's [0-9a-f]+ with 32 or more characters: a match is a whole run either way.
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "opaque")
#: An opaque run; an assignment before it takes its characters.
OPAQUE_LENGTH = 20
OPAQUE = ASSIGN + r"|([A-Za-z0-9+/_-]{%d,})" % OPAQUE_LENGTH
#: A value with at least so many distinct owners, or named repositories, is a copied example.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 10
#: Matches whose lengths are added up at once.
BLOCK = 256

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Matches of a pattern as (start, kind, end, value); value is the group's text,
    matches whose value is shorter than `least` are dropped. Code points, end exclusive."""
    lit = F.lit(pattern)
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    values = F.regexp_extract_all(text, lit, F.lit(group)) if group else whole
    pieces = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, m: F.struct(
            F.char_length(b).alias("gap"), F.char_length(m).alias("long"))),
        values, lambda p, v: F.struct(p["gap"].alias("gap"), p["long"].alias("long"), v.alias("value")))

    def total(part):
        return F.aggregate(part, F.lit(0), lambda s, p: s + p["gap"] + p["long"])

    def located(items):
        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(
            acc, F.array(F.element_at(acc, -1) + total(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))))

        def one(p, i, before):
            inside = total(F.slice(items, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
            start = F.get(before, F.floor(i / BLOCK).cast("int")) + inside + p["gap"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"),
                            (start + p["long"]).alias("end"), p["value"].alias("value"))

        return let(offsets, lambda before: F.transform(items, lambda p, i: one(p, i, before)))

    found = F.when(text.rlike(pattern), let(pieces, located)).otherwise(F.array().cast(_SPANS))
    return F.filter(found, lambda s: F.char_length(s["value"]) >= least)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start, then kind."""
    return F.array_sort(F.concat(
        spans(text, ASSIGN, 0, 2, ASSIGN_LENGTH), spans(text, ACCESS, 1, 0, ACCESS_LENGTH), spans(text, HEX, 2, 0, 32)))


def opaque_spans(text: Column) -> Column:
    """Runs outside assignments that hold letters and digits and no base value."""
    return F.filter(spans(text, OPAQUE, 3, 3, OPAQUE_LENGTH), lambda s: (
        s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        & ~s["value"].rlike(HEX) & ~s["value"].rlike(r"AKIA[A-Z0-9]{12,}")))


def hashed(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.md5(s["value"]).alias("hash")))


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repository_col=None,
         copied_owners=COPIED_OWNERS, copied_repositories=COPIED_REPOSITORIES) -> DataFrame:
    """One row per input row: doc_id, base and added spans (start, kind, end, hash), and
    how many of the base spans are live-looking and how many copied.

    Without a repository column only distinct owners decide, so copies of one owner's
    document never make its secret an example. Null texts count as empty; a null owner or
    repository is one of its own. Rows that repeat an id each get a row. Other columns are
    not read; an empty table gives no rows."""
    text = F.coalesce(docs[text_col], F.lit(""))
    found = written(docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"),
        F.coalesce(docs[owner_col].cast("string"), F.lit("\0")).alias("owner"),
        *([F.coalesce(docs[repository_col].cast("string"), F.lit("\0")).alias("repository")] if repository_col else []),
        hashed(base_spans(text)).alias("base"), hashed(opaque_spans(text)).alias("runs"),
    ), "secret-spans")
    holders = [c for c in ("owner", "repository") if c in found.columns]
    limits = dict(owner=copied_owners, repository=copied_repositories)
    candidates = found.select("row", *holders, F.explode(F.concat("base", "runs")).alias("c"))
    counts = candidates.groupBy(F.col("c.hash").alias("hash")).agg(*[F.count_distinct(h).alias(h) for h in holders])
    copied = F.greatest(*[F.col(h) >= limits[h] for h in holders], F.lit(False))
    frequency = written(counts.select("hash", copied.alias("copied")), "secret-frequency")
    judged = candidates.select("row", "c.*").join(frequency, "hash")
    opaque = F.col("kind") == KINDS.index("opaque")
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(opaque & ~F.col("copied"), F.struct("start", "kind", "end", "hash"))).alias("added"),
        F.count_if(~opaque & ~F.col("copied")).alias("n_live"), F.count_if(~opaque & F.col("copied")).alias("n_copied"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string>>")
    return found.join(per_row, "row", "left").select(
        "doc_id", "base", F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns of scan's rows."""
    def of_kind(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return scanned.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied")
