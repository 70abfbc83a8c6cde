import hashlib
import random
from collections import defaultdict

from adherence.llm.common import WHITE_SPACE
from adherence.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    """rows: (id, text). Sorted (id, keep_id, size, kept, sha)."""
    groups = defaultdict(list)
    for doc, text in rows:
        text = text or ""
        norm = "".join(c for c in text if c not in WHITE_SPACE)
        groups[norm].append((-len(text), doc is None, doc or 0, doc))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    got = sorted((tuple(r) for r in exact_dedup(docs).collect()), key=repr)
    assert got == expected
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(e[0]) for e in expected if e[3])


def test_groups_ties_nulls_and_white_space(texts):
    check(texts(["a b", "ab", "a\tb\n", " a b", None, "", " \r\n", " ", "ä b", "äb", "x" * 200_000, "x " * 200_000]))


def test_repeated_rows_and_null_ids(texts):
    check(texts(["t", "t", "t", "u", None, None], ids=[5, 5, None, 5, None, 7]))


def test_empty_table(texts):
    assert exact_dedup(texts([])).collect() == []
    assert drop_copies(texts([])).collect() == []


def test_a_hot_group_spans_many_partitions(spark, texts):
    rng = random.Random(3)
    values = ["hot " + " " * rng.randrange(3) + "text"] * 150 + [f"word{rng.randrange(60)}" for _ in range(150)]
    rng.shuffle(values)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(texts(values, parts=5))
        check(texts(["same"] * 60, parts=5))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
