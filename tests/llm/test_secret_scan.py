import hashlib
import random
import re
from collections import defaultdict

from adherence.llm import secret_scan

RAW = {
    0: (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    1: (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    2: (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute(rows, owners_limit=3, repositories_limit=10, named=False):
    """rows: (id, text, owner). The contract's columns. named: the ids name repositories."""
    opaque = re.compile(RAW[0][0].pattern + r"|([A-Za-z0-9+/_-]{20,})", re.A)
    owners, repositories, found = defaultdict(set), defaultdict(set), []
    for doc, text, owner in rows:
        text = text or ""
        base = [(m.start(), k, m.end(), m.group(g)) for k, (p, g, least) in RAW.items() for m in p.finditer(text)
                if len(m.group(g)) >= least]
        runs = [(m.start(), 3, m.end(), m.group(3)) for m in opaque.finditer(text) if m.group(3)
                and re.search("[0-9]", m.group(3)) and re.search("[A-Za-z]", m.group(3))
                and not re.search("[0-9a-f]{32,}", m.group(3)) and not re.search("AKIA[A-Z0-9]{12,}", m.group(3))]
        found.append((doc, sorted(base), runs))
        for *_, value in base + runs:
            owners[value].add(owner)
            repositories[value].add(doc)
    copied = {v for v in owners if len(owners[v]) >= owners_limit or named and len(repositories[v]) >= repositories_limit}
    names = secret_scan.KINDS
    text_of = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in spans)
    return sorted(((
        doc, *(sum(1 for b in base if b[1] == k) for k in range(3)), hashlib.sha256(text_of(base).encode()).hexdigest(),
        text_of(sorted(base + [r for r in runs if r[3] not in copied])),
        sum(1 for b in base if b[3] not in copied), sum(1 for b in base if b[3] in copied)) for doc, base, runs in found), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, row int, base int").repartition(3)
    got = secret_scan.digests(secret_scan.scan(docs))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_edge_rows(spark):
    key, run = "AKIA" + "Z9" * 8, "ab12" * 7 + "Zz"
    rows = [
        (0, None, "a"), (1, "", "a"), (2, "password = hunter2", "a"), (3, 'é𝄞 "API_KEY": "abcdefgh12"', "b"),
        (4, f"token=secret: abcdefgh12 {key} {key}AKIA", None), (5, "0123456789abcdef" * 4 + "g" + "0" * 32, "c"),
        (5, "0123456789abcdef" * 4 + "g" + "0" * 32, "c"), (None, f"x {run} y", "d"), (7, "a" * 100_000, "e"),
        (8, "passwd:   'topsecret99' Token:tok_12345678", "e"), (9, f"AKIA{'1' * 11} {run} secret={run}", "f"),
        (10, "tokentoken==abcdefgh password password: 12345678", "f"),
    ]
    check(spark, rows)


def test_many_matches_and_copied_values(spark):
    rng = random.Random(6)
    example = "token = EXAMPLE1EXAMPLE2"
    rows = [(k, f"{example} own {rng.getrandbits(128):032x} and {rng.getrandbits(90):x}Q0Q0Q0Q0Q0Q0", f"src{k % 4}") for k in range(40)]
    rows.append((99, " ".join(f"key {rng.getrandbits(128):032x} password={k:09d}é" for k in range(1500)), "src9"))
    check(spark, rows)


def test_only_owners_decide_without_repositories(spark):
    """A key that one owner holds in many documents looks live; named repositories count."""
    rows = [(k, f"leaked QWERTYqwerty1234567890{'' if k % 2 else ' token=livelive99'}", "one") for k in range(30)]
    check(spark, rows)
    assert all("opaque" in r[5] and r[7] == 0 for r in brute(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secret_scan.digests(secret_scan.scan(docs, repository_col="doc_id"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, named=True)
    assert all("opaque" not in r[5] for r in brute(rows, named=True))


def test_random_texts(spark):
    rng = random.Random(8)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH12345678",
             "deadbeef" * 4, "abcdef12", "é", "\n", "x.y-z", "hunter2hunter2", "passwd"]
    check(spark, [(k, "".join(rng.choices(parts, k=rng.randint(0, 25))), f"s{k % 5}") for k in range(300)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secret_scan.digests(secret_scan.scan(docs)).collect() == []
