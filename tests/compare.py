"""Runs registered queries against their SQL and reports rows that differ.

    python tests/compare.py [--sf 0.01] [name ...]
"""

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (bool, int)):
        return round(float(value), 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(df, con, statement):
    """(Spark rows, SQL rows, rows only in Spark, rows only in SQL, type notes)."""
    cur = con.execute(statement)
    names = [d[0] for d in cur.description]
    expected = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return len(got), len(expected), [f"columns {sorted(df.columns)}"], [f"columns {sorted(names)}"]
    from collections import Counter
    a, b = Counter(got), Counter(expected)
    return len(got), len(expected), list((a - b).elements()), list((b - a).elements())


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--after", help="start behind this query")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from adherence.session import local_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(cpus=8), connect(sf_dir)
    oracles, bad = oracle_sql(), []
    todo = list(queries().items())
    if args.after:
        todo = todo[[n for n, _ in todo].index(args.after) + 1:]
    for name, run in todo:
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name not in oracles:
                print(f"{name}: rows only, {df.count()} ({time.time() - start:.1f}s)", flush=True)
                continue
            n, m, left, right = differences(df, con, oracles[name])
        except Exception as problem:  # report and go on with the next query
            print(f"{name}: FAILED {type(problem).__name__} {str(problem)[:900]}", flush=True)
            bad.append(name)
            continue
        ok = not left and not right
        print(f"{name}: {'ok' if ok else 'DIFFERS'} {n}/{m} rows ({time.time() - start:.1f}s)", flush=True)
        if not ok:
            bad.append(name)
            for side, rows in (("spark", left), ("sql", right)):
                for r in rows[:4]:
                    print(f"    {side}: {r[:400]}")
    print("bad:", bad)
