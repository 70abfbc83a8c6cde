"""run() against a plain version of every stage."""

import hashlib
import random
import struct

import public_tokenizers as vocabularies

import corpus_pipeline
from adherence.llm import bpe
from tests.llm.test_bpe import RANKS, encode_matches
from tests.llm.test_exact_dedup import brute as exact_groups
from tests.llm.test_simhash import brute_components, brute_print

WORDS = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "m")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(12)
    sentence = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [sentence(20) for _ in range(3)]
    texts = [sentence(rng.randint(30, 80)) for _ in range(14)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + "\n", None, "", "123 456 !", "1 a"]
    texts += [t.replace(" ", " , ", 1) for t in texts[2:4]] + [texts[4].upper()]
    texts += [f"{sentence(15)} {items[0]} {sentence(15)}", f"{items[1]}", f"{sentence(9)} {items[2][:40]}"]
    return [(k, t, "en" if k % 2 else "de", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], items


def expected(rows, items):
    rows = [(d, t) for d, t, *_ in rows if any(c.isalpha() for c in t or "")]
    kept = {doc for doc, keep, _, first, _ in exact_groups(rows) if first}
    rows = [r for r in rows if r[0] in kept]
    kept = {doc for doc, _, root in brute_components([(d, brute_print(t)) for d, t in rows]) if doc == root}
    rows = [r for r in rows if r[0] in kept]
    rows = [(d, t) for d, t in rows if not any(i in " ".join(t.lower().split()) for i in items)]
    encoder, out = bpe.encoder(RANKS, vocabularies.PATTERN), []
    for d, t in rows:
        ids = encode_matches(encoder, t)
        out.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                    hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_whole_run(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == expected(rows, items)
    assert len(rows) > len(got) > 10


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_with_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    """Columns that the operators use inside; each stage's rows by its docstring."""
    rng = random.Random(3)
    sentence = lambda n: " ".join(rng.choices(WORDS, k=n))
    one, two, item, long = sentence(40), sentence(40), sentence(20), sentence(20_000)
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, one), (1, one), (2, one + "  "), (None, two), (4, None), (5, ""), (6, long), (7, f"{two} {item}"), (8, sentence(40))]
    kind = "doc_id long, text string, lang string, row string, judged int, fp string, digest string, part int, component_id long, keep_id long"
    docs = spark.createDataFrame([(*r, "en", "x", 1, "y", "z", 2, 3, 4) for r in rows], kind)
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id for r in out.collect()), key=repr)
    assert set(kept["language_id"]) >= {1, 2, None, 6, 8} and not {4, 5} & set(kept["language_id"])
    assert kept["exact_dedup"] == sorted([2, None, 4, 6, 7, 8], key=repr)
    assert kept["simhash_near_dedup"] == sorted([1, 1, None, 4, 6, 7, 8], key=repr)
    assert kept["benchmark_decontamination"] == sorted([1, 1, 2, None, 4, 5, 6, 8], key=repr)
    assert len(stages["byte_bpe"](spark, docs, str(tmp_path)).collect()) == len(rows)
