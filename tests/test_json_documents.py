"""Documents of any size: written as one file a run, read in byte ranges by many tasks."""

import io
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adherence.operators import scoring
from adherence.operators.checks import Registry, default_registry
from adherence.schemas import SAMPLES
from adherence.sources import documents as docs, json_documents as jd, sinks

NASTY = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", ",", ":", "é", "字", "😀", "\n", "\t", "a", "samples", '"samples": [{']


def depths(data: bytes):
    """Byte by byte: (inside a string, depth after it)."""
    inside, escaped, depth, out = False, False, 0, []
    for b in data:
        c = chr(b)
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        else:
            depth += (c in "{[") - (c in "}]")
        out.append((inside, depth))
    return out


def text(rng):
    return "".join(rng.choices(NASTY, k=rng.randint(0, 12)))


def document(rng, n):
    return {"config": {"model_name": "org/" + text(rng), "lora_path": None, "precision": "fp16", "generation_config": {"top_k": 3}},
            "metadata": {"run_name": "r", "timestamp": "t", "num_samples": n},
            "samples": [{"key": k, "prompt": text(rng), "response": text(rng), "instruction_id_list": ["a:b", text(rng)],
                         "kwargs": ["{}", json.dumps({"keywords": [text(rng)]})]} for k in range(n)]}


def test_scan_from_any_place():
    rng = random.Random(1)
    for _ in range(30):
        data = json.dumps(document(rng, 3), ensure_ascii=rng.random() < 0.5).encode()
        truth = depths(data)
        for _ in range(10):
            start = rng.randrange(len(data))
            inside, depth = truth[start - 1] if start else (False, 0)
            slashes = len(data[:start]) - len(data[:start].rstrip(b"\\"))
            scan = jd.Scan(data[start:], slashes, int(inside), depth)
            assert scan.depth.tolist() == [d for _, d in truth[start:]]
            quotes, outside, within = jd.Scan(data[start:], slashes).summary()
            assert (outside, within)[int(inside)] == truth[-1][1] - depth and (quotes + inside) % 2 == 0


@pytest.mark.parametrize("size,indent", [(31, None), (200, 2), (1 << 20, None)])
def test_read_against_the_json_module(spark, tmp_path, size, indent):
    rng, expected = random.Random(size), {}
    for k, n in enumerate([0, 1, 3 if size < 100 else 25]):
        doc = document(rng, n)
        (tmp_path / f"d{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(k)), encoding="utf-8")
        expected[f"d{k}.json"] = doc
    runs, samples = docs.read_runs(spark, str(tmp_path), bytes_per_range=size)
    assert {r.file: r.config.model_name for r in runs.collect()} == {f: d["config"]["model_name"] for f, d in expected.items()}
    got = {(r.run_file, r.sample_pos): (r.key, r.prompt, r.response, r.instruction_id_list, r.kwargs) for r in samples.collect()}
    assert got == {(f, k): tuple(s.values()) for f, d in expected.items() for k, s in enumerate(d["samples"])}


def test_malformed_documents_are_left_out(spark, tmp_path):
    good = json.dumps(document(random.Random(2), 2))
    bad = {"cut": good[:-3], "quote": good.replace('"r"', '"r'), "empty": "", "text": "[not json", "list": "[]",
           "null": good.replace('"samples": [', '"samples": [null, '), "word": good.replace('"samples": [', '"samples": [3, '),
           "string": good.replace('"samples": [', '"samples": ["x", '), "inner": good.replace('"key": 1', '"key" 1'),
           "array": good.replace('"samples": [', '"samples": [[], '), "head": good.replace('"metadata":', '"metadata"')}
    for name, content in {**bad, "good": good, "nosamples": '{"config": {"model_name": "m"}}'}.items():
        (tmp_path / f"{name}.json").write_text(content)
    runs, samples = docs.read_runs(spark, str(tmp_path), bytes_per_range=120)
    assert sorted(r.file for r in runs.collect()) == ["good.json", "nosamples.json"]
    assert sorted((r.run_file, r.sample_pos) for r in samples.collect()) == [("good.json", 0), ("good.json", 1)]
    runs, samples = docs.read_runs(spark, str(tmp_path / "missing"))
    assert runs.collect() == [] and samples.collect() == []


def run_rows(spark, rows):
    config = F.struct(F.lit("m").alias("model_name"), F.lit(None).cast("string").alias("lora_path"), F.lit("fp16").alias("precision"))
    metadata = F.struct(F.col("run_file").alias("run_name"), F.lit("t").alias("timestamp"))
    return spark.createDataFrame(rows, SAMPLES).withColumn("config", config).withColumn("metadata", metadata)


def test_one_run_stays_one_run(spark, tmp_path):
    """Any size, any order of the rows; writing again replaces; a run without samples has its document."""
    rng = random.Random(5)
    rows = [("big" if k % 3 else f"run{k % 2}", k, k, text(rng), text(rng), ["punctuation:no_comma"], [text(rng)]) for k in range(300)]
    samples = run_rows(spark, rows).repartition(5)
    for _ in range(2):
        sinks.write_responses(samples, str(tmp_path / "out"), run_rows(spark, [("none", 0, 0, "", "", [], [])]).select("config", "metadata"))
    assert sorted(os.listdir(tmp_path / "out")) == [f"{n}_fp16_t.json" for n in ("big", "none", "run0", "run1")]
    for name in ("big", "run0", "none"):
        doc = json.loads((tmp_path / "out" / f"{name}_fp16_t.json").read_text())
        assert [s["key"] for s in doc["samples"]] == [r[1] for r in sorted(rows) if r[0] == name] and doc["config"]["lora_path"] is None
    runs, again = docs.read_runs(spark, str(tmp_path / "out"), bytes_per_range=4_000)
    assert runs.count() == 4
    registry = Registry([default_registry()["punctuation:no_comma"]])
    accuracy = lambda s: sorted((r.run_file.split("_")[0], r.num_samples, r.inst_strict_pass) for r in scoring.accuracy(
        scoring.score_samples(s, scoring.ScoringOptions(registry=registry))).collect())
    assert accuracy(again) == accuracy(samples.drop("config", "metadata"))


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    one = json.dumps({"key": 1, "prompt": "p" * 200, "response": 'r"\\{' * 200, "instruction_id_list": [], "kwargs": []})
    with open(tmp_path / "large.json", "w") as out:
        out.write('{"config": {"model_name": "m"}, "metadata": {}, "samples": [' + ", ".join([one] * 15_000) + "]}")
    size = os.path.getsize(tmp_path / "large.json")
    _, samples = docs.read_runs(spark, str(tmp_path), bytes_per_range=1 << 20)
    got = samples.agg(F.count("*").alias("n"), F.max("sample_pos").alias("last"), F.count_distinct("sample_pos").alias("places"),
                      F.count_distinct("response").alias("texts")).first()
    assert size > 20_000_000 and tuple(got) == (15_000, 14_999, 15_000, 1)
    assert samples.select(F.spark_partition_id()).distinct().count() >= 2


def test_elements_without_a_head_fail_and_leave_nothing(spark, tmp_path):
    heads = spark.createDataFrame([("a", "{}")], "document string, head string")
    elements = spark.createDataFrame([("a", 0, "{}"), ("b", 0, "{}"), (None, 0, "{}")], "document string, pos long, element string")
    with pytest.raises(Exception, match="no head"):
        jd.write_documents(heads, elements, str(tmp_path / "out"), "samples")
    assert os.listdir(tmp_path / "out") == []
    jd.write_documents(heads, elements.where("document = 'a'"), str(tmp_path / "out"), "samples")
    assert json.loads((tmp_path / "out" / "a").read_text()) == {"samples": [{}]}
    assert np.all([f == "a" for f in os.listdir(tmp_path / "out")])


def test_small_ranges_do_not_make_small_tasks(spark, tmp_path):
    doc = document(random.Random(7), 200)
    (tmp_path / "d.json").write_text(json.dumps(doc))
    size = os.path.getsize(tmp_path / "d.json")
    _, elements = jd.read_documents(spark, str(tmp_path), "samples", bytes_per_range=100)
    assert size > 100 * 3 * jd.LEAST_TASKS
    written = {os.path.dirname(f) for f in elements.inputFiles() if "/elements-" in f}
    files = [f for f in elements.inputFiles() if os.path.dirname(f) in written]
    assert len(written) == 1 and len(set(files)) <= jd.LEAST_TASKS
    assert [json.loads(r.element)["key"] for r in elements.orderBy("pos").collect()] == list(range(200))
    assert jd._tasks(120_000, 12 << 30) == (12 << 30) // jd.BYTES_PER_TASK and jd._tasks(3, 12 << 30) == 3


class CountedFile(io.BytesIO):
    n = 0

    def read(self, size=-1):
        data = super().read(size)
        self.n += len(data)
        return data


@pytest.mark.parametrize("length", [10, 20_000, 3_000_000])
def test_little_is_read_behind_a_range(length):
    element = json.dumps({"key": 1, "response": 'r"\\{' * (length // 4)}).encode()
    file = CountedFile(b"[" + b", ".join([element] * 2 + [b"{}"] * 2_000_000) + b"]")
    begun, last = len(element) // 3, file.getbuffer().nbytes
    assert jd._whole(file, element[:begun], 1 + begun, last) == element
    assert file.n <= 3 * len(element) + 2 * jd.FIRST_STEP
