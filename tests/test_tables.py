"""Comparison, runs, documents, chat, batches, generation, streaming."""

import json
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from adherence.operators import batching, chat, compare, conflicts, runs, scoring
from adherence.operators.language import LanguageModel
from adherence.operators.scoring import ScoringOptions
from adherence.plans import jobs
from adherence.session import checkpoint_dir
from adherence.sources import documents as docs, sinks
from adherence.streaming import score_stream

LEVELS = "side int, level string, category string, inst_id string, strict_pass bigint, loose_pass bigint, total bigint"


def test_comparison_rules(spark):
    rows = [
        (1, "type", "a", "a:x", 1, 2, 2), (2, "type", "a", "a:x", 1, 1, 2),  # tie, loose win
        (1, "type", "a", "a:y", 3, 3, 4),                                      # only in model 1
        (1, "type", "b", "b:z", 5009, 0, 10000), (2, "type", "b", "b:z", 5000, 0, 10000),  # 0.0009
        (1, "type", "b", "b:w", 5011, 0, 10000), (2, "type", "b", "b:w", 5000, 0, 10000),  # 0.0011
        (1, "category", "b", None, 0, 0, 0), (2, "category", "b", None, 1, 1, 1),
    ]
    levels = spark.createDataFrame(rows, LEVELS)
    strict = {r.instruction_type or r.category: r for r in compare.compare_stats(levels).collect()}
    assert strict["a:x"].winner == "tie" and strict["b:z"].winner == "tie"
    assert strict["b:w"].winner == "<- M1" and strict["b"].winner == "-> M2 wins"
    assert (strict["a:y"].model2_acc, strict["a:y"].model2_count) == (0.0, "0/0")
    loose = {r.instruction_type: r for r in compare.compare_stats(levels, use_strict=False).collect()}
    assert loose["a:x"].winner == "<- M1" and loose["a:x"].model1_count == "2/2"
    tally = {r.level: r for r in compare.wins(compare.compare_stats(levels)).collect()}
    assert (tally["type"].model1_wins, tally["type"].model2_wins, tally["type"].ties) == (2, 0, 2)


def test_conflicts_are_closed(spark):
    pairs = {(r.inst_id, r.other_id) for r in conflicts.conflicts(spark).collect()}
    assert all((b, a) in pairs for a, b in pairs)
    assert all((i, i) in pairs for i in conflicts.REGISTERED)
    assert ("startend:quotation", "combination:two_responses") in pairs
    assert ("punctuation:no_comma", "combination:two_responses") not in pairs


def test_conflicting_pairs_of_a_prompt(make_samples):
    ids = ["keywords:existence", "language:response_language", "keywords:existence", "punctuation:no_comma"]
    rows = make_samples(("x", [(i, "{}") for i in ids]))
    got = {(r.inst_id, r.other_id) for r in conflicts.conflicting_pairs(rows).collect()}
    assert got == {(ids[0], ids[1]), (ids[1], ids[0]), (ids[0], ids[0])}


def result(run, ts, lora=None, acc=0.5, **more):
    return {
        "metadata": {"model_name": "m/x", "lora_path": lora, "precision": "bf16", "run_name": run, "timestamp": ts,
                     "tasks": ["ifeval"], "eval_gpu_memory_gb": 0, **more},
        "config": {"max_seq_length": 2048, "batch_size": 8, "num_samples": 4, "generation_config": {"do_sample": False}},
        "timing": {"generation_seconds": 2.0, "scoring_seconds": 0.5, "total_seconds": 2.5},
        "results": {"ifeval": {"inst_level_strict_acc": acc, "inst_level_loose_acc": acc,
                               "prompt_level_strict_acc": acc, "prompt_level_loose_acc": 0.25}},
        "metrics_flat": {"ifeval/inst_level_strict_acc": acc},
    }


@pytest.fixture()
def results_folder(tmp_path):
    files = {
        "a.json": result("base_model", "20260101_000002", acc=0.0),
        "b.json": result("pretrained_x", "20260101_000001", acc=0.5),
        "c.json": result("base_two", "20260101_000002", acc=0.4),
        "d.json": result("tuned", "20260101_000009", lora="./lora_model/", acc=0.6),
        "e.json": {k: v for k, v in result("x", "y").items() if k != "metadata"},
        "mmlu_x_results_1.json": {
            "results": {"tinyMMLU": {"acc_norm,none": 0.64}}, "configs": {"tinyMMLU": {"metadata": {"dtype": "bfloat16"}}},
            "n-samples": {"tinyMMLU": {"effective": 100}}, "config": {"batch_size": "16", "model_dtype": "torch.bfloat16"},
            "model_name": "m/x", "total_evaluation_time_seconds": "21.75"},
    }
    for name, doc in files.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "bad.json").write_text('{"metadata": {"run_name": "x"')
    return str(tmp_path)


def test_read_results(spark, results_folder):
    rows = docs.in_time_order(docs.read_results(spark, results_folder)).collect()
    assert [r.file for r in rows] == ["e.json", "b.json", "a.json", "c.json", "d.json"]
    assert docs.read_results(spark, results_folder + "/nowhere").count() == 0


def test_run_tables(spark, results_folder):
    tables = jobs.track_job(docs.read_results(spark, results_folder))
    kinds = {r.file: (r.model_type, r.name) for r in tables["configs"].collect()}
    assert kinds["a.json"] == ("base", "base_bf16_base_model")
    assert kinds["b.json"][0] == "finetuned" and kinds["d.json"][0] == "finetuned"
    assert kinds["e.json"] == ("base", "base_unknown_unknown")
    metrics = {r.file: r.metrics for r in tables["metrics"].collect()}
    assert "eval/gpu_memory_gb" not in metrics["a.json"] and metrics["a.json"]["timing/total_seconds"] == 2.5
    report = {r.Metric: r for r in tables["base_vs_finetuned"].collect()}
    assert report["Inst Strict Acc"].Improvement == "+0.2000 (+50.0%)"  # c against d
    assert report["Prompt Loose Acc"].Improvement == "+0.0000 (+0.0%)"
    assert tables["summaries"].where("file = 'a.json'").count() == 7
    assert tables["charts"].count() == 4


def test_report_with_zero_base_and_with_one_side(spark, results_folder):
    rows = docs.read_results(spark, results_folder)
    zero = runs.base_vs_finetuned(rows.where("file in ('a.json', 'd.json')")).collect()
    assert {r.Metric: r.Improvement for r in zero}["Inst Strict Acc"] == "+0.6000"
    assert runs.base_vs_finetuned(rows.where("file in ('a.json', 'c.json')")).count() == 0


def test_mmlu(spark, results_folder):
    row = runs.mmlu_rows(docs.read_mmlu(spark, results_folder)).collect()
    assert [tuple(r) for r in row] == [("mmlu_x_1", "m/x", "bfloat16", "16", 100, 0.64, 21.75, "bfloat16")]


def test_responses_round_trip_with_both_argument_forms(spark, tmp_path):
    sample = {"key": 7, "prompt": "p", "response": "a b", "instruction_id_list": ["length_constraints:number_words"] * 3,
              "kwargs": ['{"num_words": 2, "relation": "at least"}', {"num_words": 3, "relation": "at least"}, None]}
    doc = {"config": {"model_name": "org/m", "lora_path": "./out/lora/", "precision": "bf16"},
           "metadata": {"run_name": "lora", "timestamp": "20260101_000000", "num_samples": 1}, "samples": [sample, sample]}
    (tmp_path / "run.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{")
    read = docs.read_responses(spark, f"{tmp_path}/*.json")
    assert [r.display_name for r in read.collect()] == ["lora"]
    rows = docs.samples_of(read)
    scored = jobs.score_job(spark, rows, str(tmp_path / "out"))
    assert scored.accuracy.first().num_samples == 2
    first = scored.outcomes.orderBy("sample_pos").first()
    assert [s.strict for s in first.scores[:2]] == [True, False] and first.scores[2].arg_defaulted


def test_score_job_without_a_folder(spark, make_samples):
    scored = jobs.score_job(spark, make_samples(("x", [("punctuation:no_comma", "{}")])))
    assert scored.by_level.where("level = 'overall'").first().strict_acc == 1.0
    assert all(checkpoint_dir(spark) in f for f in scored.outcomes.inputFiles())


def test_documents_and_sinks(spark, make_samples, tmp_path):
    rows = make_samples(*[("x", [("punctuation:no_comma", "{}")])] * 5).withColumns({
        "config": F.struct(F.lit("org/m").alias("model_name"), F.lit("bf16").alias("precision")),
        "metadata": F.struct(F.lit("m").alias("run_name"), F.lit("t").alias("timestamp")),
    })
    whole = sinks.responses_documents(rows).collect()
    assert [(d.document, len(d.samples)) for d in whole] == [("m_bf16_t.json", 5)]
    parts = {d.document: [s.key for s in d.samples] for d in sinks.responses_documents(rows, 218).collect()}
    assert parts == {"m_bf16_t.json": [0, 1], "m_bf16_t.1.json": [2, 3], "m_bf16_t.2.json": [4]}
    keyed = rows.select("*", F.lit("m").alias("run_name"), F.lit("bf16").alias("precision"), F.lit("t").alias("timestamp"))
    sinks.write_samples(keyed.drop("config", "metadata"), str(tmp_path / "s"))
    assert os.path.isdir(tmp_path / "s" / "run_name=m" / "precision=bf16" / "timestamp=t")
    scored = scoring.score_samples(rows, keep=("prompt", "response"))
    exchange = sinks.scored_sample_rows(scored)
    sinks.write_documents(exchange, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().scores.strict == [True]


def test_documents_written_and_read_again(spark, tmp_path):
    acc = "inst_level_strict_acc", "inst_level_loose_acc", "prompt_level_strict_acc", "prompt_level_loose_acc"
    rows = [(f"run/{n}: {n}.json", n / 10) for n in range(5)]
    docs_ = spark.createDataFrame(rows, "document string, x double").select(
        "document", F.struct(F.col("document").alias("run_name")).alias("metadata"),
        F.struct(F.struct(*[F.col("x").alias(a) for a in acc]).alias("ifeval")).alias("results")).coalesce(1)
    for _ in range(2):  # a document written again replaces itself
        sinks.write_documents(docs_, str(tmp_path / "d"))
    found = docs.read_results(spark, str(tmp_path / "d")).collect()
    assert sorted((r.file, r.metadata.run_name, r.results.ifeval.inst_level_strict_acc) for r in found) == [(n, n, x) for n, x in rows]
    sinks.write_documents(docs_.limit(1), str(tmp_path / "d"))
    assert docs.read_results(spark, str(tmp_path / "d")).count() == 5


def test_large_runs_come_in_documents_of_bounded_size(spark):
    rows = spark.range(40).select(
        F.struct(F.lit("bf16").alias("precision")).alias("config"),
        F.struct(F.lit("m").alias("run_name"), F.lit("t").alias("timestamp")).alias("metadata"),
        F.col("id").alias("sample_pos"), F.col("id").alias("key"), F.lit("p" * 50).alias("prompt"),
        F.lit("r" * 850).alias("response"), F.array(F.lit("i")).alias("instruction_id_list"), F.array(F.lit("{}")).alias("kwargs"))
    found = sinks.responses_documents(rows, bytes_per_document=10_000).collect()
    assert sorted(r.document for r in found) == sorted(["m_bf16_t.json"] + [f"m_bf16_t.{n}.json" for n in range(1, len(found))])
    assert sorted(s.key for r in found for s in r.samples) == list(range(40)) and max(len(r.samples) for r in found) <= 11
    assert [r.document for r in sinks.responses_documents(rows).collect()] == ["m_bf16_t.json"]


def test_large_runs_result_documents_come_in_parts_and_have_one_digest(spark):
    """No row holds much more than bytes_per_document; small runs stay whole, runs without samples stay; sparse places."""
    rows = [("big", (k * 7919) % 1009 * 10 ** 14 - 5 * 10 ** 16, k, "r" * (k % 90)) for k in range(300)] + [("big", None, 300, None), ("small", 1, 1, "x")]
    verdict = F.struct(F.lit(True).alias("strict"), F.lit(False).alias("loose"))
    scored = spark.createDataFrame(rows, "run_file string, sample_pos bigint, key bigint, response string").withColumn("scores", F.array(verdict))
    runs_ = spark.createDataFrame([("big",), ("small",), ("none",)], "run_file string").select(
        "run_file",
        F.struct(*[F.lit("m").alias(c) for c in ("model_name", "lora_path", "precision", "max_seq_length", "batch_size", "generation_config", "chat_template")]).alias("config"),
        F.struct(F.col("run_file").alias("run_name"), F.lit(1).alias("num_samples"), F.lit(1.0).alias("generation_time_seconds"),
                 F.lit(1.0).alias("gpu_memory_gb")).alias("metadata"))
    acc = spark.createDataFrame([("big", 0.5, 0.5, 0.5, 0.5)], "run_file string, inst_level_strict_acc double, inst_level_loose_acc double, "
                                "prompt_level_strict_acc double, prompt_level_loose_acc double")
    built = sinks.result_documents(acc, runs_, F.lit("t"), F.lit(0.5), scored, keep_run=True, bytes_per_document=3_000)
    found = {}
    for r in built.orderBy("run_file", "part").collect():
        found.setdefault(r.run_file, []).append(r)
    assert [r.document for r in found["small"]] == ["small_m_t.json"] and [s.key for s in found["small"][0].scored_samples] == [1]
    assert [(r.document, r.scored_samples) for r in found["none"]] == [("none_m_t.json", None)]
    big = found["big"]
    assert [r.document for r in big] == ["big_m_t.json"] + [f"big_m_t.{n}.json" for n in range(1, len(big))] and len(big) > 10
    assert max(sum(100 + len(s.response or "") for s in r.scored_samples) for r in big) <= 3_200
    in_order = [r[2] for r in sorted(rows[:301], key=lambda r: -10 ** 18 if r[1] is None else r[1])]
    assert [s.key for r in big for s in r.scored_samples] == in_order and all(r.results.ifeval.inst_level_strict_acc == 0.5 for r in big)
    assert [s.scores.strict for s in big[0].scored_samples][:1] == [[True]]
    content = F.array_join(F.transform("scored_samples", lambda s: F.concat_ws("|", s["key"].cast("string"), s["response"])), "~")
    parts = built.select("run_file", "part", "document", F.size("scored_samples").cast("bigint").alias("n"), content.alias("content"))
    texts = {r[2]: "|".join([str(r[2]), *([] if r[3] is None else [r[3]])]) for r in rows[:301]}
    got = {r.run_file: (r.document, r.n, r.content) for r in sinks.run_digests(parts.where("run_file <> 'none'"), "~").collect()}
    assert got == {"big": ("big_m_t.json", 301, hashlib.md5("~".join(texts[k] for k in in_order).encode()).hexdigest()),
                   "small": ("small_m_t.json", 1, hashlib.md5(b"1|x").hexdigest())}


def test_comparison_job(make_samples):
    a = scoring.score_samples(make_samples(("x", [("punctuation:no_comma", "{}")])))
    b = scoring.score_samples(make_samples(("x,", [("punctuation:no_comma", "{}"), ("startend:quotation", "{}")])))
    rows, wins, doc = jobs.compare_job(a, b, "same", "same")
    assert {r.level: (r.model1_wins, r.model2_wins, r.ties) for r in wins.collect()} == {"type": (1, 0, 1), "category": (1, 0, 1)}
    d = doc.first()
    assert (d.model1.overall, d.model2.overall, len(d.comparison)) == (1.0, 0.0, 2)
    assert d.model1.by_type["punctuation:no_comma"].total == 1


def test_comparison_straight_from_two_responses_documents(spark, make_samples, tmp_path):
    for name, text in (("a", "x"), ("b", "x,")):
        rows = make_samples((text, [("punctuation:no_comma", "{}")]), (text, [("unknown:thing", "{}")])).withColumns({
            "config": F.struct(F.lit(f"org/{name}").alias("model_name"), F.lit("bf16").alias("precision")),
            "metadata": F.struct(F.lit(name).alias("run_name"), F.lit("t").alias("timestamp")),
        })
        sinks.write_documents(sinks.responses_documents(rows), str(tmp_path / name))
    rows, _, doc = jobs.compare_responses_job(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "out"))
    found = {r.instruction_type: (r.model1_count, r.model2_count) for r in rows.where("level = 'type'").collect()}
    assert found == {"punctuation:no_comma": ("1/1", "0/1"), "unknown:thing": ("0/1", "0/1")}
    d = doc.first()
    assert (d.model1.name, d.model2.name) == ("org/a", "org/b") and set(d.model1.by_type) == {"punctuation:no_comma"}
    assert (d.model1.overall, [c.instruction_type for c in d.comparison]) == (0.5, ["punctuation:no_comma"])


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_history_rules_with_one_long_conversation(spark):
    n = 3000
    rows = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", "clear" if i % 500 == 1 else f"t{i}") for i in range(n)]
    rows += [(2, 0, "user", "a"), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, TURNS)
    kept = {(r.conv_id, r.turn) for r in chat.trim_history(df, budget=None).collect()}
    assert kept == {(1, 0)} | {(1, i) for i in range(n - 4, n)} | {(2, 0), (2, 1)}
    assert chat.trim_history(df, budget=10**6).count() == n + 2
    segments = {r.turn: r.segment for r in chat.history_segments(df, block=64).where("conv_id = 1").collect()}
    want, seen = {}, 0
    for _, turn, role, text in rows[:n]:
        seen += role == "user" and text == "clear"
        want[turn] = seen
    assert segments == want
    active = {r.turn for r in chat.active_history(df).where("conv_id = 1").collect()}
    assert active == {0} | set(range(2502, n))


def test_conversation_text_in_parts(spark):
    rows = [(1, 3, "user", "hi"), (1, 1, "system", "be kind"), (1, 5, "assistant", "hello")]
    df = spark.createDataFrame(rows, TURNS)
    plain = chat.conversation_text(df, use_chat=False).collect()
    assert [r.text for r in plain] == ["be kind\n\nhi\n\nhello"]
    whole = chat.conversation_text(df).first().text
    parts = chat.conversation_text(df, turns_per_part=2).orderBy("part").collect()
    assert len(parts) == 3 and "".join(r.text for r in parts) == whole
    assert whole.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nbe kind<|eot_id|>")


def test_late_system_messages_and_shared_turn_numbers(spark):
    rows = [(1, n, "system" if n in (0, 5) else "user", f"m{n}") for n in range(8)]
    df = spark.createDataFrame(rows, TURNS)
    for size in (1024, 4, 1):
        parts = chat.conversation_text(df, use_chat=False, turns_per_part=size).orderBy("part").collect()
        assert "\n\n".join(r.text for r in parts) == "\n\n".join(f"m{n}" for n in range(8))
    shared = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c")], TURNS)
    assert chat.trim_history(shared, budget=None).count() == 4
    assert chat.trim_history(shared, budget=1).count() == 4
    assert chat.trim_history(shared, keep_last=2, budget=None).count() == 2


def test_history_plans_read_the_turns_twice_at_most(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a")], TURNS).write.parquet(str(tmp_path / "t"))
    turns = spark.read.parquet(str(tmp_path / "t"))
    for df in (chat.trim_history(turns), chat.trim_history(turns, budget=None), chat.active_history(turns)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation ") <= 2


def test_truncation_keeps_white_space(spark):
    texts = ["a  b\n\nc\td ", "\n a\n b c", "a b", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        batching.truncate_tokens(F.col("t"), 2)).collect()]
    assert got == ["a  b", "\n a\n b", "a b", "", None]


def test_positions_and_batches(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000 * 3).alias("key")).repartition(5)
    for blocks in (2, 90, 1_000_000, None):
        some = rows.limit(20).select(F.when(F.col("key") % 2 == 0, F.col("key")).alias("key")).union(rows.limit(1)).where("true")
        for name, frame in (("key", some), ("name", some.select(F.col("key").cast("string").alias("name")))):
            found = batching.with_position(frame, name, rows_per_block=blocks).orderBy("position").collect()
            values = [r[name] for r in found]
            assert [r.position for r in found] == list(range(21))
            assert values == sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
    placed = batching.with_position(rows, "key", rows_per_block=90)
    assert [r.position for r in placed.orderBy("key").collect()] == list(range(1000))
    batches = batching.prompt_batches(rows, 64, "key", rows_per_block=90).groupBy("batch_id").count()
    assert {r["batch_id"]: r["count"] for r in batches.collect()} == {i: 64 for i in range(15)} | {15: 40}


def test_generation(spark):
    rows = spark.createDataFrame([(i, f"p{i}", ["punctuation:no_comma"], ["{}"]) for i in range(10)],
                                 "key bigint, prompt string, instruction_id_list array<string>, kwargs array<string>")
    out = jobs.generate_job(rows, lambda prompts: [f" {len(prompts)}:{p[-4:]} " for p in prompts], batch_size=4,
                            use_chat=False, limit=6).coalesce(1)
    got = {r.key: r.response for r in out.collect()}
    assert set(got) == set(range(6)) and all(r.split(":")[1] == f"p{k}" and int(r[0]) <= 4 for k, r in got.items())


def test_training_text(spark):
    rows = spark.createDataFrame([("do", " ", "out"), ("do", None, "out"), ("do", "in", "out")],
                                 "instruction string, input string, output string")
    texts = [r.text for r in jobs.training_text_job(rows).collect()]
    assert texts[0] == texts[1] and "do\n\nin<|eot_id|>" in texts[2] and texts[2].endswith("out<|eot_id|>")


@pytest.fixture(scope="module")
def language(spark):
    text = {"en": "the cat and the dog were in the house with them", "de": "der hund und die katze sind in dem haus",
            "fr": "le chat et le chien sont dans la maison"}
    return LanguageModel.fit(spark.createDataFrame([(v, k) for k, v in text.items()], "text string, lang string"))


def test_language_checks(make_samples, language, tmp_path):
    rows = make_samples(
        ("THE DOG AND THE CAT", [("change_case:english_capital", "{}")]),
        ("DER HUND UND DIE KATZE", [("change_case:english_capital", "{}")]),
        ("the dog and the cat", [("change_case:english_lowercase", "{}"), ("language:response_language", '{"language": "en"}')]),
        ("123 456", [("language:response_language", '{"language": "fi"}'), ("change_case:english_capital", "{}")]),
        ("le chat et la maison", [("language:response_language", '{"language": "fr"}')]),
    )
    language.save(str(tmp_path / "model"))
    for model in (language, LanguageModel.load(str(tmp_path / "model"))):
        got = scoring.score_samples(rows, ScoringOptions(language_model=model)).orderBy("sample_pos").collect()
        assert [[s.strict for s in r.scores] for r in got] == [[True], [False], [True, True], [False, False], [True]]
    unknown = make_samples(("le chat", [("language:response_language", '{"language": "fi"}')]))
    verdict = scoring.score_samples(unknown, ScoringOptions(language_model=language)).first().scores[0]
    assert not verdict.strict and "not in the model: fi" in verdict.error
    without = scoring.score_samples(rows, ScoringOptions(language_model=False)).first().scores[0]
    assert without.error and not without.strict


def test_stream_gives_the_batch_result(spark, make_samples, language, tmp_path):
    rows = make_samples(("a, b", [("punctuation:no_comma", "{}")]), ('{"a": 1}', [("detectable_format:json_format", "{}")]),
                        ("le chat", [("language:response_language", '{"language": "fr"}')]))
    options = ScoringOptions(language_model=language)
    rows.write.parquet(str(tmp_path / "in"))
    stream = score_stream.read_sample_stream(spark, str(tmp_path / "in"))
    query = score_stream.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), options).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(scoring.score_samples(rows, options).collect())


def test_hot_run_is_reduced_before_the_shuffle(spark, make_samples):
    """A run with most rows costs one partial row per task and type."""
    scored = scoring.score_samples(make_samples(("x", [("punctuation:no_comma", "{}")])))
    plan = compare.type_stats(scored)._jdf.queryExecution().executedPlan().toString()
    head = plan[: plan.index("Exchange")]
    assert "partial_" in plan[plan.index("Exchange"):] and "partial_" not in head
