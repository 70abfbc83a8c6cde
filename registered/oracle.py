"""SQL for the checking engine, one statement per registered query it can express."""

import re

from registered import check_sql as c
from registered import expected as k
from registered import fixture as f
from registered.check_sql import lit, strip
from registered.expected import TEMPLATES

SEED = 42


def check(inst_id):
    passes, failed, drawn = c.CHECKS[inst_id]
    needs_language = inst_id in c.LANGUAGE_CHECKS
    base = f.check_samples_sql(inst_id, "duckdb")
    rows = f"""SELECT run_file, sample_pos, response AS v, {c.parsed('kwargs[1]')} AS j,
      '{SEED}|' || run_file || '|' || sample_pos || '|0' AS rid FROM ({base}) s"""
    ctes = f"p AS MATERIALIZED ({rows})"
    if inst_id == "length_constraints:number_sentences":
        # The registered query counts with the model learned from the same responses.
        counted = c.learned_sentence_count("v")
        passes = passes.replace(c.sentence_count("v"), "n_sentences")
        ctes = f"{c.sentence_ctes('SELECT v FROM (' + rows + ') x')}, p AS MATERIALIZED (SELECT *, {counted} AS n_sentences FROM ({rows}) y)"
    source = "SELECT p.*, NULL AS det FROM p"
    if needs_language:
        ctes += ",\n" + c.detection_ctes("SELECT sample_pos AS id, v FROM p")
        source = "SELECT p.*, d.det FROM p LEFT JOIN detected d ON d.id = p.sample_pos"
    return f"""WITH {ctes}
SELECT sample_pos, {c.verdict(passes, failed)} AS strict,
  coalesce({drawn}, FALSE) AS arg_defaulted, coalesce({failed}, FALSE) AS failed
FROM ({source}) q"""


def outcomes_ctes(shift=0, name="o", language=True):
    """CTEs ending in `name`: one row per scored instruction of the samples."""
    pairs = (f"SELECT run_file, sample_pos, lang, response, unnest(list_transform(range(1, least(len(instruction_id_list), "
             f"len(kwargs)) + 1), lambda i: {{'pos': i - 1, 'id': instruction_id_list[i], 'raw': kwargs[i]}})) AS x "
             f"FROM {name}_s")
    case = lambda n, other: "CASE x.id " + " ".join(
        f"WHEN '{i}' THEN {n(*c.CHECKS[i])}" for i in f.INSTRUCTION_IDS if i in c.CHECKS
    ) + f" ELSE {other} END"
    known = ", ".join(f"'{i}'" for i in f.INSTRUCTION_IDS if i in c.CHECKS)
    ids = ", ".join(f"'{i}'" for i in c.LANGUAGE_CHECKS)
    ctes = f"""{name}_s AS MATERIALIZED ({f.samples_sql('duckdb', shift)}),
{name}_p AS MATERIALIZED (SELECT run_file, sample_pos, lang, x, x.pos AS inst_pos, response AS v, {c.parsed('x.raw')} AS j,
    '{SEED}|' || run_file || '|' || sample_pos || '|' || x.pos AS rid FROM ({pairs}) e),
"""
    detection = c.detection_ctes(f"SELECT DISTINCT sample_pos AS id, v FROM {name}_p WHERE x.id IN ({ids})")
    for cte in ["gram_lang", "gram_total", "vocab", "prior", "theta", "wanted", "lettered", "resp_gram", "judged", "detected"]:
        detection = re.sub(rf"\b{cte}\b", f"{name}_{cte}", detection)
    return ctes + detection + f""",
{name} AS MATERIALIZED (SELECT run_file, sample_pos, CAST(inst_pos AS INT) AS inst_pos, x.id AS inst_id, string_split(x.id, ':')[1] AS category,
    x.id IN ({known}) AS known, {case(lambda p, e, d: c.verdict(p, e), 'FALSE')} AS strict,
    coalesce({case(lambda p, e, d: e, 'FALSE')}, FALSE) AS failed,
    coalesce({case(lambda p, e, d: d, 'FALSE')}, FALSE) AS arg_defaulted
  FROM (SELECT p.*, d.det FROM {name}_p p LEFT JOIN {name}_detected d ON d.id = p.sample_pos) q)"""


# --- statements ------------------------------------------------------------------


ORACLE = {
    "check_" + i.replace(":", "_").replace("-", "_"): check(i)
    for i in f.INSTRUCTION_IDS[:-1] + f.OFF_BY_DEFAULT
}

SAMPLES = f.samples_sql("duckdb")
RESPONSES = f.responses_sql("duckdb")
RUNS = f.runs_sql("duckdb")
INSTRUCTIONS = f.instructions_sql()
TURNS = f.turns_sql()
PAIRS = f"""SELECT run_file, sample_pos, unnest(list_transform(range(1, least(len(instruction_id_list), len(kwargs)) + 1),
    lambda i: {{'pos': CAST(i - 1 AS INT), 'id': instruction_id_list[i], 'raw': kwargs[i]}})) AS x FROM ({SAMPLES}) s"""
PARSED = f"SELECT *, x.pos AS inst_pos, x.id AS inst_id, {c.parsed('x.raw')} AS j, '{SEED}|' || run_file || '|' || sample_pos || '|' || x.pos AS rid FROM ({PAIRS}) e"
DROPPED = "greatest(len(instruction_id_list) - len(kwargs), 0)"

ORACLE["paired_instructions"] = f"""SELECT s.sample_pos, {DROPPED} AS dropped, x.pos AS inst_pos, x.id AS inst_id, x.raw AS kwargs
FROM ({SAMPLES}) s LEFT JOIN ({PAIRS}) p ON p.sample_pos = s.sample_pos"""

ORACLE["parsed_args"] = f"""SELECT sample_pos, inst_pos, json_extract_string(j, '$.relation') AS relation,
  CAST(json_extract_string(j, '$.num_words') AS DOUBLE) AS num_words, CAST(json_extract_string(j, '$.num_sections') AS DOUBLE) AS num_sections,
  json_extract_string(j, '$.letter') AS letter, json_extract_string(j, '$.end_phrase') AS end_phrase,
  CASE WHEN json_extract(j, '$.keywords') IS NOT NULL THEN array_to_string(json_extract_string(j, '$.keywords[*]'), ',') END AS keywords
FROM ({PARSED}) p"""

_KEYS = ", ".join(f"('{i}', [{', '.join(lit(a) for a in names)}]::VARCHAR[])" for i, names in k.ARG_KEYS.items())
ORACLE["accepted_args"] = f"""SELECT sample_pos, inst_pos, p.inst_id, r.inst_id IS NOT NULL AS known,
  array_to_string(list_sort(list_filter(json_keys(j), lambda a: list_contains(coalesce(r.arg_keys, []), a))), ',') AS accepted
FROM ({PARSED}) p LEFT JOIN (VALUES {_KEYS}) r(inst_id, arg_keys) ON r.inst_id = p.inst_id"""

ORACLE["unknown_instructions"] = f"""SELECT x.id AS inst_id, x.id <> 'unknown:thing' AS known, count(*) AS n
FROM ({PAIRS}) p GROUP BY ALL"""

ORACLE["instruction_category"] = f"""SELECT sample_pos, x.pos AS inst_pos, string_split(x.id, ':')[1] AS category FROM ({PAIRS}) p"""

OUTCOMES = outcomes_ctes()
ORACLE["instruction_scores"] = f"""WITH {OUTCOMES}
SELECT run_file, sample_pos, inst_pos, inst_id, category, known, strict, strict AS loose, failed, arg_defaulted FROM o"""

# per sample; an empty list passes
PROMPTS = f"""SELECT s.run_file, s.sample_pos, {DROPPED} AS dropped, coalesce(bool_and(o.strict), TRUE) AS passed,
  count(o.strict) AS n, count(*) FILTER (o.strict) AS p,
  coalesce(string_agg(CAST(o.strict AS VARCHAR), ',' ORDER BY inst_pos), '') AS marks
FROM o_s s LEFT JOIN o ON o.run_file = s.run_file AND o.sample_pos = s.sample_pos GROUP BY ALL"""
RUN_ACC = f"""SELECT run_file, count(*) AS num_samples, sum(n) AS num_instructions, sum(p) AS inst_strict_pass, sum(p) AS inst_loose_pass,
  count(*) FILTER (passed) AS prompt_strict_pass, count(*) FILTER (passed) AS prompt_loose_pass, sum(dropped) AS dropped_instructions,
  coalesce(sum(p) / nullif(sum(n), 0)::DOUBLE, 0) AS inst_level_strict_acc, coalesce(sum(p) / nullif(sum(n), 0)::DOUBLE, 0) AS inst_level_loose_acc,
  count(*) FILTER (passed) / count(*)::DOUBLE AS prompt_level_strict_acc, count(*) FILTER (passed) / count(*)::DOUBLE AS prompt_level_loose_acc
FROM ({PROMPTS}) g GROUP BY run_file"""
_BIG = ["num_instructions", "inst_strict_pass", "inst_loose_pass", "dropped_instructions"]
ORACLE["accuracy_by_run"] = f"""WITH {OUTCOMES}
SELECT * REPLACE ({', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in _BIG)}) FROM ({RUN_ACC}) a"""

ORACLE["sample_outcomes"] = f"""WITH {OUTCOMES}
SELECT run_file, sample_pos, marks AS strict, marks AS loose, passed AS prompt_strict_pass, passed AS prompt_loose_pass,
  CAST(dropped AS INT) AS dropped_instructions FROM ({PROMPTS}) p"""

ORACLE["stats_by_type"] = f"""WITH {OUTCOMES}
SELECT run_file, category, inst_id, count(*) FILTER (strict) AS strict_pass, count(*) FILTER (strict) AS loose_pass, count(*) AS total
FROM o GROUP BY ALL"""

ORACLE["stats_by_level"] = f"""WITH {OUTCOMES}, g AS (
  SELECT run_file, 'type' AS level, category, inst_id, strict FROM o
  UNION ALL SELECT run_file, 'category', category, NULL, strict FROM o
  UNION ALL SELECT run_file, 'overall', NULL, NULL, strict FROM o)
SELECT run_file, level, category, inst_id, count(*) FILTER (strict) AS strict_pass, count(*) FILTER (strict) AS loose_pass,
  count(*) AS total, count(*) FILTER (strict) / count(*)::DOUBLE AS strict_acc, count(*) FILTER (strict) / count(*)::DOUBLE AS loose_acc
FROM g GROUP BY run_file, level, category, inst_id"""


def _side(name):
    return f"""SELECT level, category, inst_id, count(*) FILTER (strict) AS p, count(*) AS t FROM (
  SELECT 'type' AS level, category, inst_id, strict FROM {name} UNION ALL SELECT 'category', category, NULL, strict FROM {name}
  UNION ALL SELECT 'overall', NULL, NULL, strict FROM {name}) GROUP BY ALL"""


BOTH = f"{OUTCOMES},\n{outcomes_ctes(5, 'b')}"
COMPARISON = f"""SELECT level, category, inst_id AS instruction_type, model1_acc, model2_acc, model1_count, model2_count,
  model1_acc - model2_acc AS diff,
  CASE WHEN abs(model1_acc - model2_acc) < 0.001 THEN 'tie' WHEN model1_acc > model2_acc THEN '<- M1' || w ELSE '-> M2' || w END AS winner
FROM (SELECT level, category, inst_id, CASE WHEN level = 'category' THEN ' wins' ELSE '' END AS w,
    coalesce(x.p / nullif(x.t, 0)::DOUBLE, 0) AS model1_acc, coalesce(y.p / nullif(y.t, 0)::DOUBLE, 0) AS model2_acc,
    coalesce(x.p, 0) || '/' || coalesce(x.t, 0) AS model1_count, coalesce(y.p, 0) || '/' || coalesce(y.t, 0) AS model2_count
  FROM (SELECT DISTINCT level, category, inst_id FROM (SELECT level, category, inst_id FROM ({_side('o')}) UNION ALL SELECT level, category, inst_id FROM ({_side('b')}))) k
  LEFT JOIN ({_side('o')}) x ON x.level = k.level AND x.category IS NOT DISTINCT FROM k.category AND x.inst_id IS NOT DISTINCT FROM k.inst_id
  LEFT JOIN ({_side('b')}) y ON y.level = k.level AND y.category IS NOT DISTINCT FROM k.category AND y.inst_id IS NOT DISTINCT FROM k.inst_id) j"""
COMPARISON = COMPARISON.replace("FROM (SELECT level, category, inst_id, CASE WHEN level", "FROM (SELECT k.level, k.category, k.inst_id, CASE WHEN k.level")
ORACLE["model_comparison"] = f"WITH {BOTH}\n{COMPARISON}"
ORACLE["comparison_wins"] = f"""WITH {BOTH}
SELECT level, count(*) FILTER (winner LIKE '<-%') AS model1_wins, count(*) FILTER (winner LIKE '->%') AS model2_wins,
  count(*) FILTER (winner = 'tie') AS ties FROM ({COMPARISON}) c WHERE level <> 'overall' GROUP BY level"""
_KNOWN = "inst_id <> 'unknown:thing'"


def _listed(name, key, where="TRUE"):
    return f"""(SELECT string_agg(k || ':' || p || '/' || p || '/' || t, ',' ORDER BY k) FROM (
  SELECT {key} AS k, count(*) FILTER (strict) AS p, count(*) AS t FROM {name} WHERE {where} GROUP BY ALL))"""


ORACLE["comparison_document"] = f"""WITH {BOTH}
SELECT 'first' AS name1, 'second' AS name2, (SELECT count(*) FILTER (strict) / count(*)::DOUBLE FROM o) AS overall1,
  (SELECT count(*) FILTER (strict) / count(*)::DOUBLE FROM b) AS overall2,
  {_listed('o', 'inst_id', _KNOWN)} AS types1, {_listed('b', 'inst_id', _KNOWN)} AS types2,
  {_listed('o', 'category', "category <> 'unknown'")} AS categories1, {_listed('b', 'category', "category <> 'unknown'")} AS categories2,
  (SELECT string_agg(concat_ws('|', instruction_type, model1_count, model2_count, winner), ',' ORDER BY instruction_type)
   FROM ({COMPARISON}) c WHERE level = 'type' AND instruction_type <> 'unknown:thing') AS compared"""

_SHORT = lambda shift: f"SELECT length(response) <= 3000 AS loose FROM ({f.responses_sql('duckdb', shift)}) r"
ORACLE["loose_comparison"] = f"""SELECT level, CASE WHEN level <> 'overall' THEN 'custom' END AS category,
  CASE WHEN level = 'type' THEN 'custom:short' END AS instruction_type, x.p / x.t::DOUBLE AS model1_acc, y.p / y.t::DOUBLE AS model2_acc,
  x.p || '/' || x.t AS model1_count, y.p || '/' || y.t AS model2_count, x.p / x.t::DOUBLE - y.p / y.t::DOUBLE AS diff,
  CASE WHEN abs(x.p / x.t::DOUBLE - y.p / y.t::DOUBLE) < 0.001 THEN 'tie' WHEN x.p / x.t::DOUBLE > y.p / y.t::DOUBLE THEN '<- M1' || w ELSE '-> M2' || w END AS winner
FROM (SELECT count(*) FILTER (loose) AS p, count(*) AS t FROM ({_SHORT(0)})) x, (SELECT count(*) FILTER (loose) AS p, count(*) AS t FROM ({_SHORT(5)})) y,
  (VALUES ('type', ''), ('category', ' wins'), ('overall', '')) l(level, w)"""

_ALL = f.INSTRUCTION_IDS[:-1]
_DECLARED = ", ".join(f"('{a}', '{b}')" for a, b in [
    *((a, b) for a, others in k.CONFLICTS.items() for b in others),
    *((a, b) for a, spared in k.CONFLICTS_ALL_BUT.items() for b in _ALL if b not in spared)])
_IDS = ", ".join(f"('{i}')" for i in _ALL)
ORACLE["conflicting_pairs"] = f"""WITH d(a, b) AS (VALUES {_DECLARED}),
closed AS (SELECT a, b FROM d UNION SELECT b, a FROM d UNION SELECT i, i FROM (VALUES {_IDS}) t(i)),
e AS (SELECT sample_pos, unnest(instruction_id_list) AS id, generate_subscripts(instruction_id_list, 1) AS pos FROM ({SAMPLES}) s)
SELECT DISTINCT x.sample_pos, x.id AS inst_id, y.id AS other_id
FROM e x JOIN e y ON x.sample_pos = y.sample_pos AND x.pos < y.pos JOIN closed ON a = x.id AND b = y.id"""


_SPELLED = {"num_sentences", "num_placeholders", "num_bullets", "num_highlights", "num_sections", "num_paragraphs", "num_words",
            "frequency", "let_frequency", "capital_frequency", "nth_paragraph"}


def _description(inst_id):
    template = TEMPLATES[inst_id]
    text = c.text
    spelled = lambda words: f"'[' || array_to_string(list_transform(list_sort({words}), lambda w: '''' || w || ''''), ', ') || ']'"
    total = c.num("num_paragraphs", 1, 5)
    given = c.number("nth_paragraph")
    names = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in k.LANGUAGE_NAMES.items()) + "}"
    values = {
        "language": f"({names})[{c.choice('language', list(k.LANGUAGE_NAMES))}]",
        "relation": c.rel(), "let_relation": c.rel("let_relation"), "capital_relation": c.rel("capital_relation"),
        "num_sentences": c.num("num_sentences", 1, 20), "num_placeholders": c.num("num_placeholders", 1, 4),
        "num_bullets": c.num("num_bullets", 1, 5), "num_highlights": c.num("num_highlights", 1, 4),
        "num_sections": c.num("num_sections", 1, 5), "num_paragraphs": total,
        "num_words": c.num("num_words", 100, 500), "frequency": c.num("frequency", 1, 3),
        "let_frequency": c.num("let_frequency", 1, 10),
        "capital_frequency": f"coalesce({c.number('capital_frequency')}, {c.between('capital_frequency', 1, 20)})",
        "section_spliter": c.choice("section_spliter", k.SECTION_SPLITERS),
        "postscript_marker": c.choice("postscript_marker", k.POSTSCRIPT_MARKERS),
        "end_phrase": c.choice("end_phrase", k.ENDING_OPTIONS),
        "keywords": spelled(c.keywords("keywords", 2)),
        "forbidden_words": spelled(f"list_distinct({c.keywords('forbidden_words', 2)})"),
        "keyword": strip(f"coalesce(nullif({text('keyword')}, ''), ({c.sampled('keyword', 1)})[1])"),
        "first_word": f"lower(coalesce({text('first_word')}, ({c.sampled('first_word', 1)})[1]))",
        "nth_paragraph": f"CASE WHEN {given} IS NULL OR {given} <= 0 OR {given} > {total} THEN {c.between('nth_paragraph', 1, f'({total}) + 1')} ELSE {given} END",
        "letter": c._letter(),
    }
    out = lit(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            shown = f"CAST({value} AS VARCHAR)"
            if name in _SPELLED:
                shown = f"CASE WHEN ({value}) = floor({value}) THEN CAST(CAST(({value}) AS BIGINT) AS VARCHAR) ELSE {shown} END"
            out = f"replace({out}, '{{{name}}}', {shown})"
    return out


ORACLE["instruction_descriptions"] = f"""SELECT sample_pos, inst_pos, inst_id, CASE inst_id {' '.join(
    f"WHEN '{i}' THEN {_description(i)}" for i in f.INSTRUCTION_IDS[:-1])} END AS description FROM ({PARSED}) p"""

_RID = "'42|' || CAST(doc_id AS VARCHAR)"
ORACLE["drawn_args"] = f"""SELECT doc_id, {c.between('num_words', 100, 500)} AS num_words, {c.between('num_sentences', 1, 20)} AS num_sentences,
  {c.one_of('language', list(k.LANGUAGE_NAMES))} AS language, {c.one_of('relation', k.RELATIONS)} AS relation
FROM (SELECT doc_id, {_RID} AS rid FROM documents) d"""
ORACLE["sampled_words"] = f"""SELECT doc_id, array_to_string({c.sampled('keywords', 2)}, ',') AS words FROM (SELECT doc_id, {_RID} AS rid FROM documents) d"""

ORACLE["text_sentences"] = f"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, {c.sentences('response')} AS s FROM ({RESPONSES}) r) x"""
_SENTENCES = c.sentence_ctes(f"SELECT response AS v FROM ({RESPONSES}) x")
ORACLE["sentence_model"] = f"""WITH {c.sentence_ctes('SELECT text AS v FROM documents')}
SELECT 'abbreviation' AS kind, word FROM abbreviation UNION ALL SELECT 'starter', word FROM starter"""
ORACLE["abbreviation_scores"] = f"""WITH {_SENTENCES}
SELECT word, n::BIGINT AS n, k::BIGINT AS n_stop, word IN (SELECT word FROM abbreviation) AS abbreviation FROM sent_type WHERE word IS NOT NULL AND k > 0"""
ORACLE["text_counts"] = f"""WITH {_SENTENCES}
SELECT doc_id, {c.word_count('response')} AS n_words, CAST({c.learned_sentence_count('response')} AS BIGINT) AS n_sentences,
  {c.is_upper('response')} AS is_upper, {c.is_lower('response')} AS is_lower FROM ({RESPONSES}) r"""
ORACLE["text_tokens"] = f"SELECT doc_id, array_to_string({c.tokens('response')}, ' ') AS tokens FROM ({RESPONSES}) r"
ORACLE["text_shared_words"] = f"""SELECT doc_id, CAST({c.shared_words('a', 'b')} AS BIGINT) AS shared
FROM (SELECT doc_id, output AS a, instruction || ' ' || output AS b FROM ({INSTRUCTIONS}) i) x"""
ORACLE["text_language"] = f"""WITH r AS MATERIALIZED ({RESPONSES}), {c.detection_ctes('SELECT doc_id AS id, response AS v FROM r')}
SELECT r.doc_id, r.lang, d.det AS detected FROM r LEFT JOIN detected d ON d.id = r.doc_id"""
ORACLE["stripped_responses"] = f"SELECT doc_id, {strip('response')} AS response FROM ({RESPONSES}) r"

_PART = "regexp_extract(rtrim({0}, '/'), '[^/]*$')"
_LORA = "coalesce(lora_path, '') <> ''"
DISPLAY = f"CASE WHEN {_LORA} THEN {_PART.format('lora_path')} ELSE model_name END"
RUN_NAME = f"CASE WHEN {_LORA} THEN {_PART.format('lora_path')} ELSE replace(model_name, '/', '_') END || CASE WHEN n % 2 = 1 THEN '_hf' ELSE '' END"
HEADERS = f"SELECT *, {DISPLAY} AS display_name, {RUN_NAME} AS out_name, coalesce(precision, 'fp16') AS prec, coalesce(ts, '20260101_000000') AS stamp FROM ({RUNS}) r0"
ORACLE["display_names"] = f"SELECT source AS run_file, display_name, out_name AS run_name FROM ({HEADERS}) h"
ORACLE["read_responses"] = f"""SELECT h.display_name, s.key, s.prompt, s.response, array_to_string(s.instruction_id_list, ',') AS ids,
  array_to_string(s.kwargs, ',') AS kwargs FROM ({SAMPLES}) s JOIN ({HEADERS}) h ON h.source = s.run_file"""
DOCUMENT = "out_name || '_' || prec || '_' || stamp || '.json'"
ORACLE["responses_documents"] = f"""SELECT {DOCUMENT} AS document, count(*) AS n,
  md5(string_agg(concat_ws('|', key, prompt, response, array_to_string(instruction_id_list, ','), array_to_string(kwargs, ',')), '~' ORDER BY sample_pos)) AS content
FROM ({SAMPLES}) s JOIN ({HEADERS}) h ON h.source = s.run_file GROUP BY ALL"""
ORACLE["responses_round_trip"] = f"""SELECT {DOCUMENT} AS file, h.display_name, s.key, s.prompt, s.response,
  array_to_string(s.instruction_id_list, ',') AS ids, array_to_string(s.kwargs, ',') AS kwargs
FROM ({SAMPLES}) s JOIN ({HEADERS}) h ON h.source = s.run_file"""
ORACLE["read_instructions"] = f"SELECT instruction, input, output FROM ({INSTRUCTIONS}) i"
ORACLE["read_benchmark"] = "SELECT item_id AS key, text AS prompt, 'punctuation:no_comma' AS ids, '{}' AS kwargs FROM benchmark"

TYPE = "CASE WHEN " + _LORA + " OR regexp_matches(lower(coalesce(run_name, '')), 'sft|finetune|lora|trained') THEN 'finetuned' ELSE 'base' END"
LOADED = f"SELECT *, {TYPE} AS model_type, coalesce(precision, 'unknown') AS prec, coalesce(run_name, 'unknown') AS rname FROM ({RUNS}) r0 WHERE n % 10 <> 9"
ORACLE["load_results"] = f"SELECT file, run_name, ts AS timestamp, num_samples, model_type FROM ({LOADED}) l"
ORACLE["run_configs"] = f"""SELECT file, model_type || '_' || prec || '_' || rname AS name, model_name, model_type, prec AS precision, lora_path,
  2048 AS max_seq_length, 64 AS batch_size, num_samples, 1024 AS max_new_tokens, FALSE AS do_sample, model_type || ',' || prec || ',ifeval' AS tags FROM ({LOADED}) l"""
_METRICS = ["('ifeval/prompt_strict_acc', prompt_strict)", "('ifeval/prompt_loose_acc', prompt_loose)",
            "('ifeval/inst_strict_acc', inst_strict)", "('ifeval/inst_loose_acc', inst_loose)",
            "('timing/generation_seconds', CASE WHEN n % 6 <> 5 THEN generation_seconds END)",
            "('timing/scoring_seconds', CASE WHEN n % 6 <> 5 THEN scoring_seconds END)",
            "('timing/total_seconds', CASE WHEN n % 6 <> 5 THEN generation_seconds + scoring_seconds END)",
            "('eval/gpu_memory_gb', nullif(gpu, 0))"]
ORACLE["run_metrics"] = f"""SELECT file, m.metric, m.value FROM ({LOADED}) l, LATERAL (VALUES {', '.join(_METRICS)}) m(metric, value) WHERE m.value IS NOT NULL"""
_FOUR = [("Prompt Strict Acc", "prompt_strict"), ("Prompt Loose Acc", "prompt_loose"), ("Inst Strict Acc", "inst_strict"), ("Inst Loose Acc", "inst_loose")]
_SUMMARY = ["('Model', model_name)", "('Type', model_type)", "('Precision', prec)"] + [f"('{a}', printf('%.4f', {b}))" for a, b in _FOUR]
ORACLE["run_summaries"] = f"""SELECT file, "Metric", "Value" FROM ({LOADED}) l, LATERAL (VALUES {', '.join(_SUMMARY)}) m("Metric", "Value")"""
LATEST = f"SELECT * FROM ({LOADED}) l QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY coalesce(ts, '') DESC, file DESC) = 1"
ORACLE["latest_runs"] = f"SELECT model_type, file FROM ({LATEST}) x"
_SIDES = f"(SELECT * FROM ({LATEST}) WHERE model_type = 'base') x CROSS JOIN (SELECT * FROM ({LATEST}) WHERE model_type = 'finetuned') y"
ORACLE["base_vs_finetuned"] = " UNION ALL ".join(
    f"""SELECT '{a}' AS "Metric", printf('%.4f', x.{b}) AS "Base", printf('%.4f', y.{b}) AS "Finetuned",
  CASE WHEN x.{b} > 0 THEN printf('%+.4f (%+.1f%%)', y.{b} - x.{b}, (y.{b} - x.{b}) / x.{b} * 100) ELSE printf('%+.4f', y.{b} - x.{b}) END AS "Improvement"
FROM {_SIDES}""" for a, b in _FOUR)
ORACLE["chart_rows"] = " UNION ALL ".join(
    f"""SELECT 'comparison/{a}' AS chart, '{m}' AS "Model", {side}.{b} AS "Accuracy" FROM {_SIDES}"""
    for a, b in [("prompt_strict_acc", "prompt_strict"), ("inst_strict_acc", "inst_strict")] for m, side in [("Base", "x"), ("Finetuned", "y")])

_DOC = "h.out_name || '_' || h.prec || '_20260201_000000.json'"
ORACLE["result_documents"] = f"""WITH {OUTCOMES}
SELECT {_DOC} AS document, h.out_name AS run_name, h.model_name, h.num_samples, a.inst_level_strict_acc, a.inst_level_loose_acc,
  a.prompt_level_strict_acc, a.prompt_level_loose_acc FROM ({HEADERS}) h JOIN ({RUN_ACC}) a ON a.run_file = h.source"""
ORACLE["result_documents_with_samples"] = f"""WITH {OUTCOMES}
SELECT {_DOC} AS document, count(*) AS n, md5(string_agg(concat_ws('|', p.key, p.response, p.marks), '~' ORDER BY p.sample_pos)) AS content
FROM ({HEADERS}) h JOIN (SELECT s.run_file, s.sample_pos, s.key, s.response, coalesce(string_agg(CAST(o.strict AS VARCHAR), ',' ORDER BY inst_pos), '') AS marks
  FROM o_s s LEFT JOIN o ON o.run_file = s.run_file AND o.sample_pos = s.sample_pos GROUP BY ALL) p ON p.run_file = h.source GROUP BY ALL"""
_FLAT = [f"('ifeval/{x}', a.{x})" for x in ["inst_level_strict_acc", "inst_level_loose_acc", "prompt_level_strict_acc", "prompt_level_loose_acc"]] + [
    "('timing/generation_seconds', h.generation_seconds)", "('timing/scoring_seconds', 0.5::DOUBLE)",
    "('timing/total_seconds', h.generation_seconds + 0.5)", "('eval/gpu_memory_gb', nullif(h.gpu, 0))"]
ORACLE["run_timing_totals"] = f"""WITH {OUTCOMES}
SELECT {_DOC} AS document, h.generation_seconds, h.generation_seconds + 0.5 AS total_seconds, m.metric, m.value
FROM ({HEADERS}) h JOIN ({RUN_ACC}) a ON a.run_file = h.source, LATERAL (VALUES {', '.join(_FLAT)}) m(metric, value) WHERE m.value IS NOT NULL"""

ORACLE["mmlu_rows"] = f"""SELECT 'mmlu_' || source || '_2026' AS run_name, CASE WHEN n % 4 <> 2 THEN model_name ELSE 'unknown' END AS model_name,
  coalesce(precision, 'float16') AS dtype, '16' AS batch_size, num_samples AS n_samples, prompt_strict AS acc_norm,
  generation_seconds AS eval_time_seconds, coalesce(precision, 'unknown') AS dtype_tag FROM ({RUNS}) r"""
TRAINING = f"SELECT *, model_name || CASE WHEN n % 2 = 0 THEN '' ELSE '-x' END AS base_model FROM ({RUNS}) r0"
ORACLE["training_metadata_runs"] = f"""SELECT l.file, t.num_samples AS dataset_samples, t.inst_strict AS training_loss, t.generation_seconds AS training_time_seconds
FROM ({LOADED}) l LEFT JOIN ({TRAINING}) t ON t.base_model = l.model_name AND t.precision = l.precision"""
ORACLE["training_metadata_documents"] = f"""SELECT concat_ws('_', 'training_metadata', replace(base_model, '/', '_'), precision, '20260101') || '.json' AS file,
  base_model, precision, 'docs' AS dataset, num_samples AS samples, inst_strict AS loss, generation_seconds AS runtime_s, '20260101' AS timestamp
FROM ({TRAINING}) t"""

ORACLE["first_rows"] = "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 25"
USER = f"CASE WHEN {strip('input')} <> '' THEN instruction || chr(10) || chr(10) || input ELSE instruction END"
ORACLE["alpaca_user_text"] = f"SELECT doc_id, {USER} AS user_text FROM ({INSTRUCTIONS}) i"


def _message(role, text):
    return f"'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10) || {text} || '<|eot_id|>'"


_REPLY = "'<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"
ORACLE["training_text"] = f"""SELECT '<|begin_of_text|>' || {_message("'user'", f'({USER})')} || {_message("'assistant'", 'output')} AS text FROM ({INSTRUCTIONS}) i"""
_CHAT = f"""'<|begin_of_text|>' || {_message("'user'", 'text')} || {_REPLY}"""
ORACLE["prompt_text"] = f"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN {_CHAT} ELSE text END AS text FROM benchmark"
_TOK = f"regexp_split_to_array({strip('text')}, {lit(c.WS1 + '+')})"
_GAPS = f"regexp_split_to_array({strip('text')}, {lit(c.NOT_WS1 + '+')})"
ORACLE["truncated_prompts"] = f"""SELECT doc_id, CASE WHEN len({_TOK}) <= 2048 THEN text ELSE regexp_extract(text, {lit(f'^{c.WS1}*')}) || array_to_string(
  list_transform(list_zip({_GAPS}[1:2048], {_TOK}[1:2048]), lambda x: x[1] || x[2]), '') END AS text FROM documents"""
_NTOK = f"CASE WHEN {strip('text')} = '' THEN 0 ELSE len({_TOK}) END"
ORACLE["request_throughput"] = f"""SELECT doc_id, tokens, round(s, 2) AS time, round(tokens / s, 1) AS tok_per_s
FROM (SELECT doc_id, CAST({_NTOK} AS BIGINT) AS tokens, n_chars / 997.0::DOUBLE AS s FROM documents) d"""
ORACLE["prompt_batches"] = """SELECT doc_id, position, CAST(floor(position / 64) AS BIGINT) AS batch_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) d"""
ORACLE["batch_padding"] = f"""SELECT item_id, batch_id, tokens, max(tokens) OVER b AS padded_tokens,
  1 - sum(tokens) OVER b / (count(*) OVER b * max(tokens) OVER b)::DOUBLE AS padding_waste
FROM (SELECT item_id, CAST((row_number() OVER (ORDER BY item_id) - 1) // 8 AS BIGINT) AS batch_id, CAST({_NTOK} AS BIGINT) AS tokens FROM benchmark) x
WINDOW b AS (PARTITION BY batch_id)"""
ORACLE["generated_responses"] = f"SELECT item_id, {strip(f'''('  You said: ' || {_CHAT} || chr(10))''')} AS response FROM benchmark"

_PARTS = f"SELECT *, coalesce(CAST(floor(turn / 1024) AS BIGINT), 0) AS part FROM ({f.odd_turns_sql()}) t"
ORACLE["conversation_text"] = f"""SELECT conv_id, part, CASE WHEN part = min(part) OVER (PARTITION BY conv_id) THEN '<|begin_of_text|>' ELSE '' END || text AS text
FROM (SELECT conv_id, part, string_agg({_message('role', 'text')}, '' ORDER BY turn NULLS FIRST) AS text FROM ({_PARTS}) p GROUP BY conv_id, part) x"""
ORACLE["conversation_plain_text"] = f"""SELECT conv_id, part, string_agg(text, chr(10) || chr(10) ORDER BY turn NULLS FIRST) AS text
FROM ({_PARTS}) p GROUP BY conv_id, part"""
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down,
  sum({_NTOK}) OVER (PARTITION BY conv_id) AS tokens FROM conversations"""
ORACLE["trimmed_history"] = f"SELECT conv_id, turn, role, text FROM ({_RANKED}) r WHERE down <= 4 OR (up = 1 AND role = 'system')"
ORACLE["trimmed_history_over_budget"] = f"""SELECT conv_id, turn, role, text FROM ({_RANKED}) r
WHERE tokens <= 300 OR down <= 4 OR (up = 1 AND role = 'system')"""
_RESET = f"(role = 'user' AND lower({strip('text')}) = 'clear')"
SEGMENTS = f"""SELECT *, CAST(sum(CASE WHEN {_RESET} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS BIGINT) AS segment FROM ({TURNS}) t"""
ORACLE["history_segments"] = f"SELECT conv_id, turn, role, segment FROM ({SEGMENTS}) s"
ORACLE["active_history"] = f"""SELECT conv_id, turn, role, text FROM (SELECT *, max(segment) OVER (PARTITION BY conv_id) AS last FROM ({SEGMENTS}) s) x
WHERE (segment = last AND NOT {_RESET}) OR role = 'system'"""

_PATTERNS = f"SELECT sample_pos, instruction_id_list[1] AS inst_id, response AS v FROM ({f.pattern_samples_sql('duckdb')}) s"
ORACLE["pattern_scores"] = f"""SELECT sample_pos, inst_id, CASE sample_pos % {len(f.PATTERN_CASES)} {' '.join(
    f'WHEN {n} THEN {case[2]}' for n, case in enumerate(f.PATTERN_CASES))} END AS strict,
  sample_pos % {len(f.PATTERN_CASES)} = {len(f.PATTERN_CASES) - 1} AS failed FROM ({_PATTERNS}) p"""

# Samples after the round trip carry their document's name as their run.
ORACLE["accuracy_after_round_trip"] = f"""WITH pairs AS (SELECT s.run_file, s.sample_pos, {DROPPED} AS dropped,
    list_transform(instruction_id_list[1:least(len(instruction_id_list), len(kwargs))], lambda i: i = 'punctuation:no_comma' AND NOT contains(response, ',')) AS marks
  FROM ({SAMPLES}) s),
runs AS (SELECT {DOCUMENT} AS run_file, count(*) AS num_samples, CAST(sum(len(marks)) AS BIGINT) AS num_instructions,
    CAST(sum(len(list_filter(marks, lambda m: m))) AS BIGINT) AS passed, count(*) FILTER (len(list_filter(marks, lambda m: NOT m)) = 0) AS prompts,
    CAST(sum(dropped) AS BIGINT) AS dropped_instructions FROM pairs p JOIN ({HEADERS}) h ON h.source = p.run_file GROUP BY 1)
SELECT run_file, num_samples, num_instructions, passed AS inst_strict_pass, passed AS inst_loose_pass, prompts AS prompt_strict_pass,
  prompts AS prompt_loose_pass, dropped_instructions, coalesce(passed / nullif(num_instructions, 0)::DOUBLE, 0) AS inst_level_strict_acc,
  coalesce(passed / nullif(num_instructions, 0)::DOUBLE, 0) AS inst_level_loose_acc, prompts / num_samples::DOUBLE AS prompt_level_strict_acc,
  prompts / num_samples::DOUBLE AS prompt_level_loose_acc FROM runs"""
ORACLE["result_round_trip"] = f"""WITH {OUTCOMES}
SELECT {_DOC} AS file, count(*) FILTER (passed) / count(*)::DOUBLE AS accuracy, count(*) AS n, count(*) FILTER (passed) AS passed
FROM ({HEADERS}) h JOIN ({PROMPTS}) p ON p.run_file = h.source GROUP BY 1"""
ORACLE["results_folder"] = ORACLE["load_results"]
ORACLE["mmlu_folder"] = ORACLE["mmlu_rows"]
ORACLE["comparison_round_trip"] = f"""WITH {BOTH}
SELECT 'first vs second.json' AS file, 'first' AS name1, 'second' AS name2, (SELECT count(*) FILTER (strict) / count(*)::DOUBLE FROM o) AS overall1,
  (SELECT count(*) FILTER (strict) / count(*)::DOUBLE FROM b) AS overall2,
  (SELECT count(DISTINCT inst_id) FROM o WHERE {_KNOWN}) AS n_types,
  (SELECT string_agg(concat_ws('|', instruction_type, model1_count, model2_count, winner), ',' ORDER BY instruction_type)
   FROM ({COMPARISON}) c WHERE level = 'type' AND instruction_type <> 'unknown:thing') AS compared"""
ORACLE["streamed_accuracy"] = ORACLE["accuracy_by_run"]
