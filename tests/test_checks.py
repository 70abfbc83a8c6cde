"""Each check on hand-derived rows: (instruction, arguments, response, passes)."""

import json

import pytest
from pyspark.sql import functions as F

from adherence.operators import scoring
from adherence.operators.checks import default_registry
from adherence.operators.scoring import ScoringOptions

A, L = {"relation": "at least"}, {"relation": "less than"}
CASES = [
    ("keywords:existence", {"keywords": ["cat", "DOG"]}, "A dog and a Cat", True),
    ("keywords:existence", {"keywords": ["cat", "bird"]}, "A dog and a Cat", False),
    ("keywords:existence", {"keywords": ["c.t"]}, "cut", True),
    ("keywords:existence", {"keywords": ["a|zzz"]}, "ABC", True),
    ("keywords:existence", {"keywords": [r"\bcat\b"]}, "concat", False),
    ("keywords:frequency", {"keyword": " the ", "frequency": 2, **A}, "The other", True),
    ("keywords:frequency", {"keyword": "the", "frequency": 2, **L}, "The other", False),
    ("keywords:frequency", {"keyword": "[ab]", "frequency": 3, **A}, "abc cab", True),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "concatenate", True),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "a CAT!", False),
    ("keywords:forbidden_words", {"forbidden_words": ["été"]}, "l'été", False),
    ("keywords:forbidden_words", {"forbidden_words": ["c("]}, "c( x", None),  # bad pattern
    ("keywords:letter_frequency", {"letter": "E", "let_frequency": 2, "let_relation": "at least"}, "Eel", True),
    ("keywords:letter_frequency", {"letter": "e", "let_frequency": 2, "let_relation": "less than"}, "Eel", False),
    ("length_constraints:number_sentences", {"num_sentences": 2, **A}, "One. Two.", True),
    ("length_constraints:number_sentences", {"num_sentences": 2, **L}, "One. Two.", False),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a *** b", True),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "*** a *** b ***", True),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a *** *** b", False),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 0}, "***", True),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 0}, "", True),
    ("length_constraints:number_words", {"num_words": 3, **A}, "one two three", True),
    ("length_constraints:number_words", {"num_words": 3, **L}, "one two three", False),
    ("length_constraints:nth_paragraph_first_word",
     {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "The"}, "a\n\n\"the's b", True),
    ("length_constraints:nth_paragraph_first_word",
     {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "b"}, "a\n\n\n\nb", False),
    ("length_constraints:nth_paragraph_first_word",
     {"num_paragraphs": 3, "nth_paragraph": 3, "first_word": "b"}, "a\n\nb", False),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] [b c]", True),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a\n] [b]", False),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, "bye\nP. S. x", True),
    ("detectable_content:postscript", {"postscript_marker": "P.P.S"}, "bye\np.p.s x", True),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, "PS x", False),
    ("detectable_content:postscript", {"postscript_marker": "NB"}, "see nb here", True),
    ("detectable_format:number_bullet_lists", {"num_bullets": 3}, "* a\n * b\n- c\n**d**", True),
    ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* a\n * b\n- c", False),
    ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "*\n- c", True),
    ("detectable_format:constrained_response", {}, " So: My answer is maybe. ok", True),
    ("detectable_format:constrained_response", {}, "my answer is yes.", False),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and *b*", True),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and * *", False),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 1}, "**x**", True),
    ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2},
     "Section 1 a Section 2 b", True),
    ("detectable_format:multiple_sections", {"section_spliter": "SECTION", "num_sections": 1}, "Section 1", False),
    ("detectable_format:multiple_sections", {"section_spliter": "(Day)", "num_sections": 3}, "Day 1 x Day 2", True),
    ("detectable_format:json_format", {}, '```json\n{"a": NaN}\n```', True),
    ("detectable_format:json_format", {}, '{"a": 1, "a": 2}', True),
    ("detectable_format:json_format", {}, "{'a': 1}", False),
    ("detectable_format:json_format", {}, '{"a": 1} x', False),
    ("detectable_format:json_format", {}, "", False),
    ("detectable_format:json_format", {}, "01", False),
    ("detectable_format:json_format", {}, "[1,]", False),
    ("detectable_format:json_format", {}, "Infinity", True),
    ("detectable_format:json_format", {}, '"a\nb"', False),
    ("detectable_format:json_format", {}, "truely", False),
    ("detectable_format:title", {}, "x <<A title>> y", True),
    ("detectable_format:title", {}, "<< >>", False),
    ("detectable_format:title", {}, "<<a\nb>>", False),
    ("combination:two_responses", {}, "a ****** b", True),
    ("combination:two_responses", {}, "a ****** a", False),
    ("combination:two_responses", {}, "****** a ****** b ******", True),
    ("combination:two_responses", {}, "a ****** ****** b", False),
    ("combination:repeat_prompt", {"prompt_to_repeat": " Say Hi "}, "  say hi. Hi!", True),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say Hi"}, "Hi", False),
    ("combination:repeat_prompt", {}, "Hi", None),
    ("startend:end_checker", {"end_phrase": " The End. "}, 'x the end."', True),
    ("startend:end_checker", {"end_phrase": "The End"}, "the end.", False),
    ("change_case:capital_word_frequency", {"capital_frequency": 3, "capital_relation": "at least"},
     "I LIKE WELL-KNOWN things", True),
    ("change_case:capital_word_frequency", {"capital_frequency": 3, "capital_relation": "less than"},
     "IT'S ok", True),
    ("change_case:capital_word_frequency", {"capital_frequency": -1, "capital_relation": "less than"}, "A", False),
    ("punctuation:no_comma", {}, "a; b", True),
    ("punctuation:no_comma", {}, "a, b", False),
    ("startend:quotation", {}, ' "a" ', True),
    ("startend:quotation", {}, '"', False),
    ("multi-turn:constrained_start", {"starter": "I think"}, "Well\n  I think so", True),
    ("multi-turn:constrained_start", {"starter": "I think"}, "Well I think so", False),
    ("detectable_format:rephrase", {"original_message": "a *b* c"}, "a *x y* c", True),
    ("detectable_format:rephrase", {"original_message": "a *b* c"}, "a *x* d", False),
    ("detectable_format:rephrase", {"original_message": "a b c"}, "a *x* c", None),
    ("detectable_format:rephrase", {"original_message": "a *b* c"}, "plain", None),
    ("keywords:key_sentences", {"key_sentences": ["One.", "Three."], "num_sentences": 1}, "One. Two.", True),
    ("keywords:key_sentences", {"key_sentences": ["One.", "Two."], "num_sentences": 1}, "One. Two.", False),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "run Run far", "low": 2, "high": 2},
     "RUN run ran", True),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "run far", "low": 2, "high": 3}, "run", False),
    ("no:such", {}, "x", False),
    # errors: a failing row, never a lost one
    ("length_constraints:number_words", {"num_words": 3, "relation": "about"}, "x", None),
    ("length_constraints:number_words", {"num_words": "3", **A}, "x y z", None),
]


@pytest.fixture(scope="module")
def options():
    return ScoringOptions(registry=default_registry().enable())


def test_checks(make_samples, options):
    rows = make_samples(*[(text, [(i, json.dumps(args))]) for i, args, text, _ in CASES])
    got = scoring.scores_long(scoring.score_samples(rows, options)).orderBy("sample_pos").collect()
    assert len(got) == len(CASES)
    wrong = [
        (case, r.strict, r.error) for case, r in zip(CASES, got)
        if (r.strict, r.error is not None) != (bool(case[3]), case[3] is None)
    ]
    assert not wrong
    assert all(r.loose == r.strict for r in got)


def test_argument_forms(make_samples):
    """Anything but a JSON object means no arguments; null means a missing one."""
    full = '{"num_words": 2, "relation": "at least", "unrelated": [1, {"a": 2}]}'
    forms = [full, "", None, "not json", "{'num_words': 2}", '{"num_words": 2', "[1]", '{"num_words": null}']
    rows = make_samples(*[("one two", [("length_constraints:number_words", f)]) for f in forms])
    got = scoring.parsed_instructions(rows).orderBy("sample_pos").select("args.num_words").collect()
    assert [r.num_words for r in got] == [2] + [None] * 7
    flags = scoring.scores_long(scoring.score_samples(rows)).orderBy("sample_pos").collect()
    assert [r.arg_defaulted for r in flags] == [False] + [True] * 7


def test_draws_do_not_depend_on_partitioning(make_samples):
    rows = make_samples(*[
        ("the answer is a paper window", [("keywords:existence", "{}"), ("length_constraints:number_words", "{}")])
        for _ in range(60)
    ])
    few = scoring.scores_long(scoring.score_samples(rows.coalesce(1)))
    many = scoring.scores_long(scoring.score_samples(rows.repartition(7)))
    key = lambda r: (r.sample_pos, r.inst_pos)
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key)


def test_unequal_lists_and_empty_lists(spark):
    from adherence.schemas import SAMPLES

    ids = ["punctuation:no_comma", "startend:quotation"]
    df = spark.createDataFrame(
        [("r", 0, 0, "p", "a", ids, ["{}"]), ("r", 1, 0, "p", "a", [], []), ("r", 2, 0, "p", None, ids, ["{}", "{}"]),
         ("r", 3, 0, "p", "a", None, None)], SAMPLES)
    got = {r.sample_pos: r for r in scoring.score_samples(df).collect()}
    assert [len(got[n].scores) for n in range(4)] == [1, 0, 2, 0]
    assert got[0].dropped_instructions == 1 and got[0].prompt_strict_pass
    assert got[1].prompt_strict_pass and got[3].prompt_strict_pass
    assert not got[2].prompt_strict_pass and got[2].scores[0].error
    acc = scoring.accuracy(scoring.score_samples(df)).first()
    assert (acc.num_samples, acc.num_instructions, acc.inst_strict_pass, acc.prompt_strict_pass) == (4, 3, 1, 3)


def test_fail_policy(make_samples):
    rows = make_samples(("x", [("combination:repeat_prompt", "{}")]), ("x", [("punctuation:no_comma", "{}")]))
    strict = ScoringOptions(on_error="fail")
    with pytest.raises(Exception, match="prompt_to_repeat must be set"):
        scoring.score_samples(rows, strict).collect()
    fine = make_samples(("x", [("punctuation:no_comma", "{}"), ("un:known", "{}")]))
    assert [s.strict for s in scoring.score_samples(fine, strict).first().scores] == [True, False]


def test_registered_check_with_loose_form_and_own_argument(make_samples):
    registry = default_registry().register_check(
        "my:exact_length", ["wanted_length"],
        strict=lambda response, args: F.length(response) == args["wanted_length"],
        loose=lambda response, args: F.length(F.trim(response)) == args["wanted_length"],
        arg_types={"wanted_length": "bigint"},
    )
    rows = make_samples((" ab ", [("my:exact_length", '{"wanted_length": 2}')]))
    score = scoring.score_samples(rows, ScoringOptions(registry=registry)).first().scores[0]
    assert (score.strict, score.loose, score.category) == (False, True, "my")


def test_disabled_checks_are_unknown(make_samples):
    rows = make_samples(("x", [("multi-turn:constrained_start", '{"starter": "x"}')]))
    score = scoring.score_samples(rows).first().scores[0]
    assert (score.known, score.strict, score.error) == (False, False, None)


def test_descriptions(make_samples, options):
    insts = [
        ("keywords:forbidden_words", '{"forbidden_words": ["b", "a\'s", "b"]}', 'Do not include keywords ["a\'s", \'b\'] in the response.'),
        ("length_constraints:number_words", '{"num_words": 5, "relation": "less than"}', "Answer with less than 5 words."),
        ("language:response_language", '{"language": "fi"}',
         "Your ENTIRE response should be in Finnish language, no other language is allowed."),
        ("keywords:key_sentences", "{}", "Include 1 of the following sentences {'For now, this is fine.'}"),
    ]
    rows = make_samples(*[("x", [(i, k)]) for i, k, _ in insts])
    got = scoring.describe_instructions(rows, options).orderBy("sample_pos").collect()
    assert [r.description for r in got] == [d for _, _, d in insts]


def test_scoring_adds_no_shuffle(make_samples):
    rows = make_samples(("x", [("punctuation:no_comma", "{}")]))
    plan = scoring.score_samples(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
