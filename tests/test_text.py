"""Text functions on hand-derived strings."""

from pyspark.sql import functions as F

from adherence.functions import text as t


def values(spark, fn, texts):
    rows = [(n, x) for n, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "n int, x string").select("n", fn(F.col("x")).alias("v"))
    return [r.v for r in df.orderBy("n").collect()]


def test_strip_knows_unicode_white_space(spark):
    texts = ["  a  ", "\x1ca\x1f", "\r\na\t", "   ", "", "a b", "​a"]
    assert values(spark, t.strip, texts) == [x.strip() for x in texts]


def test_word_count_counts_letters_numbers_and_underscore(spark):
    import re

    texts = ["Été à la plage", "a_b c-d", "²½ x", "Ⓐ b", "don't", "", "नमस्ते", "12.5"]
    assert values(spark, t.word_count, texts) == [len(re.findall(r"\w+", x)) for x in texts]


def test_case_predicates(spark):
    texts = ["ABC", "AB c", "ab", "ǅ", "12!", "", "ÉTÉ", "ß", "Ⓐ", "straße"]
    assert values(spark, t.is_upper, texts) == [x.isupper() for x in texts]
    assert values(spark, t.is_lower, texts) == [x.islower() for x in texts]


def test_sentence_split(spark):
    cases = {
        "Hello there. How are you? Fine!": ["Hello there.", "How are you?", "Fine!"],
        "Mr. Smith paid 3.50 to Acme Inc. He left... Really?":
            ["Mr. Smith paid 3.50 to Acme Inc", "He left...", "Really?"],
        'She said "Go." Then left.': ['She said "Go".', "Then left."],
        "Dr. A. B. Lee, Ph.D. saw www.a.com today.": ["Dr. A. B. Lee, Ph.D. saw www.", "a.com today."],
        "no end": ["no end"],
        "": [],
        "One.\nTwo.": ["One.", "Two."],
        "Wait....  then": ["Wait....", "then"],
    }
    got = values(spark, t.sentences, cases)
    for text, want, have in zip(cases, cases.values(), got):
        # the stop of a suffix before a sentence start goes, one in quotes moves out
        assert have == want, text


def test_sentence_count(spark):
    cases = {
        "": 0, "   ": 0, "One": 1, "One. Two! Three?": 3, "Wait?! Yes.": 2, "See a.com now. Ok.": 2,
        "Mr. Smith met Dr. Who. Fine.": 2, "J. R. Hartley wrote it. Yes.": 2, "Well... maybe. No.": 2,
        "Well... Maybe. No.": 3, 'He said "Stop." Then he left.': 2, "Costs 3.50 today. Ok": 2,
        "It is, e.g. a test. Yes": 2, "The U.S. economy grew. Good.": 2,
    }
    assert values(spark, t.sentence_count, cases) == list(cases.values())


def test_tokens(spark):
    cases = {
        "I CAN'T GO.": ["I", "CA", "N'T", "GO", "."],
        "WELL-KNOWN, it's": ["WELL-KNOWN", ",", "it", "'s"],
        "cannot (go)": ["can", "not", "(", "go", ")"],
        "a--b 3,000": ["a", "--", "b", "3,000"],
        'say "hi"': ["say", "``", "hi", "''"],
        "wait...": ["wait", "..."],
        "U.S. is": ["U.S.", "is"],
        "": [],
    }
    assert values(spark, t.word_tokens, cases) == list(cases.values())


def test_capital_count_equals_the_count_over_all_tokens(spark):
    texts = ["IT'S THE WELL-KNOWN CANNOT Dr. Who x", "abc DEF,GHI (JKL) iPHONE", "Ein Ärger ÄRGER", "", "A. B. C"]
    full = lambda c: F.size(F.filter(t.word_tokens(c), t.is_upper))
    assert values(spark, t.capital_word_count, texts) == values(spark, full, texts)


def test_shared_words_is_the_multiset_intersection(spark):
    from collections import Counter
    import re

    pairs = [("the cat the dog", "The dog the the bird"), ("", "a"), ("a a a b", "a a b b"), ("x", "")]
    words = lambda s: Counter(re.findall(r"\w+", s.lower()))
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, a string, b string")
    got = df.select("n", t.shared_word_count(F.col("a"), F.col("b")).alias("v")).orderBy("n").collect()
    assert [r.v for r in got] == [sum((words(a) & words(b)).values()) for a, b in pairs]


def test_json_body_takes_one_fence_off(spark):
    texts = ["```json\n{}\n```", "```JSON {}", "```Json\n[1]```", "``` 1 ```", " {} ", "```json```json{}```", "```"]
    want = ["{}", "{}", "[1]", "1", "{}", "json{}", ""]
    assert values(spark, t.json_body, texts) == want


def test_quoted_literals(spark):
    texts = ["a", "it's", 'say "x"', "a\\b", "l\nm"]
    assert values(spark, t.quoted, texts) == [repr(x) for x in texts]


def test_words_of_a_paragraph_are_compared_once(spark):
    """One comparison a row, without a comparison function for the sort."""
    from dataclasses import replace

    from adherence.operators import scoring
    from adherence.operators.checks import Registry, default_registry
    from adherence.schemas import SAMPLES

    inst_id = "detectable_content:rephrase_paragraph"
    options = scoring.ScoringOptions(registry=Registry([replace(default_registry()[inst_id], enabled=True)]))
    given = '{"original_paragraph": "b a b A a", "low": 3, "high": 4}'
    rows = [("r", n, n, "", x, [inst_id], [given]) for n, x in enumerate(["a a b", "B A a a c", "a a", "a a b b a"])]
    scored = scoring.scores_long(scoring.score_samples(spark.createDataFrame(rows, SAMPLES), options))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1 and "array_sort(" not in plan
    assert [r.strict for r in scored.orderBy("sample_pos").collect()] == [True, True, False, False]
