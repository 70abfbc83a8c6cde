"""The sentence that states an instruction to the model, with its arguments."""

from pyspark.sql import Column, functions as F

from adherence.functions import text as t
from adherence.functions.draws import draw_between
from adherence.operators import checks as k
from adherence.schemas import NUMBERS

# The wording of the instructions.
TEMPLATES = {
    "language:response_language":
        "Your ENTIRE response should be in {language} language, no other language is allowed.",
    "length_constraints:number_sentences":
        "Your response should contain {relation} {num_sentences} sentences.",
    "detectable_content:number_placeholders":
        "The response must contain at least {num_placeholders} placeholders "
        "represented by square brackets, such as [address].",
    "detectable_format:number_bullet_lists":
        "Your answer must contain exactly {num_bullets} bullet points. "
        "Use the markdown bullet points such as:\n* This is point 1. \n* This is point 2",
    "detectable_format:constrained_response":
        "Answer with one of the following options: "
        "('My answer is yes.', 'My answer is no.', 'My answer is maybe.')",
    "multi-turn:constrained_start":
        "During the conversation, when it is your turn, please always start with {starter}",
    "detectable_format:number_highlighted_sections":
        "Highlight at least {num_highlights} sections in your answer with markdown, "
        "i.e. *highlighted section*.",
    "detectable_format:multiple_sections":
        "Your response must have {num_sections} sections. Mark the beginning of each section "
        "with {section_spliter} X, such as:\n{section_spliter} 1\n[content of section 1]\n"
        "{section_spliter} 2\n[content of section 2]",
    "length_constraints:number_paragraphs":
        "There should be {num_paragraphs} paragraphs. "
        "Paragraphs are separated with the markdown divider: ***",
    "detectable_content:postscript":
        "At the end of your response, please explicitly add a postscript "
        "starting with {postscript_marker}",
    "detectable_format:rephrase":
        "Rephrasing: Your rephrased response should onlychange the words/sentences "
        "in between two asteriskssuch as *change me*.",
    "keywords:existence": "Include keywords {keywords} in the response.",
    "keywords:frequency":
        "In your response, the word {keyword} should appear {relation} {frequency} times.",
    "length_constraints:number_words": "Answer with {relation} {num_words} words.",
    "detectable_format:json_format":
        "Entire output should be wrapped in JSON format. You can use markdown ticks such as ```.",
    "length_constraints:nth_paragraph_first_word":
        "There should be {num_paragraphs} paragraphs. Paragraphs and only paragraphs are "
        "separated with each other by two new lines as if it was '\\n\\n' in python. "
        "Paragraph {nth_paragraph} must start with word {first_word}.",
    "keywords:key_sentences": "Include {num_sentences} of the following sentences {key_sentences}",
    "keywords:forbidden_words": "Do not include keywords {forbidden_words} in the response.",
    "detectable_content:rephrase_paragraph":
        "Rephrase the following paragraph: {original_paragraph}\nYour response should have "
        "between {low} and {high} of the same words. Words are the same if and only if all of "
        "the letters, ignoring cases, are the same. For example, 'run' is the same as 'Run' "
        "but different to 'ran'.",
    "combination:two_responses":
        "Give two different responses. Responses and only responses should be separated by 6 "
        "asterisk symbols: ******.",
    "combination:repeat_prompt":
        "First repeat the request word for word without change, then give your answer (1. do "
        "not say any words or characters before repeating the request; 2. the request you need "
        "to repeat does not include this sentence)",
    "startend:end_checker":
        "Finish your response with this exact phrase {end_phrase}. "
        "No other words should follow this phrase.",
    "detectable_format:title":
        "Your answer must contain a title, wrapped in double angular brackets, "
        "such as <<poem of joy>>.",
    "keywords:letter_frequency":
        "In your response, the letter {letter} should appear {let_relation} {let_frequency} times.",
    "change_case:english_capital":
        "Your entire response should be in English, and in all capital letters.",
    "change_case:english_lowercase":
        "Your entire response should be in English, and in all lowercase letters. "
        "No capital letters are allowed.",
    "punctuation:no_comma": "In your entire response, refrain from the use of any commas.",
    "change_case:capital_word_frequency":
        "In your response, words with all capital letters should appear "
        "{capital_relation} {capital_frequency} times.",
    "startend:quotation": "Wrap your entire response with double quotation marks.",
}


def spelled(number) -> Column:
    """A whole number without a point."""
    number = number.cast("double")
    whole = number == F.floor(number)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def fill(template, **values) -> Column:
    """The template with its {names} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _language_name(i):
    code = i.choice("language", list(k.LANGUAGE_NAMES))
    names = F.lit(",".join(f"{c}:{n}" for c, n in k.LANGUAGE_NAMES.items()))
    return F.str_to_map(names, F.lit(","), F.lit(":"))[code]


def _nth(i):
    total, given = i.number("num_paragraphs", 1, 5), i.arg("nth_paragraph")
    drawn = draw_between(i.row_id, "nth_paragraph", F.lit(1), total + 1)
    return F.when(given.isNull() | (given <= 0) | (given > total), drawn).otherwise(given)


def _key_sentences(i):
    given = i.arg("key_sentences")
    default = F.lit("{" + ", ".join(f"'{s}'" for s in k.DEFAULT_KEY_SENTENCES) + "}")
    return F.when(F.size(given) > 0, t.quoted_list(given)).otherwise(default)


def _key_sentence_number(i):
    n = F.when(F.size(i.arg("key_sentences")) > 0, F.size(i.arg("key_sentences"))).otherwise(
        len(k.DEFAULT_KEY_SENTENCES)
    )
    number = i.arg("num_sentences")
    drawn = draw_between(i.row_id, "num_sentences", F.lit(1), n)
    return F.when(number.isNull() | (number == 0), drawn).otherwise(number)


def _sorted_words(name, distinct=False):
    def value(i):
        words = i.keywords(name, 2)
        return t.quoted_list(F.array_sort(F.array_distinct(words) if distinct else words))

    return value


# How an argument shows up in the wording, where it is not simply a number.
VALUES = {
    "language": _language_name,
    "relation": lambda i: i.relation(),
    "let_relation": lambda i: i.relation("let_relation"),
    "capital_relation": lambda i: i.relation("capital_relation"),
    "num_placeholders": lambda i: i.number("num_placeholders", 1, 4),
    "num_bullets": lambda i: i.number("num_bullets", 1, 5),
    "num_highlights": lambda i: i.number("num_highlights", 1, 4),
    "num_sections": lambda i: i.number("num_sections", 1, 5),
    "num_paragraphs": lambda i: i.number("num_paragraphs", 1, 5),
    "num_words": lambda i: i.number("num_words", 100, 500),
    "frequency": lambda i: i.number("frequency", 1, 3),
    "let_frequency": lambda i: i.number("let_frequency", 1, 10),
    "capital_frequency": lambda i: F.coalesce(
        i.arg("capital_frequency"), draw_between(i.row_id, "capital_frequency", 1, 20)),
    "starter": lambda i: i.choice("starter", k.STARTER_OPTIONS, t.strip),
    "section_spliter": lambda i: i.choice("section_spliter", k.SECTION_SPLITERS, t.strip),
    "postscript_marker": lambda i: i.choice("postscript_marker", k.POSTSCRIPT_MARKERS, t.strip),
    "end_phrase": lambda i: i.choice("end_phrase", k.ENDING_OPTIONS, t.strip),
    "keywords": _sorted_words("keywords"),
    "forbidden_words": _sorted_words("forbidden_words", distinct=True),
    "keyword": lambda i: t.strip(i.keyword("keyword", k._no_keyword(i))),
    "first_word": lambda i: F.lower(i.keyword("first_word", i.arg("first_word").isNull())),
    "nth_paragraph": _nth,
    "letter": k._letter,
    "key_sentences": _key_sentences,
    "original_paragraph": lambda i: i.arg("original_paragraph"),
    "low": lambda i: i.arg("low"),
    "high": lambda i: i.arg("high"),
}


def _describer(inst_id, template):
    def describe(i):
        values = {n: f(i) for n, f in VALUES.items() if "{" + n + "}" in template}
        if "{num_sentences}" in template:
            key = inst_id == "keywords:key_sentences"
            values["num_sentences"] = (
                _key_sentence_number(i) if key else i.number("num_sentences", 1, 20)
            )
        return fill(template, **{n: spelled(v) if n in NUMBERS else v for n, v in values.items()})

    return describe


DESCRIPTIONS = {inst_id: _describer(inst_id, text) for inst_id, text in TEMPLATES.items()}
