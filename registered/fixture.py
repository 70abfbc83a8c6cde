"""Responses and instructions derived from the given documents.

The same text is valid for Spark SQL and for the checking engine; only the casts
and the replace-all call differ. Every shape keeps the whole document text.
"""

# Ids in registry order; the last one is unknown to the registry.
INSTRUCTION_IDS = [
    "change_case:capital_word_frequency", "change_case:english_capital",
    "change_case:english_lowercase", "combination:repeat_prompt",
    "combination:two_responses", "detectable_content:number_placeholders",
    "detectable_content:postscript", "detectable_format:constrained_response",
    "detectable_format:json_format", "detectable_format:multiple_sections",
    "detectable_format:number_bullet_lists", "detectable_format:number_highlighted_sections",
    "detectable_format:title", "keywords:existence", "keywords:forbidden_words",
    "keywords:frequency", "keywords:letter_frequency", "language:response_language",
    "length_constraints:nth_paragraph_first_word", "length_constraints:number_paragraphs",
    "length_constraints:number_sentences", "length_constraints:number_words",
    "punctuation:no_comma", "startend:end_checker", "startend:quotation", "unknown:thing",
]
OFF_BY_DEFAULT = [
    "multi-turn:constrained_start", "detectable_format:rephrase", "keywords:key_sentences",
    "detectable_content:rephrase_paragraph",
]

SHAPES = """CASE (doc_id + {shift}) % 26
    WHEN 0 THEN text
    WHEN 1 THEN '"' || body || '"'
    WHEN 2 THEN CASE WHEN lang = 'en' THEN upper(body) ELSE body END
    WHEN 3 THEN CASE WHEN lang = 'en' THEN lower(body) ELSE body END
    WHEN 4 THEN replace(body, ',', '')
    WHEN 5 THEN '* ' || substr(body, 1, 80) || chr(10) || '* ' || substr(body, 81) || chr(10) || '- last'
    WHEN 6 THEN '<<' || substr(body, 1, 20) || '>>' || chr(10) || substr(body, 21)
    WHEN 7 THEN 'Section 1' || chr(10) || substr(body, 1, 100) || chr(10) || 'Section 2' || chr(10) || substr(body, 101)
    WHEN 8 THEN substr(flat, 1, 60) || chr(10) || chr(10) || '"The' || chr(39) || 's ' || substr(flat, 61, 60) || chr(10) || chr(10) || substr(flat, 121)
    WHEN 9 THEN substr(body, 1, 60) || ' *** ' || substr(body, 61, 60) || ' *** ' || substr(body, 121)
    WHEN 10 THEN body || chr(10) || 'P.S. thanks'
    WHEN 11 THEN body || chr(10) || 'P. P. S thanks'
    WHEN 12 THEN '[name] ' || body || ' [address]'
    WHEN 13 THEN '*first* ' || body || ' **second** * *'
    WHEN 14 THEN '{{"a": 1, "b": [true, null], "text": "' || escaped || '"}}'
    WHEN 15 THEN '```json' || chr(10) || '{{"a": "' || escaped || '"}}' || chr(10) || '```'
    WHEN 16 THEN '{{"a": NaN, "text": "' || escaped || '"}}'
    WHEN 17 THEN '{{' || chr(39) || 'a' || chr(39) || ': "' || escaped || '"}}'
    WHEN 18 THEN body || '******' || 'Other. ' || body
    WHEN 19 THEN body || '******' || body
    WHEN 20 THEN body || ' Any other questions?'
    WHEN 21 THEN 'My answer is yes. ' || body
    WHEN 22 THEN '12345 67890 ' || body
    WHEN 23 THEN body || chr(10) || chr(10) || body
    WHEN 24 THEN '   ' || body || '  ' || chr(10)
    ELSE 'Mr. Smith paid 3.50 to Acme Inc. He left... Really? "Yes!" Dr. A. B. Lee, Ph.D. saw www.a.com. IT WAS WELL-KNOWN. I DON' || chr(39) || 'T. ' || body
  END"""


def _text(value, dialect):
    return f"CAST({value} AS {'STRING' if dialect == 'spark' else 'VARCHAR'})"


def _json(dialect, *pairs):
    """A JSON object from (key, SQL value, quoted?) triples."""
    parts = []
    for n, (key, value, is_text) in enumerate(pairs):
        quote = '"' if is_text else ""
        parts.append(f"""'{', ' if n else '{'}"{key}": {quote}'""")
        parts.append(_text(value, dialect))
        if is_text:
            parts.append("""'"'""")
    return " || ".join(parts) + " || '}'"


RELATION = "CASE WHEN doc_id % 29 = 7 THEN 'at most' WHEN doc_id % 2 = 0 THEN 'at least' ELSE 'less than' END"


def args_sql(inst_id, dialect):
    """The JSON arguments of an instruction, varied by doc_id; some leave one out."""
    j = lambda *pairs: _json(dialect, *pairs)
    relation = ("relation", RELATION, True)

    def optional(full, less):
        return f"CASE WHEN doc_id % 13 = 5 THEN {less} ELSE {full} END"

    def word(n):
        return f"CASE WHEN lang = 'en' THEN '{n[0]}' WHEN lang = 'de' THEN '{n[1]}' ELSE '{n[2]}' END"

    table = {
        "change_case:capital_word_frequency": lambda: optional(
            j(("capital_frequency", "doc_id % 7", False), ("capital_relation", RELATION, True)),
            j(("capital_relation", RELATION, True))),
        "combination:repeat_prompt": lambda: optional(
            j(("prompt_to_repeat",
               "CASE WHEN doc_id % 2 = 0 THEN substr(replace(escaped, chr(92), ''), 1, 12) ELSE 'Tell me' END", True)),
            "'{}'"),
        "detectable_content:number_placeholders": lambda: optional(
            j(("num_placeholders", "doc_id % 4", False), ("extra", "1", False)),
            j(("num_placeholders", "-1", False))),
        "detectable_content:postscript": lambda: optional(
            j(("postscript_marker",
               "CASE doc_id % 3 WHEN 0 THEN 'P.S.' WHEN 1 THEN 'P.P.S' ELSE 'thanks' END", True)), "'{}'"),
        "detectable_format:multiple_sections": lambda: optional(
            j(("section_spliter", "CASE WHEN doc_id % 5 = 0 THEN 'SECTION' ELSE 'Section' END", True),
              ("num_sections", "doc_id % 4", False)),
            j(("section_spliter", "'Section'", True))),
        "detectable_format:number_bullet_lists": lambda: optional(
            j(("num_bullets", "CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 3 END", False)), "'{}'"),
        "detectable_format:number_highlighted_sections": lambda: optional(
            j(("num_highlights", "doc_id % 5", False)), "'{}'"),
        "keywords:existence": lambda: optional(
            f"""'{{"keywords": ["' || {word(('the', 'die', 'la'))} || '", "' || {word(('And', 'und', 'de'))} || '"]}}'""",
            """'{"keywords": []}'"""),
        "keywords:forbidden_words": lambda: optional(
            f"""'{{"forbidden_words": ["' || {word(('the', 'die', 'la'))} || '", "thanks", "thanks"]}}'""", "'{}'"),
        "keywords:frequency": lambda: optional(
            j(("keyword", word(("the", "die", "la")), True), ("frequency", "doc_id % 40", False), relation),
            j(("keyword", word(("of", "ein", "el")), True), ("frequency", "doc_id % 20", False))),
        "keywords:letter_frequency": lambda: optional(
            j(("letter", "CASE doc_id % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'a' WHEN 2 THEN 'n' ELSE '!' END", True),
              ("let_frequency", "doc_id % 300", False), ("let_relation", RELATION, True)),
            "'{}'"),
        "language:response_language": lambda: optional(
            j(("language", "CASE WHEN doc_id % 5 = 0 THEN 'fi' WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END", True)),
            "'{}'"),
        "length_constraints:nth_paragraph_first_word": lambda: optional(
            j(("num_paragraphs", "CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 3 END", False),
              ("nth_paragraph", "CASE WHEN doc_id % 11 = 0 THEN 9 ELSE 2 END", False),
              ("first_word", "CASE WHEN doc_id % 19 = 0 THEN 'Other' ELSE 'The' END", True)),
            j(("num_paragraphs", "3", False))),
        "length_constraints:number_paragraphs": lambda: optional(
            j(("num_paragraphs", "1 + 2 * (doc_id % 2)", False)), "'{}'"),
        "length_constraints:number_sentences": lambda: optional(
            j(("num_sentences", "doc_id % 60", False), relation), j(("num_sentences", "doc_id % 60", False))),
        "length_constraints:number_words": lambda: optional(
            j(("num_words", f"{_text('doc_id % 700', dialect)} || CASE doc_id % 6 WHEN 1 THEN '.0' WHEN 2 THEN '.5' ELSE '' END", False),
              relation), j(relation)),
        "startend:end_checker": lambda: optional(
            j(("end_phrase", "CASE doc_id % 3 WHEN 0 THEN ' Any other questions?' WHEN 1 THEN 'thanks' ELSE '.' END", True)),
            "'{}'"),
        "multi-turn:constrained_start": lambda: optional(
            j(("starter", "CASE doc_id % 3 WHEN 0 THEN 'My answer is' WHEN 1 THEN 'Section' ELSE 'The' END", True)),
            "'{}'"),
        "detectable_format:rephrase": lambda: j(
            ("original_message",
             "CASE WHEN doc_id % 5 = 0 THEN 'plain' ELSE '*first* ' || escaped || ' **other** * *' END", True)),
        "keywords:key_sentences": lambda: optional(
            """'{"key_sentences": ["My answer is yes.", "He left...", "Really?"], "num_sentences": ' || """
            + _text("1 + doc_id % 2", dialect) + " || '}'",
            "'{}'"),
        "detectable_content:rephrase_paragraph": lambda: j(
            ("original_paragraph", "escaped", True), ("low", "doc_id % 50", False),
            ("high", "100 + doc_id % 600", False)),
    }
    return table[inst_id]() if inst_id in table else "'{}'"


def documents_sql(dialect):
    """Documents with the text forms the shapes are made of."""
    return f"""SELECT *,
    replace(replace(replace(body, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS escaped,
    replace(body, chr(10), ' ') AS flat
  FROM (SELECT doc_id, lang, source, text, replace(text, '***', '') AS body FROM documents) b"""


def responses_sql(dialect, shift=0):
    """One response per document; another `shift` stands for another model."""
    shapes = SHAPES.format(shift=shift)
    return f"""SELECT doc_id, lang, source, escaped, {shapes} AS response
  FROM ({documents_sql(dialect)}) d"""


def _id_of(position):
    return "CASE " + position + " " + " ".join(
        f"WHEN {n} THEN '{i}'" for n, i in enumerate(INSTRUCTION_IDS)
    ) + " END"


def samples_sql(dialect, shift=0):
    """Scorable samples: empty lists, cut argument lists, unknown ids and broken
    arguments are all among them."""
    string = "STRING" if dialect == "spark" else "VARCHAR"
    array = (lambda *x: f"array({', '.join(x)})") if dialect == "spark" else (lambda *x: f"[{', '.join(x)}]")
    empty = f"CAST(array() AS ARRAY<STRING>)" if dialect == "spark" else "CAST([] AS VARCHAR[])"
    args = lambda c: f"CASE {c} " + " ".join(
        f"WHEN '{i}' THEN {args_sql(i, dialect)}" for i in INSTRUCTION_IDS
    ) + " END"
    return f"""SELECT source AS run_file, doc_id AS sample_pos, doc_id AS key,
    'Write in ' || lang || ' about item ' || CAST(doc_id AS {string}) AS prompt, response, lang,
    CASE WHEN doc_id % 10 = 9 THEN {empty} WHEN doc_id % 3 = 0 THEN {array('id_1', 'id_2')} ELSE {array('id_1')} END AS instruction_id_list,
    CASE WHEN doc_id % 10 = 9 THEN {empty} WHEN doc_id % 10 = 8 OR doc_id % 3 <> 0 THEN {array('args_1')} ELSE {array('args_1', 'args_2')} END AS kwargs
  FROM (SELECT *,
      CASE WHEN doc_id % 17 = 0 THEN 'not json' ELSE {args('id_1')} END AS args_1,
      {args('id_2')} AS args_2
    FROM (SELECT *,
        {_id_of("CAST((doc_id * 11 + CAST(floor(doc_id / 26) AS BIGINT)) % 26 AS INT)")} AS id_1,
        {_id_of("CAST((doc_id * 7 + 8) % 25 AS INT)")} AS id_2
      FROM ({responses_sql(dialect, shift)}) r) i) a"""


TRAILING = "CASE doc_id % 23 WHEN 4 THEN ' x}' WHEN 9 THEN '}' WHEN 11 THEN ' , 1]' WHEN 15 THEN ' ' ELSE '' END"


def check_samples_sql(inst_id, dialect, shift=0):
    """Every response with one and the same instruction; some arguments are no JSON,
    or are followed by something else."""
    array = (lambda x: f"array({x})") if dialect == "spark" else (lambda x: f"[{x}]")
    literal = f"'{inst_id}'"
    return f"""SELECT source AS run_file, doc_id AS sample_pos, doc_id AS key, '' AS prompt, response, lang,
    {array(literal)} AS instruction_id_list,
    {array(f"CASE WHEN doc_id % 17 = 0 THEN 'not json' ELSE {args_sql(inst_id, dialect)} END || {TRAILING}")} AS kwargs
  FROM ({responses_sql(dialect, shift)}) r"""


# Caller-supplied patterns with classes, groups and look-around: (id, arguments, the same question for the other engine).
PATTERN_CASES = [
    ("keywords:existence", '{"keywords": ["th[aeiou]", "(?:an|on) "]}', "regexp_matches(v, '(?i)th[aeiou]') AND regexp_matches(v, '(?i)(an|on) ')"),
    ("keywords:existence", '{"keywords": ["(?<=[aeiou])n(?=d)"]}', "regexp_matches(v, '(?i)[aeiou]nd')"),
    ("keywords:frequency", '{"keyword": "(ing|ion)", "frequency": 5, "relation": "at least"}', "len(regexp_extract_all(v, '(?i)(ing|ion)')) >= 5"),
    ("keywords:frequency", '{"keyword": "t(?!h)", "frequency": 20, "relation": "less than"}',
     "len(regexp_extract_all(v, '(?i)t')) - len(regexp_extract_all(v, '(?i)th')) < 20"),
    ("keywords:forbidden_words", '{"forbidden_words": ["wh[ae]n?|zz+"]}', "NOT regexp_matches(v, '(?i)((^|[^\\p{L}\\p{N}_])wh[ae]n?|zz+([^\\p{L}\\p{N}_]|$))')"),
    ("detectable_format:multiple_sections", '{"section_spliter": "(Section|SECTION)", "num_sections": 4}',
     "2 * len(regexp_extract_all(v, '(Section|SECTION)[ \\t\\n]?[0-9]+')) >= 4"),
    ("detectable_content:postscript", '{"postscript_marker": "p[.]s[.]? than(k|x)"}', "regexp_matches(lower(v), 'p[.]s[.]? than(k|x)')"),
    ("multi-turn:constrained_start", '{"starter": "(My|Your) answer"}', "regexp_matches(v, '(?m)^[ \\t\\n]*(My|Your) answer')"),
    ("keywords:existence", '{"keywords": ["(broken"]}', "FALSE"),
]


def pattern_samples_sql(dialect):
    """One pattern check a response, by its id."""
    array = (lambda x: f"array({x})") if dialect == "spark" else (lambda x: f"[{x}]")
    case = lambda k: "CASE doc_id % {} {} END".format(
        len(PATTERN_CASES), " ".join(f"WHEN {n} THEN '{c[k]}'" for n, c in enumerate(PATTERN_CASES)))
    return f"""SELECT source AS run_file, doc_id AS sample_pos, doc_id AS key, '' AS prompt, response, lang,
    {array(case(0))} AS instruction_id_list, {array(case(1))} AS kwargs FROM ({responses_sql(dialect)}) r"""


def runs_sql(dialect):
    """One scored run per source, its measures taken from the documents."""
    string = "STRING" if dialect == "spark" else "VARCHAR"
    share = lambda test: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS DOUBLE) / count(*)"
    return f"""SELECT source, source || '.json' AS file, n, 'org/model-' || source AS model_name,
    CASE WHEN n % 4 = 0 THEN './lora_' || source || '/' WHEN n % 4 = 1 THEN '' END AS lora_path,
    CASE n % 3 WHEN 0 THEN 'bf16' WHEN 1 THEN '4bit' END AS precision,
    CASE n % 5 WHEN 0 THEN 'Pretrained_' || source WHEN 1 THEN 'sft_' || source WHEN 2 THEN NULL ELSE 'org_' || source END AS run_name,
    CASE WHEN n % 7 <> 3 THEN '2026012' || CAST(n % 5 AS {string}) || '_0247' || CAST(10 + n % 2 AS {string}) END AS ts,
    num_samples, CASE n % 3 WHEN 0 THEN 20.5e0 WHEN 1 THEN 0e0 END AS gpu,
    chars / 1e3 AS generation_seconds, num_samples / 1e3 AS scoring_seconds,
    inst_strict, inst_loose, prompt_strict, prompt_loose
  FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n, count(*) AS num_samples, sum(n_chars) AS chars,
      {share("lang = 'en'")} AS inst_strict, {share("lang <> 'de'")} AS inst_loose,
      {share("n_chars > 2000")} AS prompt_strict, {share("n_chars > 1000")} AS prompt_loose
    FROM documents GROUP BY source) g"""


def odd_turns_sql():
    """Conversations some of which have lost their id (together they are one, numbered on), others a turn's number."""
    return """SELECT CASE WHEN conv_id % 11 <> 3 THEN conv_id END AS conv_id,
    CASE WHEN conv_id % 11 = 3 THEN conv_id * 1000 + turn WHEN turn > 0 OR conv_id % 7 <> 2 OR conv_id % 5 = 2 THEN turn END AS turn,
    role, text FROM conversations"""


def turns_sql():
    """The same; some user turns reset the history."""
    return f"""SELECT conv_id, turn, role,
    CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 2 THEN ' Clear ' ELSE text END AS text FROM ({odd_turns_sql()}) o"""


def instructions_sql():
    return """SELECT doc_id, 'Summarize in ' || lang || ': ' || text AS instruction,
    CASE doc_id % 4 WHEN 0 THEN '   ' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE text END AS input, text AS output
  FROM documents"""
