"""The checks in plain SQL for the checking engine, over columns

    v    response text          j    arguments, a JSON object
    rid  row identity           det  detected language (language checks only)

Formulated on their own: string functions and RE2 patterns, no look-around.
"""

from registered import expected as k
from registered.expected import ABBREVIATIONS, CLOSERS, DOMAINS, SENTENCE_QUOTES, SPACES, SUFFIXES, TITLES


def lit(text):
    return "'" + text.replace("'", "''") + "'"


SP = lit(SPACES)
W = "[\\p{L}\\p{N}_]"
NW = "[^\\p{L}\\p{N}_]"


def strip(x):
    return f"trim({x}, {SP})"


def count(x, pattern):
    return f"len(regexp_extract_all({x}, {pattern if pattern.startswith('(') and '||' in pattern else lit(pattern)}))"


def sub(x, pattern, replacement):
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement.replace('$', chr(92)))}, 'g')"


def text(name):
    return f"json_extract_string(j, '$.{name}')"


def number(name):
    return f"CAST({text(name)} AS DOUBLE)"


def words(name):
    return f"json_extract_string(j, '$.{name}[*]')"


def draw(name, n):
    return f"(CAST('0x' || substr(md5(rid || '|{name}'), 1, 8) AS BIGINT) % ({n}))"


def between(name, low, high):
    return f"({low} + {draw(name, f'({high}) - ({low}) + 1')})"


def one_of(name, options):
    values = "[" + ", ".join(lit(o) for o in options) + "]"
    return f"({values})[1 + {draw(name, len(options))}]"


def sampled(name, n):
    """Different words by index: the j-th draw is of all but the last n - j, and gives way to the last of those if taken."""
    pool, size = f"[{', '.join(lit(w) for w in k.DEFAULT_KEYWORD_POOL)}]", len(k.DEFAULT_KEYWORD_POOL)
    chosen = "CAST([] AS BIGINT[])"
    for j in range(n):
        top = f"({size} - {n} + {j})"
        t = draw(f"{name}|{j}", f"{top} + 1")
        chosen = (f"list_transform([{{'c': {chosen}, 't': {t}}}], "
                  f"lambda s: list_append(s.c, CASE WHEN list_contains(s.c, s.t) THEN {top} ELSE s.t END))[1]")
    return f"list_transform({chosen}, lambda i: ({pool})[i + 1])"


def unset(name):
    return f"({number(name)} IS NULL OR {number(name)} < 0)"


def num(name, low, high):
    return f"CASE WHEN {unset(name)} THEN {between(name, low, high)} ELSE {number(name)} END"


def choice(name, options):
    return f"coalesce({strip(text(name))}, {one_of(name, options)})"


def rel(name="relation"):
    return choice(name, k.RELATIONS)


def compare(n, threshold, relation):
    return f"CASE WHEN {relation} = 'less than' THEN {n} < {threshold} ELSE {n} >= {threshold} END"


def bad_rel(name="relation"):
    return f"({text(name)} NOT IN ('less than', 'at least'))"


def keywords(name, n):
    return f"CASE WHEN len({words(name)}) > 0 THEN {words(name)} ELSE {sampled(name, n)} END"


def word_count(x):
    return count(x, W + "+")


def is_upper(x):
    return f"(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def is_lower(x):
    return f"(regexp_matches({x}, '\\p{{Ll}}') AND NOT regexp_matches({x}, '[\\p{{Lu}}\\p{{Lt}}]'))"


STARTERS = "|".join(
    w if w.isupper() else w for w in
    ["Mr", "Mrs", "Ms", "Dr", "Prof", "Capt", "Cpt", "Lt"]
    + [f"{w}[{SPACES}]" for w in ["He", "She", "It", "They", "Their", "Our", "We", "But", "However", "That", "This"]]
    + ["Wherever"]
)


def sentences(x):
    t = f"' ' || replace({x}, chr(10), ' ') || '  '"
    t = f"({t})"
    t = sub(t, f"({TITLES})[.]", "$1<prd>")
    t = sub(t, f"[.]({DOMAINS})", "<prd>$1")
    t = sub(t, "([0-9])[.]([0-9])", "$1<prd>$2")
    # lone stops are set aside, what is left are runs of stops
    for _ in range(2):
        t = sub(t, "([^.])[.]([^.])", "$1<one>$2")
    t = sub(t, "([.]{2,})", "$1<stop>")
    t = f"replace({t}, '.', '<prd>')"
    t = f"replace({t}, '<one>', '.')"
    t = f"replace({t}, 'Ph.D.', 'Ph<prd>D<prd>')"
    t = sub(t, f"[{SPACES}]([A-Za-z])[.] ", " $1<prd> ")
    t = sub(t, f"([A-Z][.][A-Z][.](?:[A-Z][.])?) ({STARTERS})", "$1<stop> $2")
    t = sub(t, "([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>$3<prd>")
    t = sub(t, "([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>")
    t = sub(t, f" ({SUFFIXES})[.] ({STARTERS})", " $1<stop> $2")
    t = sub(t, f" ({SUFFIXES})[.]", " $1<prd>")
    t = sub(t, " ([A-Za-z])[.]", " $1<prd>")
    for old, new in SENTENCE_QUOTES:
        t = f"replace({t}, {lit(old)}, {lit(new)})"
    for mark in ".?!":
        t = f"replace({t}, '{mark}', '{mark}<stop>')"
    t = f"replace({t}, '<prd>', '.')"
    pieces = f"list_transform(string_split({t}, '<stop>'), lambda s: {strip('s')})"
    return f"list_transform([{pieces}], lambda p: CASE WHEN p[-1] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END)[1]"


def sentence_count(x):
    ws = f"[{SPACES}]"
    known = "|".join(a.replace(".", "[.]") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
    t = strip(x)
    t = sub(t, f"[.]{{2,}}({ws}+[^\\p{{Lu}}{SPACES}])", "<prd>$1")
    for _ in range(2):
        t = sub(t, f"(^|[^\\p{{L}}\\p{{N}}])((?:\\p{{L}}[.])*\\p{{L}})[.]({ws})", "$1$2<prd>$3")
    for _ in range(2):
        t = sub(t, f"(^|[^\\p{{L}}\\p{{N}}])({known})[.]({ws})", "$1$2<prd>$3")
    return f"CASE WHEN {strip(x)} = '' THEN 0 ELSE {count(t, '[.?!]+' + CLOSERS + ws + '+')} + 1 END"


# Characters around a word, and those before the first one of a sentence.
AROUND = "\"'“”‘’()[]{}«»,;:*_<>-"
OPENING = "[\"'“”‘’(\\[{«*_<-]*"
TYPE = "\\p{L}(?:[\\p{L}.]*\\p{L})?"
INITIALS = "^(?:\\p{L}[.])*\\p{L}$"


def _log_odds(k, n, p):
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


def sentence_ctes(source):
    """CTEs abbreviation(word) and starter(word): log-likelihood ratios of the token counts
    of `source`, a statement with a column v."""
    tokens = f"list_filter(regexp_split_to_array({strip('v')}, {lit('[' + SPACES + ']+')}), lambda w: w <> '')"
    core = lambda x: f"trim({x}, {lit(AROUND)})"
    stopped = lambda x: f"regexp_matches({x}, '(^|[^.])[.]$')"
    kind = lambda x: (f"CASE WHEN regexp_matches(CASE WHEN {stopped(x)} THEN left({x}, length({x}) - 1) ELSE {x} END, {lit('^' + TYPE + '$')}) "  # noqa: E731
                      f"THEN lower(CASE WHEN {stopped(x)} THEN left({x}, length({x}) - 1) ELSE {x} END) END")
    return f"""sent_list AS MATERIALIZED (SELECT {tokens} AS w FROM ({source}) src),
sent_pair AS MATERIALIZED (SELECT {core('token')} AS core, {core('before')} AS prior,
    lower(regexp_extract(token, {lit('^' + OPENING + '([' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+)')}, 1)) AS word
  FROM (SELECT unnest(w) AS token, unnest(list_concat([''], w[1:len(w) - 1])) AS before FROM sent_list WHERE len(w) > 0)),
sent_type AS (SELECT {kind('core')} AS word, count(*)::DOUBLE AS n, sum({stopped('core')}::INT)::DOUBLE AS k FROM sent_pair GROUP BY 1),
sent_all AS (SELECT sum(n) AS tokens, sum(k) AS stops FROM sent_type),
abbreviation AS MATERIALIZED (SELECT word FROM (
    SELECT word, -2 * ({_log_odds('k', 'n', '(stops / tokens)')} - {_log_odds('k', 'n', '0.99::DOUBLE')}) * exp(-letters) * (inner_stops + 1)
      * pow(letters, k - n) AS score
    FROM (SELECT *, length(word) - length(replace(word, '.', '')) AS inner_stops, length(replace(word, '.', ''))::DOUBLE AS letters
      FROM sent_type, sent_all WHERE word IS NOT NULL AND k > 0)) WHERE score >= 0.3),
sent_start AS (SELECT word, count(*)::DOUBLE AS n, sum(starts::INT)::DOUBLE AS k FROM (
    SELECT word, regexp_matches(prior, '[.?!]$') AND NOT regexp_matches(prior, '[.][.]$') AND NOT coalesce({stopped('prior')}
      AND (kind IN (SELECT word FROM abbreviation) OR regexp_matches(kind, {lit(INITIALS)})), FALSE) AS starts
    FROM (SELECT *, {kind('prior')} AS kind FROM sent_pair)) GROUP BY word),
sent_total AS (SELECT sum(n) AS tokens, sum(k) AS starts FROM sent_start),
starter AS MATERIALIZED (SELECT word FROM (
    SELECT word, n / tokens AS p, k / starts AS p1, (n - k) / greatest(tokens - starts, 1) AS p2,
      -2 * ({_log_odds('k', 'starts', 'p')} + {_log_odds('(n - k)', '(tokens - starts)', 'p')}
        - {_log_odds('k', 'starts', 'p1')} - {_log_odds('(n - k)', '(tokens - starts)', 'p2')}) AS score
    FROM sent_start, sent_total WHERE word <> '' AND k > 0) WHERE p1 > p AND score >= 30)"""


def learned_sentence_count(x):
    """Sentences of x, token by token, with the words of sentence_ctes."""
    s = strip(x)
    short = f"regexp_extract(w[i], {lit('(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}.])(' + TYPE + ')[.]$')}, 1)"
    after = f"regexp_extract(w[i + 1], {lit('^' + OPENING + '([' + chr(92) + 'p{L}' + chr(92) + 'p{N}]*)')}, 1)"
    opens = f"(regexp_matches({after}, '^{chr(92)}p{{Lu}}') AND list_contains(known[1].starters, lower({after})))"
    within = (f"({short} <> '' AND (regexp_matches({short}, {lit(INITIALS)}) OR (list_contains(known[1].abbreviations, lower({short})) AND NOT {opens}))) "
              f"OR (regexp_matches(w[i], '[.][.]$') AND NOT regexp_matches(w[i + 1], '^{chr(92)}p{{Lu}}'))")
    ends = f"regexp_matches(w[i], {lit('[.?!]' + CLOSERS + '$')})"
    on = lambda e: e.replace("w[", "r.w[").replace("known[", "r.known[")
    ends_, within_ = on(ends), on(within)
    known = ("[{'abbreviations': (SELECT coalesce(list(word), []) FROM abbreviation), 'starters': (SELECT coalesce(list(word), []) FROM starter)}]")
    return (f"CASE WHEN {s} = '' THEN 0 ELSE 1 + list_transform([{{'w': regexp_split_to_array({s}, {lit('[' + SPACES + ']+')}), 'known': {known}}}], "
            f"lambda r: list_sum(list_transform(range(1, len(r.w)), lambda i: CASE WHEN ({ends_}) AND NOT ({within_}) THEN 1 ELSE 0 END)))[1] END")


# Token rules one by one: (pattern, replacement); the last ones need spaces around.
TOKEN_RULES = [
    (r'(^|[ (\[{<])"', "$1 `` "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"([^.])(\.)([\])}>\"'»”’ ]*)$", "$1 $2 $3 "),
    (r"([«“‘„»”’])", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r"([;@#$%&?!*])", " $1 "),
    (r"([\[\](){}<>])", " $1 "),
    (r"(--)", " $1 "),
    (r'"', " '' "),
    (r"([^' ])('[sSmMdD]|'|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)(^| )(can)(not) ", "$1$2 $3 "),
    (r"(?i)(^| )(gim|lem)(me) ", "$1$2 $3 "),
    (r"(?i)(^| )(gon|wan)(na) ", "$1$2 $3 "),
    (r"(?i)(^| )(got)(ta) ", "$1$2 $3 "),
    (r"(?i)(^| )(d)('ye) ", "$1$2 $3 "),
    (r"(?i)(^| )('t)(is|was) ", "$1$2 $3 "),
]


def tokens(x):
    t = sub(strip(x), f"[{SPACES}]+", " ")
    for pattern, replacement in TOKEN_RULES[:4]:
        t = sub(t, pattern, replacement)
    t = f"(' ' || {t} || ' ')"
    for pattern, replacement in TOKEN_RULES[4:]:
        t = sub(t, pattern, replacement)
    return f"list_filter(string_split_regex({t}, ' +'), lambda w: w <> '')"


def shared_words(a, b):
    bag = lambda x: f"list_aggregate(regexp_extract_all(lower({x}), {lit(W + '+')}), 'histogram')"
    # histograms as maps; a missing word counts zero
    return (
        f"list_transform([{{'a': {bag(a)}, 'b': {bag(b)}}}], lambda m: coalesce(list_sum(list_transform("
        "map_keys(m.a), lambda w: least(m.a[w], coalesce(m.b[w], 0)))), 0))[1]"
    )


def json_body(x):
    opened = f"regexp_replace({strip(x)}, '^(?:```json)?(?:```Json)?(?:```JSON)?(?:```)?', '')"
    return strip(f"regexp_replace({opened}, '```$', '')")


def _pieces(split, verdict):
    """Blank pieces at the ends only, and a verdict on the full pieces."""
    full = f"list_filter(p, lambda q: {strip('q')} <> '')"
    inner = f"len(list_filter(list_slice(p, 2, len(p) - 1), lambda q: {strip('q')} = '')) = 0"
    return f"list_transform([{split}], lambda p: {inner} AND ({verdict(full)}))[1]"


def _nth():
    total = num("num_paragraphs", 1, 5)
    given = number("nth_paragraph")
    nth = (f"CASE WHEN {given} IS NULL OR {given} <= 0 OR {given} > {total} "
           f"THEN {between('nth_paragraph', 1, f'({total}) + 1')} ELSE {given} END")
    wanted = f"lower(coalesce({text('first_word')}, ({sampled('first_word', 1)})[1]))"
    full = f"len(list_filter(p, lambda q: {strip('q')} <> ''))"
    paragraph = strip(f"p[CAST(floor({nth}) AS BIGINT)]")
    token = f"regexp_extract({paragraph}, {lit('^[^' + SPACES + ']+')})"
    token = f"ltrim(ltrim({token}, ''''), '\"')"
    first = f"lower(regexp_extract({token}, {lit('^[^.,?!' + chr(39) + chr(34) + ']*')}))"
    return (f"list_transform([string_split(v, chr(10) || chr(10))], lambda p: ({nth}) <= {full} "
            f"AND {paragraph} <> '' AND {full} = {total} AND {first} = {wanted})[1]")


def _letter():
    given = text("letter")
    return (f"CASE WHEN regexp_matches(lower({given}), '^[a-z]$') THEN lower({given}) "
            f"ELSE {one_of('letter', k.LETTERS)} END")


def _found(list_, pattern):
    return f"len(list_filter({list_}, lambda w: regexp_matches(v, {pattern})))"


def _sections():
    ws = "[" + SPACES + "]"
    spliter = choice("section_spliter", k.SECTION_SPLITERS)
    pattern = f"({lit(ws + '?')} || {spliter} || {lit(ws + '?[0-9]+' + ws + '?')})"
    return f"len(regexp_extract_all(v, {pattern})) >= {num('num_sections', 1, 5)}"


def _postscript():
    marker = choice("postscript_marker", k.POSTSCRIPT_MARKERS)
    ws = "[" + SPACES + "]?"
    return (f"CASE WHEN {marker} = 'P.P.S' THEN regexp_matches(lower(v), {lit('p[.]' + ws + 'p[.]' + ws + 's')}) "
            f"WHEN {marker} = 'P.S.' THEN regexp_matches(lower(v), {lit('p[.]' + ws + 's[.]')}) "
            f"ELSE contains(lower(v), lower({marker})) END")


def _highlights():
    full = lambda p: f"len(list_filter(regexp_extract_all(v, {lit(p)}, 1), lambda q: {strip('q')} <> ''))"
    return full(r"\*([^\n*]*)\*") + " + " + full(r"\*\*([^\n*]*)\*\*")


def _ending():
    return (f"suffix(lower(trim({strip('v')}, '\"')), "
            f"lower({strip(choice('end_phrase', k.ENDING_OPTIONS))}))")


def _key_sentences():
    wanted = words("key_sentences")
    wanted = f"CASE WHEN len({wanted}) > 0 THEN {wanted} ELSE ['For now, this is fine.'] END"
    n = (f"CASE WHEN coalesce({number('num_sentences')}, 0) = 0 "
         f"THEN {between('num_sentences', 1, 'len(' + wanted + ')')} ELSE {number('num_sentences')} END")
    return (f"list_transform([{sentences('v')}], lambda h: len(list_filter({wanted}, "
            f"lambda s: list_contains(h, s))) = {n})[1]")


WS1 = "[" + SPACES + "]"
NOT_WS1 = "[^" + SPACES + "]"
CHANGE = r"\*[^\n]*\*"

# id: (passes, cannot be checked, argument was drawn)
CHECKS = {
    "keywords:existence": (
        f"{_found(keywords('keywords', 2), chr(39) + '(?i)' + chr(39) + ' || w')} = len({keywords('keywords', 2)})",
        "FALSE", f"len({words('keywords')}) = 0"),
    "keywords:frequency": (
        compare(count("v", f"('(?i)' || {strip('coalesce(nullif(' + text('keyword') + ', ' + chr(39) * 2 + '), (' + sampled('keyword', 1) + ')[1])')})"),
                num("frequency", 1, 3), rel()),
        bad_rel(), f"coalesce({text('keyword')}, '') = '' OR {unset('frequency')} OR {text('relation')} IS NULL"),
    "keywords:forbidden_words": (
        f"{_found(keywords('forbidden_words', 2), lit('(?i)(^|' + NW + ')') + ' || w || ' + lit('(' + NW + '|$)'))} = 0",
        "FALSE", f"len({words('forbidden_words')}) = 0"),
    "keywords:letter_frequency": (
        compare(f"(length(lower(v)) - length(replace(lower(v), {_letter()}, '')))",
                num("let_frequency", 1, 10), rel("let_relation")),
        bad_rel("let_relation"),
        f"NOT coalesce(regexp_matches(lower({text('letter')}), '^[a-z]$'), FALSE) OR {unset('let_frequency')} OR {text('let_relation')} IS NULL"),
    "language:response_language": (
        f"coalesce(det = {choice('language', list(k.LANGUAGE_NAMES))}, TRUE)",
        f"{choice('language', list(k.LANGUAGE_NAMES))} NOT IN (SELECT lang FROM documents)", f"{text('language')} IS NULL"),
    "length_constraints:number_sentences": (
        compare(sentence_count("v"), num("num_sentences", 1, 20), rel()),
        bad_rel(), f"{unset('num_sentences')} OR {text('relation')} IS NULL"),
    "length_constraints:number_paragraphs": (
        _pieces(f"string_split_regex(v, {lit(WS1 + '?[*]{3}' + WS1 + '?')})",
                lambda full: f"len({full}) = {num('num_paragraphs', 1, 5)}"),
        "FALSE", unset("num_paragraphs")),
    "length_constraints:number_words": (
        compare(word_count("v"), num("num_words", 100, 500), rel()),
        bad_rel(), f"{unset('num_words')} OR {text('relation')} IS NULL"),
    "length_constraints:nth_paragraph_first_word": (
        _nth(), "FALSE",
        f"{unset('num_paragraphs')} OR {text('nth_paragraph')} IS NULL OR {text('first_word')} IS NULL "
        f"OR {number('nth_paragraph')} <= 0 OR {number('nth_paragraph')} > {number('num_paragraphs')}"),
    "detectable_content:number_placeholders": (
        count("v", r"\[[^\n]*?\]") + f" >= {num('num_placeholders', 1, 4)}", "FALSE", unset("num_placeholders")),
    "detectable_content:postscript": (_postscript(), "FALSE", f"{text('postscript_marker')} IS NULL"),
    "detectable_format:number_bullet_lists": (
        count("v", f"(?m)^{WS1}*[*][^*][^\\n]*$") + " + " + count("v", f"(?m)^{WS1}*-[^\\n]*$")
        + f" = {num('num_bullets', 1, 5)}",
        "FALSE", unset("num_bullets")),
    "detectable_format:constrained_response": (
        " OR ".join(f"contains(v, {lit(o)})" for o in k.CONSTRAINED_RESPONSES), "FALSE", "FALSE"),
    "detectable_format:number_highlighted_sections": (
        f"{_highlights()} >= {num('num_highlights', 1, 4)}", "FALSE", unset("num_highlights")),
    "detectable_format:multiple_sections": (
        _sections(), "FALSE", f"{unset('num_sections')} OR {text('section_spliter')} IS NULL"),
    "detectable_format:json_format": (f"json_valid({json_body('v')})", "FALSE", "FALSE"),
    "detectable_format:title": (
        f"len(list_filter(regexp_extract_all(v, {lit('<<[^' + chr(92) + 'n]+>>')}), "
        f"lambda q: {strip('rtrim(ltrim(q, ' + lit('<') + '), ' + lit('>') + ')')} <> '')) > 0", "FALSE", "FALSE"),
    "combination:two_responses": (
        _pieces("string_split(v, '******')",
                lambda full: f"len({full}) = 2 AND {strip('(' + full + ')[1]')} <> {strip('(' + full + ')[2]')}"),
        "FALSE", "FALSE"),
    "combination:repeat_prompt": (
        f"starts_with(lower({strip('v')}), lower({strip(text('prompt_to_repeat'))}))",
        f"coalesce({text('prompt_to_repeat')}, '') = ''", "FALSE"),
    "startend:end_checker": (_ending(), "FALSE", f"{text('end_phrase')} IS NULL"),
    "change_case:capital_word_frequency": (
        compare(f"len(list_filter({tokens('v')}, lambda w: {is_upper('w')}))",
                f"coalesce({number('capital_frequency')}, {between('capital_frequency', 1, 20)})",
                rel("capital_relation")),
        bad_rel("capital_relation"),
        f"{text('capital_frequency')} IS NULL OR {text('capital_relation')} IS NULL"),
    "change_case:english_capital": (f"{is_upper('v')} AND coalesce(det = 'en', TRUE)", "FALSE", "FALSE"),
    "change_case:english_lowercase": (f"{is_lower('v')} AND coalesce(det = 'en', TRUE)", "FALSE", "FALSE"),
    "punctuation:no_comma": ("instr(v, ',') = 0", "FALSE", "FALSE"),
    "startend:quotation": (
        f"length({strip('v')}) > 1 AND left({strip('v')}, 1) = '\"' AND right({strip('v')}, 1) = '\"'",
        "FALSE", "FALSE"),
    "multi-turn:constrained_start": (
        f"regexp_matches(v, {lit('(?m)^' + WS1 + '*')} || {choice('starter', k.STARTER_OPTIONS)})",
        "FALSE", f"{text('starter')} IS NULL"),
    "detectable_format:rephrase": (
        f"{sub('v', CHANGE, '')} = {sub(text('original_message'), CHANGE, '')}",
        f"{text('original_message')} IS NULL OR NOT regexp_matches({text('original_message')}, {lit(CHANGE)}) "
        f"OR NOT regexp_matches(v, {lit(CHANGE)})", "FALSE"),
    "keywords:key_sentences": (
        _key_sentences(), "FALSE", f"len({words('key_sentences')}) = 0 OR coalesce({number('num_sentences')}, 0) = 0"),
    "detectable_content:rephrase_paragraph": (
        f"{shared_words(text('original_paragraph'), 'v')} BETWEEN {number('low')} AND {number('high')}",
        f"{text('original_paragraph')} IS NULL OR {text('low')} IS NULL OR {text('high')} IS NULL", "FALSE"),
}
LANGUAGE_CHECKS = k.LANGUAGE_CHECKS

ADDRESS = r"https?://[-_.?&~;+=/#0-9A-Za-z]+|[-_.0-9A-Za-z]+@[-_0-9A-Za-z]+[-_.0-9A-Za-z]+"


def _grams(source):
    """(id, g) of every overlapping trigram of `source`, a query with id and t."""
    return (f"SELECT id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g "
            f"FROM (SELECT id, string_split(t, '') AS c FROM ({source}))")


def clean(x):
    return f"lower(regexp_replace({x}, '{ADDRESS}', ' ', 'g'))"


def detection_ctes(wanted):
    """CTEs ending in detected(id, det): the language model as counts and sums,
    trained on documents, applied to `wanted`, a query with id and v."""
    return f"""gram_lang AS (
  SELECT d.lang, x.g, count(*) AS n
  FROM ({_grams(f"SELECT doc_id AS id, {clean('text')} AS t FROM documents")}) x
  JOIN documents d ON d.doc_id = x.id GROUP BY ALL),
gram_total AS (SELECT lang, sum(n) AS total FROM gram_lang GROUP BY lang),
vocab AS (SELECT DISTINCT g FROM gram_lang),
prior AS (SELECT lang, ln(count(*) + 1.0) - ln((SELECT count(*) FROM documents) + (SELECT count(DISTINCT lang) FROM documents)) AS p
  FROM documents GROUP BY lang),
theta AS (SELECT t.lang, w.g, ln(coalesce(l.n, 0) + 1.0) - ln(t.total + (SELECT count(*) FROM vocab)) AS w
  FROM vocab w CROSS JOIN gram_total t LEFT JOIN gram_lang l ON l.lang = t.lang AND l.g = w.g),
wanted AS MATERIALIZED ({wanted}),
lettered AS (SELECT id, {clean('v')} AS t FROM wanted WHERE regexp_matches({clean('v')}, '\\p{{L}}')),
resp_gram AS (SELECT id, g, count(*) AS n FROM ({_grams('SELECT id, t FROM lettered')}) GROUP BY id, g),
judged AS (SELECT l.id, p.lang, p.p + coalesce(s.s, 0) AS score FROM lettered l CROSS JOIN prior p
  LEFT JOIN (SELECT r.id, t.lang, sum(r.n * t.w) AS s FROM resp_gram r JOIN theta t USING (g) GROUP BY ALL) s
  ON s.id = l.id AND s.lang = p.lang),
detected AS (SELECT id, arg_max(lang, score) AS det FROM judged GROUP BY id)"""


def parsed(raw):
    return f"CASE WHEN json_valid({raw}) AND json_type({raw}) = 'OBJECT' THEN {raw} ELSE '{{}}' END"


def verdict(passes, failed):
    return f"CASE WHEN coalesce({failed}, FALSE) THEN FALSE ELSE coalesce({passes}, FALSE) END"
