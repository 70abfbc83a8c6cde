"""Text functions as native column expressions.

Patterns follow Unicode rules throughout: white space, word characters and word
boundaries are spelled out as classes because the JVM's own shorthands differ
(combining marks count as word characters there, the C0 separators do not count
as white space, and `.` stops at more line ends).
"""

from pyspark.sql import Column, functions as F

# Every character that counts as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_RANGES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{_RANGES}]"
NOT_WS = f"[^{_RANGES}]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Characters with a meaning in a regular expression, the dot apart: text free of
# them means the same to every engine.
REGEX_META = r"[\\^$|?*+(){}\[\]]"


def let(value, body):
    """Bind `value` once and use it several times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constants(values) -> Column:
    """A constant array of strings, as one literal instead of one per value."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def strip(c) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c) -> Column:
    return strip(c) == ""


def is_plain(pattern) -> Column:
    """True where a caller-supplied pattern holds no regular-expression syntax."""
    return ~F.rlike(pattern, F.lit(REGEX_META))


def matches(c, pattern) -> Column:
    return F.rlike(c, pattern if isinstance(pattern, Column) else F.lit(pattern))


def count_matches(c, pattern) -> Column:
    return F.regexp_count(c, pattern if isinstance(pattern, Column) else F.lit(pattern))


def find_all(c, pattern, group=0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def split_all(c, pattern) -> Column:
    """Split keeping leading and trailing empty pieces."""
    return F.split(c, pattern, -1)


def words(c) -> Column:
    return find_all(c, f"{WORD}+")


def word_count(c) -> Column:
    return count_matches(c, f"{WORD}+")


def is_upper(c) -> Column:
    return matches(c, r"(?U)\p{Upper}") & ~matches(c, r"(?U)[\p{Lower}\p{Lt}]")


def is_lower(c) -> Column:
    return matches(c, r"(?U)\p{Lower}") & ~matches(c, r"(?U)[\p{Upper}\p{Lt}]")


def letter_count(c, letter) -> Column:
    low = F.lower(c)
    return F.length(low) - F.length(F.replace(low, letter, F.lit("")))


# --- sentences -------------------------------------------------------------

# The abbreviations the sentence rules know.
TITLES = "Mr|St|Mrs|Ms|Dr"
SUFFIXES = "Inc|Ltd|Jr|Sr|Co"
DOMAINS = "com|net|org|io|gov|edu|me"
STARTERS = (
    f"Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He{WS}|She{WS}|It{WS}|They{WS}|Their{WS}|Our{WS}|We{WS}|"
    f"But{WS}|However{WS}|That{WS}|This{WS}|Wherever"
)

# Ordered rewrites; a protected full stop becomes <prd>, a sentence end <stop>.
SENTENCE_RULES = [
    (rf"({TITLES})[.]", "$1<prd>"),
    (rf"[.]({DOMAINS})", "<prd>$1"),
    (r"([0-9])[.]([0-9])", "$1<prd>$2"),
    (r"(\.{2,})", "$1<stop>"),
    (r"\.(?=\.)|(?<=\.)\.", "<prd>"),
    (r"Ph\.D\.", "Ph<prd>D<prd>"),
    (rf"{WS}([A-Za-z])[.] ", " $1<prd> "),
    (rf"([A-Z][.][A-Z][.](?:[A-Z][.])?) ({STARTERS})", "$1<stop> $2"),
    (r"([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>$3<prd>"),
    (r"([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>"),
    (rf" ({SUFFIXES})[.] ({STARTERS})", " $1<stop> $2"),
    (rf" ({SUFFIXES})[.]", " $1<prd>"),
    (r" ([A-Za-z])[.]", " $1<prd>"),
]
SENTENCE_QUOTES = [(".”", "”."), ('."', '".'), ('!"', '"!'), ('?"', '"?')]


def sentences(c) -> Column:
    """Rule-based sentence split into an array of stripped sentences."""
    text = F.concat(F.lit(" "), F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("  "))
    for pattern, replacement in SENTENCE_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    for old, new in SENTENCE_QUOTES:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"([.?!])", "$1<stop>")
    text = F.replace(text, F.lit("<prd>"), F.lit("."))
    pieces = F.transform(split_all(text, "<stop>"), strip)
    return let(
        pieces,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


# Abbreviations after which a full stop does not end a sentence (parameter).
ABBREVIATIONS = (
    "Mr Mrs Ms Dr St Prof Rev Gen Col Capt Lt Sgt Gov Sen Rep Hon Jr Sr Inc Ltd Co Corp "
    "Bros vs Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Ph.D i.e e.g"
).split()
CLOSERS = "[\"'”’)\\]}]*"


def sentence_count(c, abbreviations=ABBREVIATIONS) -> Column:
    """Number of sentences: a run of end marks closes a sentence when white space
    follows, unless the mark belongs to an abbreviation or an initial, or is an
    ellipsis no capital comes after. Those are counted and taken off, so the text
    is never rewritten."""
    known = "|".join(a.replace(".", "[.]") for a in sorted(abbreviations, key=len, reverse=True))
    ends = rf"[.?!]+{CLOSERS}{WS}+"
    short = rf"[.](?<=(?<![\p{{L}}\p{{N}}])(?:\p{{L}}|{known})[.]){WS}+"
    running = rf"[.]{{2,}}{WS}+[^\p{{Lu}}{SPACES}]"
    return let(
        strip(c),
        lambda t: F.when(t == "", 0).otherwise(
            count_matches(t, ends) - count_matches(t, short) - count_matches(t, running) + 1
        ),
    )


# --- word tokens -----------------------------------------------------------

# Treebank-style separation: punctuation and contractions become tokens of their
# own, hyphenated words stay whole, only a text-final full stop is split off.
TOKEN_RULES = [
    (r'(^|[ (\[{<])"', "$1 `` "),
    (r"([:,])([^0-9]|$)", " $1 $2"),
    (r"([^.])(\.)([\])}>\"'»”’ ]*)$", "$1 $2 $3 "),
    (r"([«“‘„»”’;@#$%&?!*\[\](){}<>]|\.{2,}|--)", " $1 "),
    (r'"', " '' "),
    (r"([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|') ", "$1 $2 "),
    (r"(?i)(?<= can)(?=not )|(?<= (?:gim|lem))(?=me )|(?<= (?:gon|wan))(?=na )"
     r"|(?<= got)(?=ta )|(?<= d)(?='ye )|(?<= 't)(?=is |was )", " "),
]


def single_spaced(c) -> Column:
    return F.regexp_replace(strip(c), f"{WS}+", " ")


def _tokens(text) -> Column:
    for pattern, replacement in TOKEN_RULES[:3]:
        text = F.regexp_replace(text, pattern, replacement)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in TOKEN_RULES[3:]:
        text = F.regexp_replace(text, pattern, replacement)
    return F.filter(F.split(text, " +", -1), lambda t: t != "")


def word_tokens(c) -> Column:
    return _tokens(single_spaced(c))


def capital_word_count(c) -> Column:
    """Tokens in capitals. Only a stretch with a capital can hold one, and no rule
    makes a token out of two stretches, so the others are taken out beforehand."""
    capitals = F.regexp_replace(single_spaced(c), r"(?U)(?<![^ ])[^ \p{Upper}]++(?![^ ]) ?", "")
    return F.size(F.filter(_tokens(capitals), is_upper))


# --- multisets -------------------------------------------------------------


def numbered_words(c) -> Column:
    """Words with their running number (`the#1`, `the#2`), so that a multiset
    becomes a set. Sorting brings equal words together; no word is compared with
    all others."""

    def number(w):
        starts = F.filter(
            F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)),
        )
        return let(
            starts,
            lambda s: F.flatten(
                F.transform(
                    s,
                    lambda start, j: F.transform(
                        F.sequence(F.lit(1), F.coalesce(F.get(s, j + 1), F.size(w)) - start),
                        lambda k: F.concat(F.get(w, start), F.lit("#"), k.cast("string")),
                    ),
                )
            ),
        )

    return let(F.sort_array(words(F.lower(c))), number)


def shared_word_count(a, b) -> Column:
    """Size of the multiset intersection of the words of two texts."""
    return F.size(F.array_intersect(numbered_words(a), numbered_words(b)))


# --- JSON ------------------------------------------------------------------


def json_body(c) -> Column:
    """The text without one code fence around it."""
    opened = F.regexp_replace(
        strip(c), r"\A(?:```json)?(?:```Json)?(?:```JSON)?(?:```)?", ""
    )
    return strip(F.regexp_replace(opened, r"```\z", ""))


# What any JSON text can start with; all else is refused without a parse.
JSON_START = r'\A(?:[\[{"]|-?[0-9]|-?Infinity|NaN|true|false|null)'


def may_be_json(body) -> Column:
    return matches(body, JSON_START)


# --- Python-style literals ---------------------------------------------------


def quoted(c) -> Column:
    """A string as a quoted literal: single quotes unless it holds one."""
    text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def quoted_list(c) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]"))
