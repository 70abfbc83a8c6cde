import random

import pytest

from adherence.llm import decontaminate as dec

ITEM = "A train leaves Paris with 120 people and drives 300 km in 4 hours before 120 people leave the train again near the sea"


@pytest.fixture
def found(spark, texts):
    def run(values, items, **options):
        benchmark = spark.createDataFrame([(k, t, 7) for k, t in enumerate(items)], "item_id long, text string, offset int")
        return {(r.doc_id, r.item_id): r for r in dec.contaminated(texts(values), benchmark, **options).collect()}

    return run


def around(text):
    return "Some words stand here first. " + text + " And others follow after it."


def test_exact_and_reparameterised_copies(found):
    values = [
        around(ITEM),
        around(ITEM.replace("120", "85").replace("300 km", "450 miles").replace("4 hours", "6 days").replace("Paris", "Rome")),
        around(ITEM.replace("120", "85", 1)),  # one value of two: the 18 words after it are verbatim
        around("A bus stops in Paris with 120 people and waits for 300 minutes"),
        around(" | ".join(ITEM.upper().split())),
        "", None,
    ]
    got = found(values, [ITEM])
    assert sorted(got) == [(0, 0), (1, 0), (2, 0), (4, 0)]
    assert not got[0, 0].reparameterised and got[1, 0].reparameterised and not got[2, 0].reparameterised
    assert got[2, 0].words_in_a_row == 18
    assert got[0, 0].coverage >= 0.95


def test_short_items_empty_items_and_numbers(found):
    got = found(["it says only three words here", "1 2 3 4 5 6 7 8 9", "11 12 13 14 15 16 17 18 19"],
                ["Only three words.", None, "", "1 2 3 4 5 6 7 8 9", "..."])
    assert sorted(got) == [(0, 0), (1, 3)]


def test_empty_tables(found):
    assert found([], [ITEM]) == {} and found([ITEM], []) == {}


@pytest.mark.parametrize("filtered", [0, 10**6])
def test_against_a_plain_search(found, filtered):
    """Without placeholders the answer is plain window containment."""
    rng = random.Random(2)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lnr"]
    items = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(20)]
    values = []
    for _ in range(60):
        body = rng.choices(words, k=40)
        for item in rng.sample(items, rng.choice([0, 1, 2])):
            part = item.split()
            cut = rng.choice([0, 0, 3, len(part) // 2])
            at = rng.randrange(len(body))
            body[at:at] = part[cut:]
        values.append(" ".join(body))

    expected = set()
    for d, text in enumerate(values):
        own = text.split()
        for k, item in enumerate(items):
            w = item.split()
            n = min(len(w), dec.WINDOW)
            there = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}
            hits = [tuple(w[i:i + n]) in there for i in range(len(w) - n + 1)]
            longest = max(map(len, "".join("x" if h else " " for h in hits).split()), default=0)
            if sum(hits) >= 0.8 * len(hits) or longest + n - 1 >= dec.RUN and longest:
                expected.add((d, k))
    assert set(found(values, items, filtered=filtered)) == expected


def test_clean_documents_stay(spark, texts):
    docs = texts([around(ITEM), "nothing to see", None], ids=[3, 4, None])
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = dec.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["4", "None"]


def test_other_cases_headings_and_line_breaks(found):
    short, named = "Bring Anna the red book today", "Why did Paul and Mary Smith leave old London with Peter Brown after Easter"
    renamed = "Question 7)\nWhy did John and Jane Jones leave old Berlin with Frank Green after Christmas"
    values = [
        f"Exercise 4 {short}", f"A heading\n{short} and more", around(short.upper()), around(short.lower()),
        around(named.upper()), around(named.lower()), f"A heading {named}", named.replace("old London", "old\nLondon"),
        renamed, renamed.replace("\n", " "), "Bring nobody the red book today", around("bring anna a red book today"),
    ]
    assert sorted(found(values, [short, named])) == [(0, 0), (1, 0), (2, 0), (3, 0)] + [(k, 1) for k in range(4, 10)]


def test_line_breaks_do_not_lose_windows(found):
    got = found([around(" | ".join(ITEM.upper().split())), around(ITEM.replace(" ", "\n"))], [ITEM])
    assert sorted(got) == [(0, 0), (1, 0)] and all(r.coverage >= 0.95 for r in got.values())


def test_different_values_may_become_equal(found):
    got = found([around(ITEM.replace("300", "7").replace("4 hours", "7 hours")), around(ITEM.replace("120", "85", 1))], [ITEM])
    assert sorted(got) == [(0, 0), (1, 0)] and got[0, 0].reparameterised and not got[1, 0].reparameterised


def plain_templates(values, items):
    """Lower-case words and numbers only: every window of every text, compared one by one."""
    def canonical(part):
        numbers = [w for w in part if w.isdigit()]
        if 2 * (len(part) - len(numbers)) >= len(part):
            return tuple("<n>" if w.isdigit() else w for w in part), tuple(numbers)
        return tuple(part), ()

    out = {}
    for k, item in enumerate(items):
        w = item.split()
        n = min(len(w), dec.WINDOW)
        own = [canonical(w[i:i + n]) for i in range(len(w) - n + 1)]
        for d, text in enumerate(values):
            there = text.split()
            offsets = {}
            for at in range(len(there) - n + 1):
                template, slots = canonical(there[at:at + n])
                for i, (other, item_slots) in enumerate(own):
                    if template == other:
                        offsets.setdefault(at - i, []).append((i, tuple(zip(item_slots, slots))))
            positions, changed = set(), False
            for windows in offsets.values():
                stands = {}
                for _, pairs in windows:
                    for a, b in pairs:
                        stands.setdefault(a, set()).add(b)
                for i, pairs in windows:
                    if all(a == b for a, b in pairs) or all(len(stands[a]) == 1 for a, _ in pairs):
                        positions.add(i)
                        changed |= any(a != b for a, b in pairs)
            longest = max(map(len, "".join("x" if i in positions else " " for i in range(len(own))).split()), default=0)
            row = longest + n - 1 if longest else 0
            if positions and (len(positions) / len(own) >= 0.8 or row >= dec.RUN):
                out[d, k] = (len(positions), row, changed)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_with_slots_against_a_plain_search(found, seed):
    rng = random.Random(seed)
    words = ["bal", "dor", "fin", "gol", "bur", "den", "fol", "gar"]
    def item(n):  # noqa: E306
        return [rng.choice(words) if rng.random() < 0.7 else str(rng.randint(1, 3)) for _ in range(n)]
    items = [" ".join(item(rng.randint(4, 30))) for _ in range(12)]
    values = []
    for _ in range(70):
        body = [rng.choice(words) for _ in range(20)]
        for one in rng.sample(items, rng.choice([0, 1, 2])):
            part = one.split()
            renamed = {str(v): str(rng.randint(1, 9)) for v in range(1, 4)}
            how = rng.choice(["same", "renamed", "some"])
            part = [renamed.get(w, w) if how == "renamed" or how == "some" and rng.random() < 0.3 else w for w in part]
            at = rng.randrange(len(body))
            body[at:at] = part
        values.append(" ".join(body))
    got = {key: (r.windows_matched, r.words_in_a_row, r.reparameterised) for key, r in found(values, items).items()}
    expected = plain_templates(values, items)
    assert got == expected and any(x[2] for x in expected.values())


def test_the_rest_of_a_changed_copy_counts(found):
    item = "the first of 12 boxes holds red green blue white black brown grey pink and gold balls then all of the 12 boxes fall into the sea at once"
    got = found([around(item.replace("the 12", "the 15")), around(item.replace("12", "15")), around("nothing like it at all in here")], [item])
    assert sorted(got) == [(0, 0), (1, 0)] and got[0, 0].words_in_a_row >= 13 and not got[0, 0].reparameterised


def test_long_texts_repeated_and_null_ids(spark, texts):
    long = "and so it goes on " * 30_000
    docs = texts([long + ITEM + " " + long, ITEM, "other words", ITEM, "no match here", None], ids=[1, 2, 2, None, None, 5])
    benchmark = spark.createDataFrame([(7, ITEM), (7, "seven other words that stand in no text"), (None, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.windows_matched for r in dec.contaminated(docs, benchmark, coverage=0.5).collect()}
    n = len(ITEM.split()) - dec.WINDOW + 1
    assert got == {(d, k): n for d in (1, 2, None) for k in (7, None)}
