"""Conversations with missing ids and numbers, and very long ones."""

import random

from adherence.operators import chat

KIND = "conv_id long, turn long, role string, text string"


def test_rows_without_id_or_number_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (None, 0, "user", "n0"), (None, 1, "user", "clear"), (None, 2, "user", "n2"),
            (2, None, "user", "first"), (2, 3, "user", "later"), (None, None, "user", "nn"), (3, None, "user", "only")]
    turns = spark.createDataFrame(rows, KIND).repartition(3)
    plain = {(r.conv_id, r.part): r.text for r in chat.conversation_text(turns, use_chat=False).collect()}
    assert plain == {(1, 0): "s\n\na", (None, 0): "nn\n\nn0\n\nclear\n\nn2", (2, 0): "first\n\nlater", (3, 0): "only"}
    full = {r.conv_id: r.text for r in chat.conversation_text(turns).collect()}
    assert set(full) == {1, 2, 3, None} and all(x.startswith(chat.TEMPLATE.begin) for x in full.values())
    segments = {(r.conv_id, r.text): r.segment for r in chat.history_segments(turns).collect()}
    assert len(segments) == len(rows)
    assert segments[None, "nn"] == segments[None, "n0"] == 0 and segments[None, "clear"] == segments[None, "n2"] == 1
    assert segments[2, "first"] == segments[3, "only"] == 0


def test_parts_begin_once(spark):
    turns = spark.createDataFrame([(1, n, "user", str(n)) for n in range(7)] + [(1, None, "user", "x"), (2, 5, "user", "y")], KIND)
    got = {(r.conv_id, r.part): r.text for r in chat.conversation_text(turns, turns_per_part=3).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 1)]
    assert [k for k, v in sorted(got.items()) if v.startswith(chat.TEMPLATE.begin)] == [(1, 0), (2, 1)]


def plain_trim(rows, keep_last, budget):
    kept = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if budget is not None and sum(len(r[3].split()) for r in own) <= budget:
            kept += own
            continue
        chosen = set(range(len(own) - keep_last, len(own))) | ({0} if own[0][2] == "system" else set())
        kept += [r for k, r in enumerate(own) if k in chosen]
    return sorted(kept, key=repr)


def test_trimming_against_a_plain_version(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.randint(0, 30), rng.choice(["system", "user"]), "w " * rng.randint(0, 9)) for _ in range(90)]
    rows += [(9, 0, "system", "s"), (9, 1, "user", "u"), (10, 0, "system", "alone")]
    turns = spark.createDataFrame(rows, KIND).repartition(4)
    for budget in (None, 0, 60, 10_000):
        for keep_last in (1, 4):
            got = sorted(map(tuple, chat.trim_history(turns, keep_last, budget).collect()), key=repr)
            assert got == plain_trim(rows, keep_last, budget), (budget, keep_last)


def test_a_long_conversation_is_ranked_in_blocks(spark):
    """One conversation with a third of all rows: no window holds more than a block of it."""
    long = spark.range(200_000).selectExpr("0L as conv_id", "id as turn", "'user' as role", "'a b c' as text")
    others = spark.range(400_000).selectExpr("1 + id % 9000 as conv_id", "id as turn", "'user' as role", "'a b c' as text")
    trimmed = chat.trim_history(long.union(others), keep_last=3, budget=None)
    assert trimmed.where("conv_id = 0").count() == 3 and trimmed.count() == 3 * 9001
    plan = trimmed._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan and chat.TURNS_PER_PART == 1024
