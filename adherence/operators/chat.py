"""Chat and training text, and the rules that shorten a conversation's history."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from adherence.functions.text import WS, is_blank, strip


@dataclass(frozen=True)
class ChatTemplate:
    """Role headers around each message; `plain` joins bare contents instead."""

    begin: str = "<|begin_of_text|>"
    header: str = "<|start_header_id|>{role}<|end_header_id|>\n\n"
    end: str = "<|eot_id|>"

    def message(self, role, content) -> Column:
        before, _, after = self.header.partition("{role}")
        role = role if isinstance(role, Column) else F.lit(role)
        return F.concat(F.lit(before), role, F.lit(after), content, F.lit(self.end))

    def reply_header(self) -> Column:
        return F.lit(self.header.replace("{role}", "assistant"))


TEMPLATE = ChatTemplate()


def alpaca_user_text(instruction="instruction", given="input") -> Column:
    instruction, given = F.col(instruction), F.col(given)
    return F.when(
        given.isNotNull() & ~is_blank(given), F.concat(instruction, F.lit("\n\n"), given)
    ).otherwise(instruction)


def training_text(rows: DataFrame, template=TEMPLATE) -> DataFrame:
    """(instruction, input, output) rows as one training string each."""
    return rows.select(
        F.concat(
            F.lit(template.begin),
            template.message("user", alpaca_user_text()),
            template.message("assistant", F.col("output")),
        ).alias("text")
    )


def prompt_text(prompt, use_chat, template=TEMPLATE) -> Column:
    """A single prompt with the header of the reply, or as it is."""
    use_chat = use_chat if isinstance(use_chat, Column) else F.lit(use_chat)
    chat = F.concat(F.lit(template.begin), template.message("user", prompt), template.reply_header())
    return F.when(use_chat, chat).otherwise(prompt)


TURNS_PER_PART = 1024


def conversation_text(turns: DataFrame, use_chat=True, template=TEMPLATE,
                      turns_per_part=TURNS_PER_PART) -> DataFrame:
    """Each conversation as text, in the order of its turns; a system message that
    opens it comes first, a later one stays where it is.

    A conversation longer than `turns_per_part` turns comes in several numbered
    parts whose texts follow each other, so no group is ever larger than that.
    Joining the parts in order (with a blank line between them when `use_chat`
    is off) gives the whole text. Turns without a conversation are one of their own;
    those without a number come first. Messages without a role or text are left out.
    """
    part = F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(0))
    first = turns.groupBy(F.col("conv_id").alias("_conv")).agg(F.min(part).alias("_first"))
    grouped = turns.groupBy("conv_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"),
    )
    if not use_chat:
        text = F.array_join(F.transform("messages", lambda m: m["text"]), "\n\n")
        return grouped.select("conv_id", "part", text.alias("text"))
    body = F.array_join(F.transform("messages", lambda m: template.message(m["role"], m["text"])), "")
    begin = F.when(F.col("part") == F.col("_first"), F.lit(template.begin)).otherwise(F.lit(""))
    return grouped.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "part", F.concat(begin, body).alias("text")
    )


def token_count(text) -> Column:
    """White-space tokens; a length budget needs no more."""
    return F.when(is_blank(text), 0).otherwise(F.size(F.split(strip(text), f"{WS}+", -1)))


KEEP_LAST = 4
MAX_SEQ_LENGTH = 2048
MAX_NEW_TOKENS = 512


def trim_history(turns: DataFrame, keep_last=KEEP_LAST, budget=MAX_SEQ_LENGTH - MAX_NEW_TOKENS) -> DataFrame:
    """A conversation over the token budget keeps the system message that opens it and
    its last messages; others stay as they are. `budget=None` trims every conversation.

    Rows are ranked, never made distinct: rows that share a turn number all count. The
    ranks are taken in two steps, within blocks of turns and over what the blocks keep, so
    that no task sorts a very long conversation.
    """
    ties = ["role", "text"]

    def ranked(rows, *keys):
        newest = Window.partitionBy(*keys).orderBy(F.desc("turn"), *[F.desc(c) for c in ties])
        oldest = Window.partitionBy(*keys).orderBy("turn", *ties)
        return rows.withColumn("_down", F.row_number().over(newest)).withColumn("_up", F.row_number().over(oldest))

    rows = turns.withColumn("_stays", F.lit(False))
    if budget is not None:
        size = turns.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum(token_count(F.col("text"))).alias("_tokens"))
        stays = F.coalesce(F.col("_tokens") <= budget, F.lit(True))
        rows = turns.join(size, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("_stays", stays)
    last = F.col("_stays") | (F.col("_down") <= keep_last)
    block = F.coalesce(F.floor(F.col("turn") / TURNS_PER_PART), F.lit(-1))
    ends = ranked(rows.withColumn("_block", block), "conv_id", "_block").where(last | (F.col("_up") == 1))
    opens = (F.col("_up") == 1) & (F.col("role") == "system")
    return ranked(ends, "conv_id").where(last | opens).select(*turns.columns)


def running_total(rows: DataFrame, key, order, value: Column, out, block=TURNS_PER_PART) -> DataFrame:
    """Sum of `value` over the rows of `key` up to and including each row.

    Taken in two steps: within blocks of `order`, and over the totals of the
    blocks that have any. A key with very many rows is thus spread over many tasks.
    Rows without a key are one key, those without an order come first.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(key, "_block").agg(F.sum("_value").alias("_sum")).select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at"))
    return (
        blocked.withColumn("_within", F.sum("_value").over(within))
        .join(totals, same)
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_block", "_value", "_within", "_before", "_key", "_at")
    )


def history_segments(turns: DataFrame, reset="clear", block=TURNS_PER_PART) -> DataFrame:
    """Number the histories within a conversation: a user's `clear` opens a new one."""
    resets = (F.col("role") == "user") & (F.lower(strip(F.col("text"))) == reset)
    return running_total(turns, "conv_id", "turn", F.when(resets, 1).otherwise(0), "segment", block)


def active_history(turns: DataFrame, reset="clear") -> DataFrame:
    """Turns since the last reset; system messages are kept, the resets are not."""
    is_reset = F.coalesce((F.col("role") == "user") & (F.lower(strip(F.col("text"))) == reset), F.lit(False))
    last = turns.groupBy("conv_id").agg(F.max(F.when(is_reset, F.col("turn"))).alias("_last"))
    since = F.col("_last").isNull() | (F.col("turn") > F.col("_last")) | (F.col("role") == "system")
    return (
        turns.join(last, turns.conv_id.eqNullSafe(last.conv_id)).drop(last.conv_id)
        .where(since & ~is_reset).select(*turns.columns)
    )
