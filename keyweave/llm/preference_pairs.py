"""Preference formatting: the common turns of a chosen and a rejected conversation once as prompt, the rest as completions.

Turns are compared by place, role and text from the first on. Where they first differ, the prompt ends; what follows on
each side is a completion, with the character spans of its assistant turns, the only ones a loss is taken on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm.columns import column, let

# How a turn is rendered.
OPENING, CLOSING, AFTER = "<|", "|>\n", "\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPENING), role, F.lit(CLOSING), text, F.lit(AFTER))


def _turns(df: DataFrame, pair: str, turn: str, role: str, text: str, side: str) -> DataFrame:
    """One row for each pair: its turns of one side, in order."""
    one = F.struct(column(turn).alias("turn"), F.coalesce(column(role), F.lit("")).alias("role"), F.coalesce(column(text), F.lit("")).alias("text"))
    return df.groupBy(column(pair).alias("pair")).agg(F.array_sort(F.collect_list(one)).alias(side))


def _completion(turns: Column, start: Column, trained: str) -> tuple[Column, Column]:
    """The text of the turns from `start` on, and (start, end) of the trained ones' own texts in it."""
    rest = F.slice(turns, start + 1, F.size(turns))
    pieces = F.transform(rest, lambda t: rendered(t["role"], t["text"]))
    # Where each turn begins: a running sum over the turns, so a long conversation is joined once.
    lengths = F.transform(pieces, lambda p: F.char_length(p))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.array_append(at, F.element_at(at, -1) + n))

    def placed(at: Column) -> Column:
        own = lambda t, i: F.get(at, i) + F.char_length(t["role"]) + len(OPENING) + len(CLOSING)
        return F.transform(
            rest, lambda t, i: F.struct(t["role"].alias("role"), own(t, i).alias("start"), (own(t, i) + F.char_length(t["text"])).alias("end"))
        )

    spans = let(starts, placed)
    masked = F.transform(F.filter(spans, lambda s: s["role"] == trained), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.array_join(pieces, ""), masked


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    pair: str = "pair_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: str = "assistant",
) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans), one row for each pair on both sides.

    Spans are (start, end) of code points in the completion, end exclusive. A null role or text is an empty one; turns of
    equal number are ordered by role and text, repeated ones stay. A side that is the beginning of the other has an empty
    completion. Pairs that one side lacks, or whose id is null, are left out. All turns of a conversation meet in a row,
    as the rendered text does. Other columns aren't read.
    """
    both = _turns(chosen, pair, turn, role, text, "c").join(_turns(rejected, pair, turn, role, text, "r"), "pair")
    alike = F.zip_with("c", "r", lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    # Places where one side has ended are null there; the first place that isn't alike ends the prompt.
    differ = F.array_position(F.transform(alike, lambda x: F.coalesce(x, F.lit(False))), False)
    n = F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("int")
    counted = both.select("pair", "c", "r", n.alias("n"))
    prompt = F.array_join(F.transform(F.slice("c", 1, F.col("n")), lambda t: rendered(t["role"], t["text"])), "")
    chosen_text, chosen_spans = _completion(F.col("c"), F.col("n"), trained)
    rejected_text, rejected_spans = _completion(F.col("r"), F.col("n"), trained)
    return counted.select(
        F.col("pair").alias(pair),
        F.col("n").cast("long").alias("n_common"),
        prompt.alias("prompt"),
        chosen_text.alias("chosen"),
        chosen_spans.alias("chosen_spans"),
        rejected_text.alias("rejected"),
        rejected_spans.alias("rejected_spans"),
    )


def repeated_answers(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations: the rejected one ends with the assistant's previous answer again.

    Of conversations with two assistant turns and more, up to the last of them; nothing is trained on turns after it. With
    `every`, all conversations are there: a single answer has an empty one on the rejected side, and a conversation without
    an answer is the same on both sides, so it is all prompt.
    """
    order = Window.partitionBy(column(conv)).orderBy(column(turn), column(text))
    answers = F.when(column(role) == "assistant", F.struct(column(turn).alias("turn"), column(text).alias("text")))
    seen = conversations.select(
        column(conv).alias("pair_id"),
        column(turn).alias("turn"),
        column(role).alias("role"),
        column(text).alias("text"),
        F.last(answers, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("previous"),
        F.max(F.when(column(role) == "assistant", column(turn))).over(Window.partitionBy(column(conv))).alias("last"),
        F.count(F.when(column(role) == "assistant", 1)).over(Window.partitionBy(column(conv))).alias("answers"),
    )
    used = seen.where("answers = 0 OR turn <= last" if every else "answers > 1 AND turn <= last")
    stale = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.coalesce("previous.text", F.lit(""))).otherwise(F.col("text"))
    return used.select("pair_id", "turn", "role", "text"), used.select("pair_id", "turn", "role", stale.alias("text"))
