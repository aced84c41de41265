"""Preference pairs: one prompt from the turns that chosen and rejected share, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K

#: Fixed layout of a rendered turn.
HEAD, SEAM, TAIL = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role: string, text: string>>"


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order of turn, role, text. A conversation is one training example, so it fits a row.

    Rows without conv_id go. Null roles and texts count as empty.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(SEAM), turn["text"], F.lit(TAIL))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def assistant_spans(turns: Column) -> Column:
    """[start, end) in code points, within the rendered turns, of what the loss counts: assistant text with its end mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = F.lit(len(HEAD) + len(SEAM)).cast("long") + F.length(turn["role"])
        begin = acc["at"] + head
        end = begin + F.length(turn["text"]) + F.lit(len(TAIL)).cast("long")
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_prefix(left: Column, right: Column) -> Column:
    """Turns, from the first, in which role and text agree."""
    pairs = F.zip_with(left, right, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(pairs, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(pairs)).cast("int")


def preference_pairs(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """Rows with two turn arrays, formatted: n_prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The prompt is rendered once. Masks are spans in their completion. Equal conversations give empty completions; with
    no common turn the prompt is empty. Null arrays count as empty and null roles and texts as "", very long texts are
    rendered whole, repeated rows each for itself, and an empty table gives an empty result. Columns of the new names are
    replaced; all others pass unchanged, whatever their names.
    """
    new = ("n_prefix_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    keep = [c for c in pairs.columns if c.lower() not in new]
    whole = lambda c: F.transform(F.coalesce(K.column(c), F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    turns = pairs.select(K.boxed(keep), whole(chosen).alias("a"), whole(rejected).alias("b"))
    cut = turns.select("*", common_prefix(F.col("a"), F.col("b")).alias("n"))
    rest = lambda turns: F.slice(turns, F.col("n") + 1, F.greatest(F.size(turns) - F.col("n"), F.lit(0)))
    return cut.select(
        *K.unboxed(keep),
        F.col("n").alias("n_prefix_turns"),
        rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("a")).alias("chosen"),
        rendered(rest("b")).alias("rejected"),
        assistant_spans(rest("a")).alias("chosen_mask"),
        assistant_spans(rest("b")).alias("rejected_mask"),
    )


def swapped_answers(rows: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: chosen up to its last assistant turn, rejected the same with the last assistant
    text of the conversation whose id differs in the lowest bit. Conversations without such a turn or partner give none."""
    talks = conversations(rows)
    spot = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == "assistant")), True) + 1
    has = F.exists("turns", lambda t: t["role"] == "assistant")
    ended = talks.filter(has).select("conv_id", F.slice("turns", F.lit(1), spot.cast("int")).alias("chosen_turns"))
    answers = ended.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("chosen_turns", -1)["text"].alias("other"))
    both = ended.join(answers, "conv_id")
    swapped = F.struct(F.lit("assistant").alias("role"), F.col("other").alias("text"))
    rejected = F.array_append(F.slice("chosen_turns", F.lit(1), F.size("chosen_turns") - 1), swapped).cast(TURNS)
    return both.select("conv_id", F.col("conv_id").bitwiseXOR(F.lit(1)).alias("rejected_from"), "chosen_turns", rejected.alias("rejected_turns"))
