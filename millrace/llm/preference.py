"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation
is rendered once, as the prompt; what follows in each is its completion, with
the character spans of the completion that count in the loss (the texts of
assistant turns with their end marks).

``pairs`` makes pairs from a table of turns. Conversations with the same first
turn are siblings: the one with the most turns (then the longest, then the
smallest id) is chosen against each of the others. A conversation without
siblings is chosen against itself with the last assistant turn cut to its
first half of words; without an assistant turn it has no pair, and its
prompt is all of it.

Defined results: turns are ordered by turn, role and text, and equal rows
count once; null roles and texts count as empty; marks inside texts are broken
by a zero-width space; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order."""
    clean = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"<\|im_", "<|​im_")
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), clean.alias("text"))
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_set(one)).alias("turns"))


def common_turns(one: Column, other: Column) -> Column:
    """How many first turns have the same role and text."""
    same = F.zip_with(one, other, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def loss_spans(turns: Column) -> Column:
    """Start and end, in characters of the rendered turns, of what an assistant says and its end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        head = s["at"] + F.length(t["role"]) + (len(OPEN) + 1)
        end = head + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(head.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def tail(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with arrays chosen and rejected: n_prompt_turns, prompt, completions and their spans."""
    n = F.col("n_prompt_turns")
    chosen, rejected = tail(F.col("chosen"), n), tail(F.col("rejected"), n)
    return pairs.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected"))).withColumns(
        {
            "prompt": rendered(F.slice("chosen", F.lit(1), n)),
            "chosen_completion": rendered(chosen),
            "rejected_completion": rendered(rejected),
            "chosen_spans": loss_spans(chosen),
            "rejected_spans": loss_spans(rejected),
        }
    )


def cut_reply(turns: Column) -> Column:
    """turns up to the last assistant turn, of which the first half of the words stays."""
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    reply = F.element_at(turns, last)
    parts = F.split(reply["text"], r"[ \t\n\x0B\f\r]+")
    half = F.array_join(F.slice(parts, F.lit(1), F.floor(F.size(parts) / 2).cast("int")), " ")
    return F.when(last.isNotNull(), F.concat(F.slice(turns, F.lit(1), last - 1), F.array(F.struct(reply["turn"].alias("turn"), reply["role"].alias("role"), half.alias("text")))))


def pairs(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, kind (sibling, cut or none), chosen_id, rejected_id, chosen and rejected turns.

    For siblings the row of the chosen one is of kind 'chosen', without a pair of its own.
    """
    turns = durable(turns_of(conversations))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.length(t["text"]))
    first = F.element_at("turns", 1)
    keyed = turns.withColumns({"k0": F.xxhash64(first["role"], first["text"]), "k1": F.sha2(first["text"], 224)})
    rank = F.struct(F.size("turns"), size, -F.col("conv_id"))
    # Groups can be large; only their best and their size are gathered, by partial aggregation.
    best = keyed.select("k0", "k1", "conv_id", rank.alias("rank")).groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n"), F.max_by("conv_id", "rank").alias("chosen_id"))
    best = best.join(turns.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id", "left")
    rows = keyed.join(best, ["k0", "k1"])
    cut = cut_reply(F.col("turns"))
    alone = F.col("n") == 1
    kind = F.when(~alone & (F.col("conv_id") == F.col("chosen_id")), "chosen").when(~alone, "sibling").when(cut.isNotNull(), "cut").otherwise("none")
    return rows.select(
        "conv_id",
        kind.alias("kind"),
        "chosen_id",
        F.when(kind.isin("sibling", "cut"), F.col("conv_id")).alias("rejected_id"),
        F.when(alone, F.col("turns")).otherwise(F.col("chosen")).alias("chosen"),
        F.when(kind == "sibling", F.col("turns")).when(kind == "cut", cut).when(alone, F.col("turns")).otherwise(F.col("chosen")).alias("rejected"),
    )


def preference_table(conversations: DataFrame) -> DataFrame:
    return format_pairs(pairs(conversations)).drop("chosen", "rejected")
