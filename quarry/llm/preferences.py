"""Preference formatting of conversation pairs.

A pair of conversations, chosen and rejected, is cut after its longest common turn prefix.
The prefix is rendered once as the prompt; what follows in each conversation becomes a
completion whose parts carry a loss mask: 1 for turns of the assistant, 0 for the others.

``conversations`` hold no preferences of their own, so ``pairs`` makes them: conversations
with the same opening turn are answers to one prompt; the one with the smallest id is
chosen over each of the others. A conversation that is chosen itself, or has no partner,
is paired with a worse version of itself, whose last answer is the answer before (or
nothing, if there is none). So each conversation has one pair.

Everything is DataFrame functions. The conversations of one opening are joined with their
chosen one by its id, a join that Spark may split; no group is collected but the turns of
one conversation.

Defined results: a null text is the empty text, a null role the role ``unknown``; turns
with one number are ordered by role and text, repeated rows of a turn count once; turns
without a number come last; conversations without an id are one conversation; two equal
conversations are cut before their last turn, so that completions are never empty on both
sides; long texts and long conversations are rendered whole; an empty table gives no pairs;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
#: How a turn is rendered.
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text) in order), a row for each conversation."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").isNull().alias("late"),
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("_t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("_t")).alias("_t"))
    return ordered.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _worse(turns: Column) -> Column:
    """A conversation whose last answer is the one before; without an earlier one it is empty."""
    places = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    last = F.coalesce(F.try_element_at(places, F.lit(-1)), F.size(turns) - 1)
    before = F.coalesce(F.get(turns, F.try_element_at(places, F.lit(-2)))["text"], F.lit(""))
    return F.transform(turns, lambda t, i: F.when(i == last, F.struct(t["role"].alias("role"), before.alias("text"))).otherwise(t))


def pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, chosen, rejected) with one pair for each conversation."""
    from .common import written

    talks = conversations(turns)
    first = F.get("turns", F.lit(0))
    opening = F.concat(F.length(first["role"]).cast("string"), F.lit(":"), first["role"], first["text"])  # openings that differ differ in this
    talks = written(talks.withColumn("_open", F.unhex(F.md5(opening.cast("binary")))), "conversations")
    heads = talks.groupBy("_open").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id"))).alias("head"))
    named = talks.join(heads, "_open").select("conv_id", "turns", F.col("head.id").alias("chosen_id"))
    alone = named.filter(F.col("conv_id").eqNullSafe(F.col("chosen_id")))
    own = alone.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), _worse(F.col("turns")).alias("rejected"))
    rest = named.filter(~F.col("conv_id").eqNullSafe(F.col("chosen_id")))
    best = alone.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    other = rest.join(best, "chosen_id").select(F.col("conv_id").alias("pair_id"), "chosen_id", "chosen", F.col("turns").alias("rejected"))
    return own.unionByName(other)


def render(turn: Column) -> Column:
    head, tail = OPEN.split("{role}")
    return F.concat(F.lit(head), turn["role"], F.lit(tail), turn["text"], F.lit(CLOSE))


def _completion(turns: Column, n_prompt: Column) -> Column:
    """Rendered turns after the prompt, each with its loss mask."""
    after = F.slice(turns, n_prompt + 1, F.greatest(F.size(turns), F.lit(1)))
    return F.transform(after, lambda t: F.struct(render(t).alias("text"), F.when(t["role"] == "assistant", 1).otherwise(0).alias("mask")))


def formatted(pairs_df: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, n_prompt_turns, prompt, chosen, rejected): completions are arrays of (text, mask)."""
    c, r = F.col("chosen"), F.col("rejected")
    shorter = F.least(F.size(c), F.size(r))
    same = F.zip_with(F.slice(c, F.lit(1), shorter), F.slice(r, F.lit(1), shorter), lambda x, y: x == y)
    differs = F.array_position(same, False)
    prefix = F.when(differs > 0, differs.cast("int") - 1).otherwise(shorter)
    # of equal conversations the last turn is the completion
    prefix = F.when((prefix == F.size(c)) & (prefix == F.size(r)), F.greatest(prefix - 1, F.lit(0))).otherwise(prefix)
    df = pairs_df.withColumn("n_prompt_turns", prefix)
    n = F.col("n_prompt_turns")
    return df.select(
        "pair_id", "chosen_id", "n_prompt_turns",
        F.array_join(F.transform(F.slice(c, F.lit(1), n), render), "").alias("prompt"),
        _completion(c, n).alias("chosen"),
        _completion(r, n).alias("rejected"),
    )
