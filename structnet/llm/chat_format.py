"""Preference pairs as prompt and masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role: string, text: string>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns (role, text) in order of turn, ties by role and text. A null role is ``user``, a null text empty; rows without conv_id are one conversation.

    A conversation is one value, so its turns meet in one row whatever their number.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return out.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column) -> Column:
    """[start, end) of what is trained on in the rendered turns: text and end mark of assistant turns, in code points."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        head = acc["at"] + F.length(turn["role"]) + 5
        end = acc["at"] + F.length(rendered(turn))
        span = F.array(F.struct(head.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    least = F.least(F.size(a), F.size(b))
    places = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    differ = F.array_min(F.filter(places, lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1))))
    return F.coalesce(differ - 1, least)


def preference_pairs(pairs: DataFrame, *keep: str) -> DataFrame:
    """``chosen`` and ``rejected`` (arrays of role, text) to: the columns ``keep``, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The longest common prefix of turns is rendered once as the prompt; the completions are what is left of either, each
    with the spans of its assistant turns. Equal conversations leave empty completions; a null or empty
    conversation has no turns; rows that repeat give rows each; an empty table gives none.
    """
    none = F.array().cast(f"array<{TURN}>")
    clean = {c: F.transform(F.coalesce(F.col(c), none), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))) for c in ("chosen", "rejected")}
    rows = pairs.select(*keep, *(c.alias(n) for n, c in clean.items()))
    rows = rows.withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0))) for c in ("chosen", "rejected")}
    rows = rows.select(*keep, "n_common", _text(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"), *(x.alias(c) for c, x in rest.items()))
    return rows.select(*keep, F.col("n_common").cast("long").alias("n_common"), "prompt", *(f(F.col(c)).alias(c + end) for f, end in ((_text, ""), (_mask, "_mask")) for c in ("chosen", "rejected")))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: conv_id, chosen (the conversation), rejected (up to its last assistant turn, then that of its neighbour).

    Neighbours differ in the last bit of conv_id. Without a neighbour, or one without assistant turn, the rejected
    conversation ends before; a conversation without assistant turn is rejected without its last turn.
    """
    whole = conversations(turns).withColumn("last", F.expr("array_max(filter(sequence(1, size(turns)), i -> turns[i - 1].role = 'assistant'))"))
    reply = whole.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.array(F.expr("turns[last - 1]")).alias("reply"))
    rows = whole.join(reply, "conv_id", "left")
    before = F.expr("slice(turns, 1, coalesce(last, size(turns)) - 1)")
    other = F.when(F.col("last").isNotNull(), F.col("reply"))
    return rows.select("conv_id", F.col("turns").alias("chosen"), F.concat(before, F.coalesce(other, F.array().cast(f"array<{TURN}>"))).alias("rejected"))
