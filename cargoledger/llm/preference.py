"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

Cleaned turns are written once to the shared folder, and both sides of a pair meet in one aggregation.
The two conversations are compared turn by turn, each turn in its own row, so the longest common
prefix is an aggregate (the smallest turn at which they differ) and no conversation is ever gathered.
The result keeps that form: one row per rendered turn, ordered by ``turn`` within its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoledger.llm.common import written

# What is known of a conversation is repeated per slot of its turns, so a very long one is spread.
SLOTS = 16
# Ids are ordered in groups that share all but this many bits, so a window holds at most 65,536 of them.
ID_BITS = 16


def clean_turns(turns: DataFrame, key: str) -> DataFrame:
    """One row per conversation and turn number; of repeated turns the smallest (role, text) counts."""
    role, text = F.coalesce(F.col("role"), F.lit("user")), F.coalesce(F.col("text"), F.lit(""))
    return (
        turns.where(F.col(key).isNotNull() & F.col("turn").isNotNull())
        .groupBy(F.col(key).alias("pair_id"), "turn")
        .agg(F.min(F.struct(role.alias("role"), text.alias("text"))).alias("said"))
    )


def per_slot(facts: DataFrame) -> DataFrame:
    return facts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))


def with_slot(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slot", F.pmod(F.col("turn"), F.lit(SLOTS)).cast("int"))


def next_ids(ids: DataFrame) -> DataFrame:
    """``pair_id, next_id`` for distinct integer ids in their order; the last one is followed by the first.

    An id's successor is sought among the ids that share its upper 48 bits; the last id of such a group
    is followed by the first of the next group, which is sought in the same way 16 bits higher up. No
    ids give no rows, and a single id follows itself.
    """
    groups = ids.select(F.col("pair_id").cast("bigint").alias("first"), F.col("pair_id").cast("bigint").alias("last"))
    found = []
    for bits in range(0, 64, ID_BITS):
        above = F.shiftright("first", bits + ID_BITS) if bits + ID_BITS < 64 else F.lit(0)
        placed = groups.withColumn("above", above)
        following = F.lead("first").over(W.partitionBy("above").orderBy("first"))
        found.append(placed.select(F.col("last").alias("pair_id"), following.alias("next_id")).where("next_id IS NOT NULL"))
        groups = placed.groupBy("above").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("above")
    out = groups.select(F.col("last").alias("pair_id"), F.col("first").alias("next_id"))
    for level in found:
        out = out.unionByName(level)
    return out


def swapped_replies(turns: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from plain ones, both with ``pair_id, turn, role, text``.

    The chosen conversation runs up to its last assistant turn. In the rejected one that turn says
    what the last assistant turn of the next conversation by id that has one says; the last such
    conversation takes that of the first. Ids are integers. Conversations without an assistant turn give
    no pair; ``pair_id`` is the chosen one's id.
    """
    said = written(clean_turns(turns, key), "turns")
    replies = said.where("said.role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "said")).alias("last"))
    replies = replies.select("pair_id", F.col("last.turn").alias("end"), F.col("last.said").alias("reply"))
    replies = written(replies, "replies")
    other = replies.select(F.col("pair_id").alias("next_id"), F.col("reply").alias("other"))
    pairs = per_slot(replies.join(next_ids(replies), "pair_id").join(other, "next_id").drop("next_id"))
    upto = with_slot(said).join(pairs, ["pair_id", "slot"]).where("turn <= end")
    rejected = F.when(F.col("turn") == F.col("end"), F.col("other")).otherwise(F.col("said"))
    return (
        upto.select("pair_id", "turn", "said.role", "said.text"),
        upto.select("pair_id", "turn", rejected.alias("said")).select("pair_id", "turn", "said.role", "said.text"),
    )


def preference_rows(chosen: DataFrame, rejected: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rendered turns of every pair: ``pair_id, part, turn, role, rendered, trained``.

    Both inputs have ``pair_id, turn, role, text``. ``part`` is ``prompt`` for the longest common
    prefix, which is rendered once and never trained on, and ``chosen`` or ``rejected`` for what
    follows on either side; ``trained`` marks the rendered turns that count in the loss, those of
    ``trained_roles``. The prefix ends before the first turn number that differs in role or text or
    that one side lacks. Pairs that agree throughout have a prompt only. Null roles count as
    ``user``, null texts as empty, rows without pair or turn number are left out, and repeated turn
    numbers count once (the smallest role and text). Empty tables give no rows; other columns are
    not read.
    """
    side = ["pair_id", "turn", "role", "text"]
    sides = chosen.select(*side, F.lit(True).alias("_chosen")).unionByName(rejected.select(*side, F.lit(False).alias("_chosen")))
    said = F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = (
        sides.where("pair_id IS NOT NULL AND turn IS NOT NULL")
        .groupBy("pair_id", "turn")
        .agg(F.min(F.when(F.col("_chosen"), said)).alias("c"), F.min(F.when(~F.col("_chosen"), said)).alias("r"))
    )
    both = written(turns.withColumn("same", F.col("c").eqNullSafe(F.col("r"))), "pairs")
    ends = both.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("differs"))
    in_prompt = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    parts = F.when(in_prompt, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said")))).otherwise(
        F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said")),
            F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said")),
        )
    )
    rendered = F.concat(F.lit("<|"), F.col("said.role"), F.lit("|>\n"), F.col("said.text"), F.lit("<|end|>\n"))
    return (
        with_slot(both)
        .join(per_slot(ends), ["pair_id", "slot"])
        .select("pair_id", "turn", F.inline(parts))
        .where("said is not null")
        .select(
            "pair_id",
            "part",
            "turn",
            F.col("said.role").alias("role"),
            rendered.alias("rendered"),
            ((F.col("part") != "prompt") & F.col("said.role").isin(*trained_roles)).alias("trained"),
        )
    )
