"""Chat formatting by perspective rotation.

A dialogue of several parties is rendered once for every party: its own turns as `assistant`, those of the others as
`user` with their names, turns of context roles (system) as they are. The mask tells which characters are learned from:
the rotated speaker's contents and their end marks.

Only DataFrame expressions run. Long dialogues are rendered in blocks of `block_turns` turn numbers, so that a
conversation with a great share of all rows is spread over many tasks; blocks in order make up the dialogue. Speakers
are counted before the shuffle; blocks meet the speakers of their conversation in a join that Spark splits where hot.

Defined results: rows that repeat are rendered once; turns come in order of turn (null first), role and text; null text
is empty; a null role is the speaker named `unknown`; a null conv_id is a conversation of its own; conversations with
context turns alone give no row; an empty table gives an empty result; other columns take no part. Texts of any length
are rendered whole, a block of turns in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _head(turn: Column, speaker: Column, context: tuple[str, ...]) -> Column:
    """What stands before a turn's content."""
    other = F.concat(F.lit("<|user name="), turn.role, F.lit("|>\n"))
    own = F.lit("<|assistant|>\n")
    return F.when(turn.role.isin(*context), F.concat(F.lit("<|"), turn.role, F.lit("|>\n"))).when(turn.role == speaker, own).otherwise(other)


END = "<|end|>\n"


def rotate(
    turns: DataFrame,
    context: tuple[str, ...] = ("system",),
    block_turns: int = 64,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation, speaker and block: conv_id, speaker, block, n_turns, n_own, text, mask (array of start and end
    in characters)."""
    rows = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(0)).cast("long"))
    speakers = rows.filter(~F.col("role").isin(*context)).select("conv", F.col("role").alias("speaker")).distinct()
    unique = rows.distinct()
    blocks = unique.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    met = blocks.join(speakers, "conv")
    speaker = F.col("speaker")
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(_head(t, speaker, context), t.text, F.lit(END)).alias("text"),
            F.length(_head(t, speaker, context)).alias("head"),
            ((t.role == speaker) & ~t.role.isin(*context)).alias("own"),
        ),
    )
    met = met.withColumn("parts", parts)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        end = state.at + F.length(part.text)
        span = F.array(F.struct((state.at + part.head).alias("start"), (end - 1).alias("end")))  # without the last line break
        return F.struct(end.alias("at"), F.when(part.own, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    return met.select(
        F.col("conv.id").alias("conv_id"), "speaker", "block", F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p.own)).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: p.text), "").alias("text"),
        F.aggregate("parts", start, step, lambda s: s.spans).alias("mask"),
    )
