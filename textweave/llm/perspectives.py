"""Multi-party perspective rotation of dialogues.

Every participant of a dialogue gets a rendering of it in which that speaker is the assistant and
the others are named users, with the spans that a model should learn: the turns of that speaker.

A dialogue is rendered in parts of a fixed number of turns, so one that holds a third of all turns
is many rows; most dialogues are one part. Turns are numbered over the whole table in ranges of
their order, without gathering a dialogue. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.operators.ordering import numbered
from textweave.session import materialise

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
NO_NAME = "unknown"


def _heading(turn: Column, participant: Column) -> Column:
    """How a turn begins in the rendering for ``participant``."""
    speaker = turn["speaker"]
    return (
        F.when(speaker == participant, F.lit(f"{BEGIN}assistant\n"))
        .when(turn["system"], F.lit(f"{BEGIN}system\n"))
        .otherwise(F.concat(F.lit(f"{BEGIN}user name="), speaker, F.lit("\n")))
    )


def rendered(turns: Column, participant: Column) -> Column:
    """``(text, spans)`` of an array of turns; spans are ``(begin, end)`` in code points, end exclusive."""

    def add(have: Column, turn: Column) -> Column:
        text = F.concat(have["text"], _heading(turn, participant))
        said = F.concat(turn["text"], F.lit(END))
        span = F.struct(F.length(text).alias("begin"), (F.length(text) + F.length(said)).alias("end"))
        own = turn["speaker"] == participant
        return F.struct(
            F.concat(text, said).alias("text"),
            F.when(own, F.concat(have["spans"], F.array(span))).otherwise(have["spans"]).alias("spans"),
        )

    none = F.array().cast("array<struct<begin:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit("").alias("text"), none.alias("spans")), add)


def rotate(conversations: DataFrame, turns_per_part: int = 64, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """``(conv_id, participant, part, n_turns, text, spans)``: one row for each participant and part.

    Input columns are ``conv_id, turn, role, text``; others are not read. The parts of a rendering in
    order are the whole of it; spans count from the start of the part. A part without a turn of its
    participant has no spans, but is rendered.

    A null or blank role is the speaker ``unknown``. Roles in ``system_roles`` are instructions: they
    keep their role in every rendering and take no part, so a dialogue of them alone has no rows. A
    null text is empty. Turns come by ``turn`` (null first), ties by role and text; turns given twice
    are two turns. Null conversation ids are one conversation. An empty table gives an empty result.
    """
    role = F.trim(F.coalesce("role", F.lit("")))
    turns = conversations.select(
        "conv_id",
        "turn",
        F.when(role == "", F.lit(NO_NAME)).otherwise(role).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("system", F.col("speaker").isin(*system_roles))
    order = [F.col("conv_id"), F.col("turn"), F.col("speaker"), F.xxhash64("text")]
    turns = materialise(numbered(turns, order, "place"), "turns")
    facts = turns.groupBy("conv_id").agg(F.min("place").alias("first"))
    conv = lambda df, name: df.withColumnRenamed("conv_id", name).hint("merge")
    parts = (
        turns.join(conv(facts, "own"), F.col("conv_id").eqNullSafe(F.col("own")))
        .withColumn("part", F.floor((F.col("place") - F.col("first")) / turns_per_part))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("place", "speaker", "text", "system"))).alias("turns"))
    )
    people = turns.filter(~F.col("system")).select(F.col("conv_id").alias("own"), F.col("speaker").alias("participant")).distinct()
    return (
        parts.join(people.hint("merge"), F.col("conv_id").eqNullSafe(F.col("own")))
        .withColumn("done", rendered(F.col("turns"), F.col("participant")))
        .select("conv_id", "participant", "part", F.size("turns").alias("n_turns"), F.col("done.text").alias("text"), F.col("done.spans").alias("spans"))
    )
