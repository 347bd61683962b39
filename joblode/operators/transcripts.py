"""Question-and-answer transcripts ``(conv_id, turn, role, text[, tool_calls])``.

Histories stay rows, ordered by ``turn``: a conversation of any length is never
gathered into one row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.text import strip


def history(messages: DataFrame, system_prompt: str) -> DataFrame:
    """Messages of each conversation with the system prompt as turn -1."""
    first = messages.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"),
        F.lit(system_prompt).alias("text"))
    return first.unionByName(messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                                             "role", "text"))


def final_answer(messages: DataFrame) -> DataFrame:
    """The text of the last turn of each conversation."""
    return messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """All tools called, one row each; ``turn, call`` give the order."""
    return messages.select("conv_id", "turn", F.posexplode("tool_calls").alias("call", "tool"))


def transcript_checks(messages: DataFrame, tool: str, any_of: tuple[str, ...],
                      refusals: tuple[str, ...] = K.REFUSALS) -> DataFrame:
    """Per conversation: was a tool called, was any of some, is the answer given, is it a refusal.

    Flags are folded per turn, so no list of calls is built.
    """
    flags = messages.select(
        "conv_id", "turn", "text",
        F.coalesce(F.array_contains("tool_calls", tool), F.lit(False)).alias("_one"),
        F.coalesce(F.arrays_overlap("tool_calls", F.array(*map(F.lit, any_of))),
                   F.lit(False)).alias("_any"))
    folded = flags.groupBy("conv_id").agg(
        F.bool_or("_one").alias("called_tool"), F.bool_or("_any").alias("called_any"),
        F.max_by("text", "turn").alias("answer"))
    low = F.lower("answer")
    return folded.select(
        "conv_id", "called_tool", "called_any",
        (strip(F.col("answer")) != "").alias("answered"),
        reduce(or_, [low.contains(p) for p in refusals]).alias("refused"))
