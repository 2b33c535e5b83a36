"""Conversation tables ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgweave.functions.columns import ordered_lines, shown

# Fixed value: the text of an empty history.
NO_HISTORY = "No previous conversation."


def _newest_first(k: int, conv: DataFrame) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    ranked = conv.withColumn("_back", F.row_number().over(newest))
    return ranked.filter(F.col("_back") <= k)


def last_turns(conv: DataFrame, k: int | None) -> DataFrame:
    """Last k messages of each conversation, in order; all when k is None.

    The cut leaves each conversation in one partition, where it is put back in
    order; whole conversations, of any length, are range-sorted instead.
    """
    if k is None:
        return conv.orderBy("conv_id", "turn")
    return _newest_first(k, conv).drop("_back").sortWithinPartitions("conv_id", "turn")


def append_turns(conv: DataFrame, new: DataFrame) -> DataFrame:
    """Add messages ``(conv_id, step, role, text)`` behind the last turn.

    ``step`` counts the new messages of a conversation from 1.  An unknown
    conversation starts at turn 0.
    """
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    added = new.join(last, "conv_id", "left").select(
        "conv_id",
        (F.coalesce("_last", F.lit(-1)) + F.col("step")).alias("turn"),
        "role",
        "text",
    )
    return conv.select("conv_id", "turn", "role", "text").unionByName(added)


def clear_history(conv: DataFrame, cleared: DataFrame) -> DataFrame:
    """Drop every turn of the cleared conversations."""
    return conv.join(cleared.select("conv_id").distinct(), "conv_id", "left_anti")


def previous_turns(conv: DataFrame) -> DataFrame:
    """Everything except the newest message of each conversation."""
    newest = conv.groupBy("conv_id").agg(F.max("turn").alias("_newest"))
    return (
        conv.join(newest, "conv_id").filter(F.col("turn") < F.col("_newest"))
    ).select(*conv.columns)


def format_history(
    conv: DataFrame, k: int = 5, exclude_newest: bool = True
) -> DataFrame:
    """``(conv_id, history)``: the last k messages as ``Role: text`` lines.

    With ``exclude_newest`` the newest message is the question being asked and
    does not count.  A conversation with nothing left gets a fixed sentence.
    """
    skip = 1 if exclude_newest else 0
    line = F.concat(F.initcap(shown(F.col("role"))), F.lit(": "), shown(F.col("text")))
    # Joining lines skips nulls, so the question itself adds no line.
    kept = F.when(F.col("_back") > skip, line)
    lines = (
        _newest_first(k + skip, conv)
        .select("conv_id", "turn", kept.alias("line"))
        .groupBy("conv_id")
        .agg(
            F.count("line").alias("_lines"),
            ordered_lines([F.col("turn")], F.col("line")).alias("history"),
        )
    )
    history = F.when(F.col("_lines") > 0, F.col("history")).otherwise(NO_HISTORY)
    return lines.select("conv_id", history.alias("history"))
