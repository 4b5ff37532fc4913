"""Instruction pairs out of a table of dialogue turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turns of one conversation handled together; longer conversations are cut here.
SPAN = 1024


def dialogue_pairs(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Each user turn directly followed by an assistant turn, as an instruction row.

    A conversation is cut into spans of turn numbers, and only (conversation, span)
    groups are windowed, so one endless conversation spreads over many tasks. The first
    turn of every later span is copied into the span before it, where it only serves as
    the successor of that span's last turn.
    """
    part = F.greatest(F.floor(F.col("turn") / F.lit(span)), F.lit(0).cast("bigint"))
    rows = turns.select("conv_id", "turn", "role", "text", part.alias("part"), F.lit(False).alias("copied"))

    openings = (
        rows.filter(F.col("turn") >= span)
        .groupBy("conv_id", "part")
        .agg(F.min_by(F.struct("turn", "role", "text"), "turn").alias("head"))
    )
    earlier = F.lag("part").over(Window.partitionBy("conv_id").orderBy("part"))
    copies = openings.select(
        "conv_id",
        "head.turn",
        "head.role",
        "head.text",
        F.coalesce(earlier, F.lit(0).cast("bigint")).alias("part"),
        F.lit(True).alias("copied"),
    )

    ordered = Window.partitionBy("conv_id", "part").orderBy("turn")
    followed = rows.unionByName(copies).select(
        "*", F.lead("role").over(ordered).alias("next_role"), F.lead("text").over(ordered).alias("output")
    )
    return followed.filter(
        (F.col("role") == "user") & (F.col("next_role") == "assistant") & ~F.col("copied")
    ).select(
        "conv_id",
        "turn",
        F.col("text").alias("instruction"),
        F.lit("").alias("input"),
        "output",
    )
