"""Connected components of a link table, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.sinks import scratch


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the smallest node it can reach.

    ``links`` has two columns of one orderable type without nulls; self links, repeated and
    reversed links do no harm, and no links give no rows. Each round joins every node's larger
    neighbours to the smallest node around it, then the smaller ones; the table never holds
    more rows than nodes and links, and the rounds grow with the logarithm of the longest
    chain. Rounds are written to the scratch folder, so a lost executor costs one round at
    most; nothing but two numbers a round reaches the driver, and what a round leaves there
    goes before the next.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    current, path = scratch.stored_table(
        links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high <> low").distinct()
    )
    mark = _mark(current)
    while mark[0]:
        scratch.forget_finished(current.sparkSession)
        following, next_path = scratch.stored_table(_small_star(_large_star(current)))
        next_mark = _mark(following)
        scratch.release(path)
        current, path = following, next_path
        if next_mark == mark:
            break
        mark = next_mark
    node, root = F.col("high").alias("node"), F.col("low").alias("root")
    return current.select(node, root).unionByName(current.select(F.col("low").alias("node"), root).distinct())


def _mark(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), total).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the smallest of the node and its neighbours."""
    ways = links.select(F.col("high").alias("at"), F.col("low").alias("to")).unionByName(
        links.select(F.col("low").alias("at"), F.col("high").alias("to"))
    )
    least = ways.groupBy("at").agg(F.min("to").alias("least")).select("at", F.least("at", "least").alias("least"))
    larger = links.select(F.col("low").alias("at"), F.col("high").alias("to"))
    return larger.join(least, "at").select(F.col("to").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, linked to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()
