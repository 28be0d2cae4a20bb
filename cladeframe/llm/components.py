"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  Only minima are gathered per node, so a hub costs one row per edge."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = both.join(low, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``(a, b)`` links -> ``(id, component)`` with the smallest reachable id.

    Ids without a link to another id do not appear.  Each round is written to the shared
    folder; the rounds end when the edge table no longer changes, about the logarithm of
    the longest shortest path.  Nulls and loops are not links.
    """
    current = scratch.keep(edges.select("a", "b").filter("a <> b").distinct(), f"{label}-0")
    digest = lambda df: df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")
    ).first()
    seen, turn = None, 0
    while True:
        now = digest(current)
        if now == seen:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen, turn = now, turn + 1
        following = scratch.keep(_star(_star(current, True), False), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        current = following
