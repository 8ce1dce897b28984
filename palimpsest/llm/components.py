"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).union(least.select("u", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the component's
    smallest node. Nulls and loops are ignored; no edge gives no row. Each round
    is written to the shared folder; rounds grow with the logarithm of the
    largest component."""
    now = stash(edges.select("a", "b").filter("a <> b").distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        now = stash(_small_star(_large_star(now)).filter("a <> b").select("a", "b").distinct(), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select("a", "a").distinct())
