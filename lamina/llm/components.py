"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Node and least node of its component, for all nodes that have an edge.

    `edges` has two long columns u and v; loops and nulls are ignored, repeated edges are harmless, an
    empty table gives an empty result. A star's hub meets its leaves by a join and a partial
    aggregate, never in one collected group. Each round is written to the shared scratch folder.
    """
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(now, name)
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    print_of = None
    for _ in range(max_rounds):
        # Half a round at a time: both halves read their input more than once.
        now = staged(_small_star(staged(_large_star(now).distinct(), name)).distinct(), name)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (seen := tuple(row)) == print_of:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        print_of = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
