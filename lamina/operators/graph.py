"""Connected components of masks and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.staging import kept


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for all nodes of an edge table (u, v), by large-star and small-star rounds."""
    now = kept(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        row = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if row == print_of:
            break
        print_of = row
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def mask_components(mask: DataFrame, width: int) -> DataFrame:
    """sample, x, y and component (least y * width + x) of a mask's pixels; pixels that touch at a side or corner belong together."""
    from lamina.operators import tiles  # it needs this module

    return tiles.mask_components(mask, width)


def largest(parts: DataFrame) -> DataFrame:
    """The largest component of each sample (of equal ones the least) and its pixels."""
    sizes = parts.groupBy("sample", "component").agg(F.count("*").alias("pixels"))
    best = sizes.groupBy("sample").agg(F.max(F.struct("pixels", (-F.col("component")).alias("c"))).alias("b"))
    return best.select("sample", (-F.col("b.c")).alias("component"), F.col("b.pixels").alias("pixels"))
