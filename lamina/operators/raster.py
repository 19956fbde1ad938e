"""Masks as long tables of (sample, x, y): morphology, thresholds, tiles, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _spread(mask: DataFrame, radius: int) -> DataFrame:
    """For each pixel the pixels of the square around it, with how many mask pixels reach them."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    rows = mask.select("sample", F.explode(F.transform(steps, lambda d: F.col("x") + d)).alias("x"), "y").select("sample", "x", F.explode(F.transform(steps, lambda d: F.col("y") + d)).alias("y"))
    return rows.groupBy("sample", "x", "y").agg(F.count("*").alias("n"))


def dilated(mask: DataFrame, radius: int = 1) -> DataFrame:
    return _spread(mask, radius).select("sample", "x", "y")


def eroded(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Pixels whose whole square is in the mask; what lies outside the image counts as empty."""
    return _spread(mask, radius).filter(F.col("n") == (2 * radius + 1) ** 2).select("sample", "x", "y")


def opened(mask: DataFrame, radius: int = 1) -> DataFrame:
    return dilated(eroded(mask, radius), radius)


def otsu(gray: DataFrame) -> DataFrame:
    """Threshold per sample with the largest variance between classes, the least of equals."""
    hist = gray.groupBy("sample", "v").agg(F.count("*").alias("n"))
    low = Window.partitionBy("sample").orderBy("v")
    every = Window.partitionBy("sample")
    c = hist.withColumns({"w0": F.sum("n").over(low), "s0": F.sum(F.col("n") * F.col("v")).over(low), "w": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("v")).over(every)}).filter("w0 < w")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    scored = c.withColumn("score", F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * gap * gap)
    best = Window.partitionBy("sample").orderBy(F.desc("score"), "v")
    return scored.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("sample", F.col("v").alias("threshold"))


def tile_counts(cells: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Cells of the one tile whose valid region (half-open) holds each."""
    stride = tile - 2 * overlap
    return cells.groupBy("sample", F.floor(F.col("cy") / stride).alias("tile_r"), F.floor(F.col("cx") / stride).alias("tile_c")).agg(F.count("*").alias("n"), F.sum("area_px").alias("area_px"))


def pasted(under: DataFrame, over: DataFrame, dx: int, dy: int, value: str) -> DataFrame:
    """`over`, moved by an offset, laid on `under`: where both have a pixel, the upper one wins."""
    moved = over.select("sample", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col(value).alias("_top"))
    return under.join(moved, ["sample", "x", "y"], "left").withColumn(value, F.coalesce("_top", value)).drop("_top")
