"""Tissue, white and gray matter masks of dark tissue on a bright background."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.filters import blurred, morphed
from lamina.operators.raster import otsu
from lamina.operators.staging import kept
from lamina.operators.tiles import TILE, filled_holes, mask_components


def largest_part(mask: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """The pixels of each sample's largest component, of equal ones the first."""
    parts = kept(mask_components(mask, width, tile=tile), "parts")
    sizes = parts.groupBy("sample", "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy("sample").agg(F.max(F.struct("n", (-F.col("component")).alias("order"))).alias("b")).select("sample", (-F.col("b.order")).alias("component"))
    return parts.join(best, ["sample", "component"]).select("sample", "x", "y")


def tissue(gray: DataFrame, width: int, height: int, blur: int = 5, multiplier: float = 1.0, border: int = 50, kernel: int = 51, times: int = 2, tile: int = TILE) -> DataFrame:
    """Largest part darker than the blurred image's Otsu threshold, without the canvas's border strip, opened, closed and filled."""
    smooth = kept(blurred(gray, blur, width, height, tile), "blurred")
    dark = smooth.join(otsu(smooth), "sample").filter(F.col("v") <= F.floor(F.col("threshold") * multiplier))
    inner = dark.filter(F.col("x").between(border, width - border - 1) & F.col("y").between(border, height - border - 1)).select("sample", "x", "y")
    clean = morphed(inner, [("open", "rect", kernel, times), ("close", "rect", kernel, times)], width, height, tile)
    return filled_holes(largest_part(clean, width, tile), width, height, tile)


def white(gray: DataFrame, tissue_mask: DataFrame, width: int, height: int, multiplier: float = 0.35, kernel: int = 51, times: int = 2, grow: int = 51, tile: int = TILE) -> DataFrame:
    """Largest part of the tissue at or below the multiple of its own Otsu threshold, opened, closed, grown and filled.

    Pixels that the table lacks are 0.
    """
    inside = kept(tissue_mask.join(gray.select("sample", "x", "y", "v"), ["sample", "x", "y"], "left").fillna(0, ["v"]), "inside")
    dark = inside.join(otsu(inside), "sample").filter(F.col("v") <= F.floor(F.col("threshold") * multiplier)).select("sample", "x", "y")
    clean = morphed(dark, [("open", "ellipse", kernel, times), ("close", "ellipse", kernel, times)], width, height, tile)
    grown = morphed(largest_part(clean, width, tile), [("dilate", "ellipse", grow, 1)], width, height, tile)
    return filled_holes(grown, width, height, tile)


def gray_matter(tissue_mask: DataFrame, white_mask: DataFrame, width: int, height: int, kernel: int = 91, times: int = 2, tile: int = TILE) -> DataFrame:
    """Largest part of the tissue that is not white matter, closed and opened."""
    left = tissue_mask.join(white_mask, ["sample", "x", "y"], "left_anti")
    clean = morphed(left, [("close", "ellipse", kernel, times), ("open", "ellipse", kernel, times)], width, height, tile)
    return largest_part(clean, width, tile)
