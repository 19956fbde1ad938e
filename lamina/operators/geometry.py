"""Points and masks moved, scaled, clipped, cut into tiles and numbered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def affine(points: DataFrame, scale: float, dx: float, dy: float) -> DataFrame:
    """Rounded image of each point under a scale and a shift."""
    return points.withColumns({"x": F.rint(F.col("x") * scale + dx).cast("int"), "y": F.rint(F.col("y") * scale + dy).cast("int")})


def pixel_offset(um: float, scale: float) -> int:
    """Whole pixels of a stage offset, cut towards zero."""
    return int(um / scale)


def inside(points: DataFrame, width: int, height: int) -> DataFrame:
    """Points on the canvas; null and non-finite coordinates are not."""
    ok = lambda c, size: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0) & (F.col(c) < size)
    return points.filter(ok("x", width) & ok("y", height))


def clamped(points: DataFrame, scale: float, width: int, height: int) -> DataFrame:
    """Scaled points, rounded half to even and moved to the nearest pixel of the canvas."""
    put = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint(F.col(c) * scale).cast("int")))
    return points.withColumns({"x": put("x", width), "y": put("y", height)})


def shrunk(mask: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour reduction: every `factor`-th pixel in both directions."""
    kept = mask.filter((F.col("x") % factor == 0) & (F.col("y") % factor == 0))
    return kept.withColumns({c: F.floor(F.col(c) / factor).cast("int") for c in "xy"})


def enlarged(mask: DataFrame, factor: int) -> DataFrame:
    """Each pixel as a square of `factor` by `factor` pixels."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = mask.withColumn("x", F.explode(F.transform(steps, lambda d: F.col("x") * factor + d)))
    return wide.withColumn("y", F.explode(F.transform(steps, lambda d: F.col("y") * factor + d)))


def covered_share(mask: DataFrame, factor: int) -> DataFrame:
    """Area reduction: share of each square's pixels that are in the mask."""
    square = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in "xy"]
    return mask.groupBy("sample", *square).agg((F.count("*") / F.lit(float(factor * factor))).alias("share"))


def warped(mask: DataFrame, scale: float, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """Nearest-neighbour warp: each pixel of the new canvas takes the source pixel that it came from.

    A source pixel knows which few new pixels may round to it, so nothing is joined and no canvas is built.
    """
    def spots(c: str, shift: float, size: int) -> Column:
        low, high = F.floor((F.col(c) - 0.5) * scale + shift), F.ceil((F.col(c) + 0.5) * scale + shift)
        near = F.sequence(low.cast("int"), high.cast("int"))
        return F.filter(near, lambda v: (F.rint((v - shift) / scale) == F.col(c)) & (v >= 0) & (v < size))

    wide = mask.withColumn("nx", F.explode(spots("x", dx, width))).withColumn("ny", F.explode(spots("y", dy, height)))
    return wide.drop("x", "y").withColumnsRenamed({"nx": "x", "ny": "y"})


def filled(lines: DataFrame) -> DataFrame:
    """sample, x and y of all pixels between two lines (sample, x, top, bottom), both included."""
    return lines.select("sample", "x", F.explode(F.sequence(F.rint("top").cast("int"), F.rint("bottom").cast("int"))).alias("y"))


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of an elliptic kernel of odd size."""
    r = size // 2
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round(r * math.sqrt(max(0.0, (r * r - dy * dy) / (r * r or 1))))]


def spread(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """For each pixel those that the offsets lead to, with how many mask pixels lead there."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    rows = mask.select("sample", "x", "y", F.explode(steps).alias("o"))
    return rows.groupBy("sample", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).agg(F.count("*").alias("n"))


def halo_tiles(points: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Each point once for every tile that sees it, in its valid region or in the halo of `overlap` around it."""
    stride = tile - 2 * overlap

    def seen(c: str) -> Column:
        own = F.floor(F.col(c) / stride)
        left = F.when((F.col(c) < own * stride + overlap) & (own > 0), own - 1)
        return F.array_compact(F.array(left, own, F.when(F.col(c) >= (own + 1) * stride - overlap, own + 1)))

    return points.withColumn("tile_r", F.explode(seen("cy"))).withColumn("tile_c", F.explode(seen("cx")))


def numbered(rows: DataFrame, sample: str, part: list[str], order: list[str]) -> DataFrame:
    """Numbers from 1 within each sample, by part and then by order.

    Rows are ranked within their part only, and parts start where the counts of those before end, so no
    task sorts a whole sample.
    """
    counts = rows.groupBy(sample, *part).agg(F.count("*").alias("size"))
    before = Window.partitionBy(sample).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(sample, *part, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(sample, *part).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(within)).join(starts, [sample, *part]).withColumn("id", F.col("start") + F.col("rank")).drop("start", "rank")


def first_claims(rows: DataFrame, pixel: list[str], order: list[str]) -> DataFrame:
    """Of the rows that want a pixel, the first in order."""
    w = Window.partitionBy(*pixel).orderBy(*order)
    return rows.withColumn("claim", F.row_number().over(w)).filter("claim = 1").drop("claim")


def labels(pixels: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Area and centroid of each label of a sample, of those with at least a share of the mean area, numbered anew from 1."""
    found = pixels.groupBy("sample", "label").agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    mean = F.avg("area").over(Window.partitionBy("sample"))
    kept = found.withColumn("mean", mean).filter(F.col("area") >= least_share * F.col("mean")).drop("mean")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("sample").orderBy("label")))


def odd_size(base: float, rate: float, least: int = 1) -> int:
    """Kernel size for a scaled image: rounded half to even, odd, at least `least`."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be above 0 and at most 1")
    size = max(least, round(base * rate))
    return size + (1 - size % 2)
