"""Pixels with colours (sample, x, y, b, g, r): palettes, buckets, layers by position, gray curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Colour of each layer (blue, green, red), in order of preference.
PALETTE = (("L1", 255, 100, 100), ("L2/3", 100, 255, 100), ("L4", 100, 100, 255), ("L5/6", 255, 255, 100))
#: Difference a channel may have from the palette; least pixels that prove a layer; least brightness of a colour.
TOLERANCE, EVIDENCE, DARK = 15, 100, 20


def palette_layer(tolerance: int = TOLERANCE) -> Column:
    """The first layer whose colour is within the tolerance in all channels; null if none is."""
    near = lambda colour: [F.abs(F.col(c) - v) <= tolerance for c, v in zip("bgr", colour, strict=True)]
    return F.coalesce(*[F.when(near(v)[0] & near(v)[1] & near(v)[2], name) for name, *v in PALETTE])


def palette_layers(pixels: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """sample, layer and pixels of the layers of which more than `evidence` pixels are found on the foreground."""
    seen = pixels.filter(F.greatest("b", "g", "r") > 10).select("sample", palette_layer().alias("layer")).filter("layer is not null")
    return seen.groupBy("sample", "layer").agg(F.count("*").alias("pixels")).filter(F.col("pixels") > evidence)


def buckets(pixels: DataFrame, size: int = 20) -> DataFrame:
    """Mean colour (cut to integers), mean y and pixels of each bucket of `size` per channel; dark ones are left out."""
    keys = [F.floor(F.col(c) / size).alias(f"{c}_bucket") for c in "bgr"]
    mean = [F.avg(c).cast("int").alias(c) for c in "bgr"]
    made = pixels.filter(F.greatest("b", "g", "r") > 10).groupBy("sample", *keys).agg(*mean, F.avg("y").alias("mean_y"), F.count("*").alias("pixels"))
    return made.filter(F.greatest("b", "g", "r") >= DARK)


def layers_by_position(found: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """Buckets with more than `evidence` pixels, from the top down, take the palette's layer names in order."""
    order = Window.partitionBy("sample").orderBy("mean_y", "b_bucket", "g_bucket", "r_bucket")
    names = F.array(*[F.lit(name) for name, *_ in PALETTE])
    ranked = found.filter(F.col("pixels") > evidence).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= len(PALETTE))
    return ranked.withColumn("layer", F.element_at(names, F.col("place")))


def coloured(pixels: DataFrame, layer: str = "layer") -> DataFrame:
    """Adds b, g and r of each pixel's layer."""
    table = {name: v for name, *v in PALETTE}
    return pixels.withColumns({c: F.coalesce(*[F.when(F.col(layer) == n, v[i]) for n, v in table.items()]) for i, c in enumerate("bgr")})


def gray_curve(value: Column, stops: tuple[tuple[int, int], ...]) -> Column:
    """Piecewise-linear curve through the stops, rounded half to even; clamped at the ends."""
    out = F.when(value <= stops[0][0], float(stops[0][1]))
    for (x0, y0), (x1, y1) in zip(stops[:-1], stops[1:], strict=True):
        out = out.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return F.rint(out.otherwise(float(stops[-1][1]))).cast("int")


def contrast(value: Column, alpha: float, beta: float) -> Column:
    """Absolute of a linear map, rounded and saturated at 255."""
    return F.least(F.lit(255), F.rint(F.abs(value * alpha + beta)).cast("int"))


def stretched(gray: DataFrame) -> DataFrame:
    """Gray values (sample, v, n) mapped to 0..255 by each sample's least and greatest; one value alone maps to 0."""
    w = Window.partitionBy("sample")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return gray.withColumn("stretched", F.coalesce(F.rint((F.col("v") - low) / F.nullif(high - low, F.lit(0)) * 255), F.lit(0.0)).cast("int"))
