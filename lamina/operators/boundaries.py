"""Layer boundaries: edges of masks, comparison with annotated lines, interpolation, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def column_edges(mask: DataFrame, width: int, height: int) -> DataFrame:
    """sample, layer, x, top and bottom: least and greatest y per column where the 3x3 gradient of a layer is not zero.

    `mask` has sample, layer, x and y. The gradient is dilation less erosion, and what lies outside the
    canvas is ignored by both: a pixel of the canvas counts if some but not all of its
    neighbours there, itself included, are in the mask.
    """
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    rows = mask.select("sample", "layer", F.explode(F.transform(steps, lambda d: F.col("x") + d)).alias("x"), "y")
    rows = rows.select("sample", "layer", "x", F.explode(F.transform(steps, lambda d: F.col("y") + d)).alias("y"))
    met = rows.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).groupBy("sample", "layer", "x", "y").agg(F.count("*").alias("n"))
    side = lambda c, size: F.lit(3) - F.when(F.col(c) == 0, 1).otherwise(0) - F.when(F.col(c) == size - 1, 1).otherwise(0)
    return met.filter(F.col("n") < side("x", width) * side("y", height)).groupBy("sample", "layer", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))


def edge_errors(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Mean absolute difference of top and of bottom over the columns that both have, and the mean of the two.

    Both have sample, layer, x, top and bottom; a missing top or bottom leaves the other's value as mean.
    """
    other = theirs.select("sample", "layer", "x", F.col("top").alias("top_gt"), F.col("bottom").alias("bottom_gt"))
    met = ours.join(other, ["sample", "layer", "x"]).groupBy("sample", "layer")
    found = met.agg(F.count("*").alias("columns"), F.avg(F.abs(F.col("top") - F.col("top_gt"))).alias("top_error"), F.avg(F.abs(F.col("bottom") - F.col("bottom_gt"))).alias("bottom_error"))
    return found.withColumn("error_px", F.coalesce((F.col("top_error") + F.col("bottom_error")) / 2, "top_error", "bottom_error"))


def column_medians(points: DataFrame, key: str, x: Column) -> DataFrame:
    """Median y of each key and column x."""
    return points.groupBy(key, x.alias("x")).agg(F.median("y").alias("y"))


def interpolated(knots: DataFrame, wanted: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """key, x and y for each distinct (key, x) wanted: y on the line between the knots left and right, clamped at the ends.

    Knots (key, x, y) that share an x count as their median; keys without knots give null. A key is
    cut into stretches of `width` in x: each is one sorted pass forth and one back, and gets the last knot before
    and the first after it from a table of one row for each stretch.
    """
    marked = column_medians(knots, key, F.col("x")).select(key, "x", "y", F.lit(False).alias("asked"))
    both = marked.unionByName(wanted.select(key, "x", F.lit(None).cast("double").alias("y"), F.lit(True).alias("asked")))
    one = both.groupBy(key, "x").agg(F.max("y").alias("y"), F.max("asked").alias("asked"))
    at = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    one = one.select(key, "x", "asked", at.alias("at"), F.floor(F.col("x") / width).alias("stretch"))
    ends = one.groupBy(key, "stretch").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    row = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "stretch", F.last("hi", True).over(row.orderBy("stretch")).alias("left"), F.last("lo", True).over(row.orderBy(F.desc("stretch"))).alias("right"))
    own = Window.partitionBy(key, "stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = (F.last("at", True).over(own.orderBy(c)) for c in (F.col("x"), F.desc("x")))
    placed = one.withColumns({"a": before, "b": after}).filter("asked").join(carried, [key, "stretch"])
    placed = placed.select(key, "x", F.coalesce("a", "left").alias("a"), F.coalesce("b", "right").alias("b"))
    share = (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    inside = F.when(F.col("b.x") == F.col("a.x"), F.col("a.y")).otherwise(F.col("a.y") + share * (F.col("b.y") - F.col("a.y")))
    return placed.select(key, "x", F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull(), F.col("a.y")).otherwise(inside).alias("y"))


def mean_absolute_error(points: DataFrame, truth: DataFrame, key: str, values: dict[str, str] | None = None) -> DataFrame:
    """Per key: mean distance of the column medians of `points` from the interpolated truth; null without truth.

    `values` names the columns to compare and their results (y as mae, if not given); the truth is interpolated once for all.
    """
    values = values or {"y": "mae"}
    ours = points.groupBy(key, F.col("x").cast("int").alias("x")).agg(*[F.median(c).alias(c) for c in values])
    line = interpolated(truth, ours, key).withColumnRenamed("y", "_line")
    return ours.join(line, [key, "x"]).groupBy(key).agg(*[F.avg(F.abs(F.col(c) - F.col("_line"))).alias(n) for c, n in values.items()])


def improvement_percent(before: Column, after: Column) -> Column:
    return (before - after) / F.greatest(before, F.lit(1e-8)) * 100


#: Boundary below a layer, by the layer's name, where layers 2 and 3 are merged or apart.
BELOW = {"L1": "L1_2", "L2/3": "L3_4", "L3": "L3_4", "L4": "L4_5"}


def inner_boundaries(layers: DataFrame) -> DataFrame:
    """sample, boundary and depth of the bounds between layers (sample, layer, start, end): not the last, and inside 0..1."""
    w = Window.partitionBy("sample").orderBy("start")
    named = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in BELOW.items()])
    ends = layers.select("sample", named.alias("boundary"), F.col("end").alias("depth"), F.lead("layer").over(w).alias("next"))
    return ends.filter("next is not null and depth > 0 and depth < 1 and boundary is not null").select("sample", "boundary", "depth")


def tagged(points: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Points with their slug replaced by the boundary's tag; slugs without a tag are dropped."""
    tag = F.coalesce(*[F.when(F.col("slug") == k, v) for k, v in tags.items()])
    return points.withColumn("boundary", tag).filter(F.col("boundary").isNotNull()).drop("slug")


def layer_fronts(mask: DataFrame) -> DataFrame:
    """sample, layer, x and y: the first pixel of each layer in each column, its upper boundary."""
    return mask.groupBy("sample", "layer", "x").agg(F.min("y").alias("y"))
