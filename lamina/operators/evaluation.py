"""Layer masks against annotations: overlap, thickness, boundary errors, summaries, improvements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL_UM = 0.1625
LAYERS = ("L1", "L2/3", "L4", "L5/6")


def ratio(over: Column, under: Column) -> Column:
    """over / under, 0 where under is 0."""
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def overlap(pixels: DataFrame) -> DataFrame:
    """Per sample and layer: pixel counts, IoU, Dice, precision, recall and status.

    A pixel is one row of (sample, x, y, algo_layer, gt_layer); it is counted for the layers it has
    on either side, so both masks meet without a join and one partial aggregate is shuffled.
    """
    sides = F.array_distinct(F.array_compact(F.array("algo_layer", "gt_layer")))
    rows = pixels.select("sample", F.explode(sides).alias("layer"), "algo_layer", "gt_layer")
    in_algo, in_gt = F.col("layer").eqNullSafe(F.col("algo_layer")), F.col("layer").eqNullSafe(F.col("gt_layer"))
    n = rows.groupBy("sample", "layer").agg(F.count_if(in_algo & in_gt).alias("tp"), F.count_if(in_algo).alias("algo_px"), F.count_if(in_gt).alias("gt_px"))
    tp, a, g = F.col("tp"), F.col("algo_px"), F.col("gt_px")
    status = F.when(a == 0, "algo_missing").when(g == 0, "gt_missing").otherwise("ok")
    return n.select("sample", "layer", "tp", "algo_px", "gt_px", ratio(tp, a + g - tp).alias("iou"), ratio(2 * tp, a + g).alias("dice"), ratio(tp, a).alias("precision"), ratio(tp, g).alias("recall"), status.alias("status"))


def thickness(pixels: DataFrame) -> DataFrame:
    """Mean column thickness of each mask (max y - min y + 1), its error in px, % and µm; both masks needed."""
    parts = []
    for side in ("algo", "gt"):
        columns = pixels.filter(F.col(f"{side}_layer").isNotNull()).groupBy("sample", F.col(f"{side}_layer").alias("layer"), "x").agg((F.max("y") - F.min("y") + 1).alias("t"))
        parts.append(columns.groupBy("sample", "layer").agg(F.avg("t").alias(f"{side}_mean_thickness_px")))
    a, g = F.col("algo_mean_thickness_px"), F.col("gt_mean_thickness_px")
    both = parts[0].join(parts[1], ["sample", "layer"])
    return both.select("sample", "layer", a, g, F.abs(a - g).alias("thickness_error_px"), (100 * ratio(F.abs(a - g), g)).alias("thickness_error_percent"), (F.abs(a - g) * PIXEL_UM).alias("thickness_error_um"))


def boundary_error(boundary: DataFrame) -> DataFrame:
    """Mean absolute distance of two boundaries over their common columns, in px and µm."""
    return boundary.groupBy("boundary").agg(F.avg(F.abs(F.col("y") - F.col("y_gt"))).alias("error_px"), F.count("*").alias("columns")).withColumn("error_um", F.col("error_px") * PIXEL_UM)


def over_under(pixels: DataFrame) -> DataFrame:
    """Pixels of each layer that only the one or only the other mask has."""
    found = overlap(pixels)
    return found.select("sample", "layer", (F.col("algo_px") - F.col("tp")).alias("over_px"), (F.col("gt_px") - F.col("tp")).alias("under_px"))


def summary(metrics: DataFrame, value: str) -> DataFrame:
    """Statistics per layer and over all layers (layer OVERALL, without cv); std has n-1."""
    v = F.col(value)
    grouped = metrics.groupingSets([["layer"], []], "layer").agg(
        F.when(F.grouping("layer") == 1, "OVERALL").otherwise(F.col("layer")).alias("name"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("low"), F.percentile(v, F.lit(0.25)).alias("q25"), F.median(v).alias("median"), F.percentile(v, F.lit(0.75)).alias("q75"), F.max(v).alias("high"),
    )
    cv = F.when((F.col("mean") > 0) & (F.col("name") != "OVERALL"), F.col("std") / F.col("mean"))
    return grouped.select(F.col("name").alias("layer"), "n", "mean", "std", "low", "q25", "median", "q75", "high", cv.alias("cv"))


def type_summary(metrics: DataFrame, values: list[str]) -> DataFrame:
    """Means per layer and type, and per type over all layers."""
    grouped = metrics.groupingSets([["layer", "type"], ["type"]], "layer", "type").agg(F.grouping("layer").alias("g"), *[F.avg(v).alias(v) for v in values])
    return grouped.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("layer")).alias("layer"), "type", *values)


def improvement(metrics: DataFrame, value: str, lower_is_better: bool) -> DataFrame:
    """Change from coarse to refined per sample and layer, % of the coarse value; none where that is 0 or missing."""
    wide = metrics.groupBy("sample", "layer").pivot("type", ["coarse", "refined"]).agg(F.avg(value))
    gain = (F.col("refined") - F.col("coarse")) / F.abs("coarse") * 100
    return wide.filter("coarse <> 0 and refined is not null").select("sample", "layer", (-gain if lower_is_better else gain).alias("improvement"))


def by_layer(metrics: DataFrame, value: str) -> DataFrame:
    """Samples by layers, mean of a metric; one column for each layer."""
    wide = metrics.groupBy("sample").pivot("layer", list(LAYERS)).agg(F.avg(value))
    return wide.select("sample", *[F.col(f"`{c}`").alias(c.lower().replace("/", "_")) for c in LAYERS])


def histogram(metrics: DataFrame, value: str, bins: int = 8) -> DataFrame:
    """Counts in equal bins from the least to the largest value; the last bin is closed on both ends."""
    ends = metrics.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    return metrics.filter(F.col(value).isNotNull()).join(F.broadcast(ends)).filter("hi > lo").groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """Counts, precision and recall of a boolean prediction against the truth."""
    n = pairs.agg(F.count_if(F.col("pred") & F.col("gt")).alias("tp"), F.count_if(F.col("pred") & ~F.col("gt")).alias("fp"), F.count_if(~F.col("pred") & F.col("gt")).alias("fn"))
    return n.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def in_micrometres(metrics: DataFrame, scale: float = 0.1625) -> DataFrame:
    """Adds a column `*_um` for every `*_px`, rounded half to even at 3 places."""
    made = {c[:-3] + "_um": F.round(F.rint(F.col(c) * scale * 1000) / 1000, 3) for c in metrics.columns if c.endswith("_px")}
    return metrics.withColumns(made)
