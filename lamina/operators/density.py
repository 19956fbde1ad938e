"""Depth and density of points, and the curve of density over depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators.kernel_sums import gauss_sums
from lamina.operators.nearest import nearest_distance, nearest_distances  # noqa: F401  part of this module's interface

BINS = 50
#: Layer bounds used where no peaks are found.
DEFAULT_LAYERS = (("L1", 0.0, 0.07), ("L2/3", 0.07, 0.35), ("L4", 0.35, 0.5), ("L5/6", 0.5, 1.0))


def bin_of(depth: Column) -> Column:
    """Bin of width 0.02, half-open but for the last; null outside 0..1 and for NaN."""
    rough = F.floor(depth * BINS)
    exact = F.when(depth < rough * F.lit(0.02), rough - 1).when(depth >= (rough + 1) * F.lit(0.02), rough + 1).otherwise(rough)
    return F.when((depth >= 0) & (depth <= 1) & ~F.isnan(depth), F.least(F.lit(BINS - 1), exact)).cast("int")


def curve(cells: DataFrame, middle: bool = False) -> DataFrame:
    """Mean (or median) density in 50 bins of depth per sample; empty bins are 0."""
    value = F.median("density") if middle else F.avg("density")
    have = cells.select("sample", bin_of(F.col("depth")).alias("bin"), "density").filter("bin is not null").groupBy("sample", "bin").agg(value.alias("density"))
    spine = cells.select("sample").distinct().select("sample", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return spine.join(have, ["sample", "bin"], "left").select("sample", "bin", ((F.col("bin") + 0.5) * 0.02).alias("center"), F.coalesce("density", F.lit(0.0)).alias("density"))


def curve_of_sums(parts: DataFrame) -> DataFrame:
    """curve() of cells that are summed already: sample, bin (null outside 0..1), total and n of their densities, in any number of parts."""
    have = parts.filter("bin is not null").groupBy("sample", "bin").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("density"))
    spine = parts.select("sample").distinct().select("sample", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return spine.join(have, ["sample", "bin"], "left").select("sample", "bin", ((F.col("bin") + 0.5) * 0.02).alias("center"), F.coalesce("density", F.lit(0.0)).alias("density"))


def smoothed(points: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Gaussian smoothing of a curve over its bins, cut at 4 sigma, mirrored at the ends with the end repeated."""
    reach = int(4 * sigma + 0.5)
    offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    rows = points.select("sample", "bin", "density", offset.alias("d")).withColumn("w", F.exp(-0.5 * F.col("d") * F.col("d") / (sigma * sigma)))
    to = F.col("bin") + F.col("d")
    # A bin sends its value to where it is seen from: inside, or mirrored at either end.
    seen = F.array_compact(F.array(F.when((to >= 0) & (to < BINS), to), F.when(-1 - F.col("bin") + F.col("d") >= 0, -1 - F.col("bin") + F.col("d")), F.when((2 * BINS - 1 - F.col("bin") + F.col("d") < BINS), 2 * BINS - 1 - F.col("bin") + F.col("d"))))
    return rows.select("sample", F.explode(seen).alias("bin"), "density", "w").groupBy("sample", "bin").agg((F.sum(F.col("density") * F.col("w")) / F.sum("w")).alias("smooth"))


def gradient(points: DataFrame, value: str, name: str, step: float = 0.02) -> DataFrame:
    """Central differences over the bins, one-sided at the ends."""
    w = Window.partitionBy("sample").orderBy("bin")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    slope = F.when(before.isNull(), (after - F.col(value)) / step).when(after.isNull(), (F.col(value) - before) / step).otherwise((after - before) / (2 * step))
    return points.withColumn(name, slope)


def crossings(points: DataFrame, value: str) -> DataFrame:
    """Depths at which a value changes sign, by linear interpolation."""
    w = Window.partitionBy("sample").orderBy("bin")
    now, after = F.col(value), F.lead(value).over(w)
    t = F.abs(now) / (F.abs(now) + F.abs("after") + 1e-8)
    return points.withColumn("after", after).filter(now * F.col("after") < 0).select("sample", "bin", ((F.col("bin") + 0.5) * 0.02 + t * 0.02).alias("depth"))


def peaks(points: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Local maxima of a curve per sample: bin (the middle one of a plateau, rounded down), height, prominence.

    A plateau at either end is no peak. The prominence is the height over the higher of the two lowest
    values met on the way to a higher bin, or to the end, on either side.
    """
    w = Window.partitionBy("sample").orderBy("bin")
    runs = points.withColumn("new", F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    flat = runs.groupBy("sample", "run").agg(F.min("bin").alias("from"), F.max("bin").alias("to"), F.first(value).alias("height"))
    by_run = Window.partitionBy("sample").orderBy("run")
    tops = flat.withColumns({"before": F.lag("height").over(by_run), "after": F.lead("height").over(by_run)}).filter("height > before and height > after")
    tops = tops.select("sample", F.floor((F.col("from") + F.col("to")) / 2).cast("int").alias("bin"), "height")
    other = points.select("sample", F.col("bin").alias("b"), F.col(value).alias("v"))
    met = tops.join(other, "sample")  # a curve has few bins, so a peak has few rows
    wall = met.groupBy("sample", "bin", "height").agg(F.coalesce(F.max(F.when((F.col("b") < F.col("bin")) & (F.col("v") > F.col("height")), F.col("b"))), F.lit(-1)).alias("l"), F.coalesce(F.min(F.when((F.col("b") > F.col("bin")) & (F.col("v") > F.col("height")), F.col("b"))), F.lit(bins)).alias("r"))
    low = wall.join(other, "sample").groupBy("sample", "bin", "height").agg(F.min(F.when((F.col("b") > F.col("l")) & (F.col("b") <= F.col("bin")), F.col("v"))).alias("left"), F.min(F.when((F.col("b") < F.col("r")) & (F.col("b") >= F.col("bin")), F.col("v"))).alias("right"))
    return low.select("sample", "bin", "height", (F.col("height") - F.greatest("left", "right")).alias("prominence"))


def _apart(found: Column, distance: Column) -> Column:
    """Of peaks (height, bin), highest first and of equal ones the later, those not nearer than `distance` to one kept before."""
    ranked = F.reverse(F.array_sort(found))
    none = F.filter(ranked, lambda p: F.lit(False))
    return F.aggregate(ranked, none, lambda kept, p: F.when(F.forall(kept, lambda q: F.abs(q["bin"] - p["bin"]) >= distance), F.concat(kept, F.array(p))).otherwise(kept))


def top_two_peaks(points: DataFrame, value: str, lowest: float = 0.05, highest: float = 0.8) -> DataFrame:
    """The two highest peaks per sample, upper and lower bin; samples with fewer have no row.

    Peaks are sought between two depths, at least max(3, a tenth of the bins) apart, and prominent by
    a tenth of the range of values there; where that leaves fewer than two, any prominence will do.
    """
    center = (F.col("bin") + 0.5) * 0.02
    inside = points.filter((center >= lowest) & (center <= highest))
    size = inside.groupBy("sample").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 10)).alias("distance"), (F.max(value) - F.min(value)).alias("range"))
    found = peaks(inside, value).groupBy("sample").agg(F.collect_list(F.struct("height", "bin", "prominence")).alias("found")).join(size, "sample")
    kept = found.withColumn("kept", _apart(F.col("found"), F.col("distance")))
    strong = F.filter("kept", lambda p: p["prominence"] >= F.col("range") * 0.1)
    chosen = kept.withColumn("kept", F.when(F.size(strong) >= 2, strong).otherwise(F.col("kept"))).filter(F.size("kept") >= 2)
    a, b = F.element_at("kept", 1)["bin"], F.element_at("kept", 2)["bin"]
    return chosen.select("sample", F.least(a, b).alias("upper"), F.greatest(a, b).alias("lower"))


def peak_bounds(points: DataFrame, value: str, turns: DataFrame) -> DataFrame:
    """Depths b0 to b5 that part five layers, from two peaks and the depths (sample, depth) where the curvature turns.

    The turn nearest above the upper peak, two between the peaks, and the nearest below the lower one;
    fixed fractions stand in for missing ones. Bounds that do not grow are set 0.02 after the one
    before. Samples without two peaks have no row.
    """
    at = lambda c: (F.col(c) + 0.5) * 0.02
    return bounds_between(top_two_peaks(points, value).select("sample", at("upper").alias("p"), at("lower").alias("q")), turns)


def bounds_between(two: DataFrame, turns: DataFrame) -> DataFrame:
    """peak_bounds() for samples whose two peaks lie at the depths p and q."""
    z = two.join(turns.groupBy("sample").agg(F.collect_list("depth").alias("z")), "sample", "left").withColumn("z", F.coalesce("z", F.array().cast("array<double>")))
    p, q, mid = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2
    nearest = lambda values, goal: F.array_min(F.transform(values, lambda x: F.struct(F.abs(x - goal).alias("off"), x.alias("x"))))["x"]
    z = z.withColumn("mids", F.filter("z", lambda x: (x > p) & (x < q)))
    z = z.withColumn("c2", F.coalesce(nearest(F.col("mids"), mid * 0.7), p + (q - p) * 0.33))
    rest = nearest(F.filter("mids", lambda x: x > F.col("c2")), mid * 1.3)
    z = z.withColumns({
        "c1": F.coalesce(F.array_max(F.filter("z", lambda x: x < p)), p * 0.5),
        "c3": F.when(F.size("mids") > 0, F.coalesce(rest, (F.col("c2") + q) / 2)).otherwise(p + (q - p) * 0.67),
        "c4": F.coalesce(F.array_min(F.filter("z", lambda x: x > q)), q + (1 - q) * 0.4),
        "c5": F.lit(1.0), "r0": F.lit(0.0),
    })
    for i in range(1, 6):
        z = z.withColumn(f"r{i}", F.when(F.col(f"c{i}") <= F.col(f"r{i - 1}"), F.col(f"r{i - 1}") + 0.02).otherwise(F.col(f"c{i}")))
    return z.select("sample", *[F.least(F.lit(1.0), F.col(f"r{i}")).alias(f"b{i}") for i in range(6)])


def layers_of(curve_points: DataFrame, layers=DEFAULT_LAYERS) -> DataFrame:
    """Mean density of each layer over the bins whose centres lie in it, both ends closed; 0 if none."""
    bounds = curve_points.sparkSession.createDataFrame(list(layers), "layer string, start double, end double")
    spine = curve_points.select("sample").distinct().join(F.broadcast(bounds))
    inside = curve_points.select(F.col("sample").alias("s"), "center", "density")
    joined = spine.join(inside, (F.col("sample") == F.col("s")) & (F.col("center") >= F.col("start")) & (F.col("center") <= F.col("end")), "left")
    return joined.groupBy("sample", "layer", "start", "end").agg(F.coalesce(F.avg("density"), F.lit(0.0)).alias("mean_density"))


def depth_layer(cells: DataFrame, layers=DEFAULT_LAYERS) -> DataFrame:
    """Cells per sample and layer by half-open depth ranges; depth 1 has no layer."""
    name = F.when(F.lit(False), "")
    for layer, start, end in layers:
        name = name.when((F.col("depth") >= start) & (F.col("depth") < end), layer)
    return cells.groupBy("sample", name.alias("layer")).agg(F.count("*").alias("n"), F.avg("depth").alias("mean_depth"))


def _grid(p: str, radius: float) -> list[Column]:
    return [F.floor(F.col(f"{p}{a}") / radius).cast("long").alias(f"g{a}") for a in "xy"]


def within_radius(points: DataFrame, radius: float) -> DataFrame:
    """How many points lie within the radius of each, itself included; candidates share a grid cell or touch it."""
    reach = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = points.select("id", "x", "y", *_grid("", radius)).select("id", "x", "y", "gx", "gy", reach.alias("o")).select("id", "x", "y", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    right = points.select(F.col("x").alias("x2"), F.col("y").alias("y2"), *_grid("", radius))
    near = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) <= radius * radius
    return left.join(right, ["gx", "gy"]).filter(near).groupBy("id").agg(F.count("*").alias("n"))


def kernel_density(points: DataFrame, bandwidth: str | float = "scott") -> DataFrame:
    """Gaussian density of each point over all of its sample, times the root of the count; 1 if alone.

    The bandwidth is scott or silverman (the same in two dimensions) or a factor of the standard deviation.
    Points are scaled so that the kernel is round and summed by moments of cells (kernel_sums.py), not
    by pairs. A sample's blocks are keys of their own, so that no task holds all its points. Points
    without a sample or a finite place have no row, nor have samples whose points lie on one line.
    """
    if isinstance(bandwidth, str) and bandwidth not in ("scott", "silverman"):
        raise ValueError("bandwidth must be scott, silverman or a number")
    placed = points.filter(F.col("sample").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    shape = placed.groupBy("sample").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"))
    h = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3)) if isinstance(bandwidth, str) else F.lit(float(bandwidth) ** 2)
    scaled = shape.select("sample", "n", "mx", "my", (F.col("sxx") * h).alias("a"), (F.col("syy") * h).alias("b"), (F.col("sxy") * h).alias("c"))
    scaled = scaled.withColumn("det", F.col("a") * F.col("b") - F.col("c") * F.col("c"))
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    flat = placed.join(scaled, "sample")
    many = flat.filter("n > 1 and a > 0 and det > 0").select(F.col("sample").alias("c"), "id", (x / F.sqrt("a")).alias("u"), ((y - F.col("c") / F.col("a") * x) / F.sqrt(F.col("det") / F.col("a"))).alias("v"))
    summed = gauss_sums(many, many.select("c", "u", "v")).withColumnRenamed("c", "sample").join(scaled, "sample")
    density = summed.select("id", (F.col("total") / (F.col("n") * 2 * F.pi() * F.sqrt("det")) * F.sqrt("n")).alias("density"))
    return density.union(flat.filter("n < 2").select("id", F.lit(1.0)))


def log_density(density: Column) -> Column:
    """Logarithm with a floor; -20 where nothing is there."""
    return F.when(density > 0, F.log(F.greatest(density, F.lit(1e-12)))).otherwise(-20.0)


def equal_bins(cells: DataFrame, bins: int) -> DataFrame:
    """Cells and mean density of each of so many equal bins of depth 0..1, the last one closed."""
    inside = cells.filter("depth >= 0 and depth <= 1")
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col("depth") * bins)).cast("int")
    return inside.groupBy("sample", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("density").alias("density"))


def search_range(points: DataFrame, low: float = 0.05, high: float = 0.8, least: int = 5) -> DataFrame:
    """Points of a curve between two depths; all of a sample where fewer than `least` are."""
    ok = F.col("center").between(low, high)
    have = F.count(F.when(ok, 1)).over(Window.partitionBy("sample"))
    return points.withColumn("_have", have).filter(ok | (F.col("_have") < least)).drop("_have")


#: Layer bounds where layers 2 and 3 are kept apart.
FIVE_LAYERS = (("L1", 0.0, 0.1), ("L2", 0.1, 0.3), ("L3", 0.3, 0.5), ("L4", 0.5, 0.7), ("L5/6", 0.7, 1.0))


def bounds_to_layers(bounds: DataFrame, merged: bool = True) -> DataFrame:
    """sample, layer, start and end from the bounds b0 to b5; merged layers 2 and 3 drop the bound between."""
    parts = [("L1", 0, 1), ("L2/3", 1, 3), ("L4", 3, 4), ("L5/6", 4, 5)] if merged else [("L1", 0, 1), ("L2", 1, 2), ("L3", 2, 3), ("L4", 3, 4), ("L5/6", 4, 5)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(f"b{i}").alias("start"), F.col(f"b{j}").alias("end")) for n, i, j in parts]))
    return bounds.select("sample", each.alias("l")).select("sample", "l.*")


def mean_density(layers: DataFrame, curve_points: DataFrame) -> DataFrame:
    """Adds mean_density: over the raw bins whose centres lie in the closed range; 0 if none. A curve has BINS rows a sample."""
    inside = curve_points.select(F.col("sample").alias("s"), "center", "density")
    on = (F.col("sample") == F.col("s")) & F.col("center").between(F.col("start"), F.col("end"))
    return layers.join(inside, on, "left").groupBy("sample", "layer", "start", "end").agg(F.coalesce(F.avg("density"), F.lit(0.0)).alias("mean_density"))
