"""Features of cells and boundaries, and tables of models by sample."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators import density as D
from lamina.operators.kernel_sums import gauss_sums
from lamina.operators.staging import kept


def legacy_depth(cells: DataFrame, upper: DataFrame, lower: DataFrame) -> DataFrame:
    """id, dist_to_gm, dist_to_wm and depth (share of the way from the upper to the lower boundary) of each cell."""
    gm = D.nearest_distance(cells, upper, name="dist_to_gm")
    wm = D.nearest_distance(cells, lower, name="dist_to_wm")
    return gm.join(wm, "id").withColumn("depth", F.col("dist_to_gm") / (F.col("dist_to_gm") + F.col("dist_to_wm") + 1e-8))


def cell_features(cells: DataFrame, upper: DataFrame, lower: DataFrame, names: DataFrame, radius: float) -> DataFrame:
    """Depth, distances, density, neighbours within a radius, depth squared, depth times x and the annotated layer of each cell.

    `cells` has id, x and y; `names` (px, py, layer) is the annotation by pixel, '' where it has none.
    """
    placed = legacy_depth(cells, upper, lower)
    dense = D.kernel_density(cells.withColumn("sample", F.lit(0)))
    near = D.within_radius(cells, radius).withColumnRenamed("n", "neighbours")
    pixel = cells.select("id", "x", "y", F.rint(F.col("x") * 20).cast("int").alias("px"), F.rint(F.col("y") * 20).cast("int").alias("py"))
    named = pixel.join(names, ["px", "py"], "left").select("id", "x", F.coalesce("layer", F.lit("")).alias("layer"))
    whole = placed.join(dense, "id").join(near, "id").join(named, "id")
    return whole.select("id", "depth", "dist_to_gm", "dist_to_wm", "density", "neighbours", (F.col("depth") * F.col("depth")).alias("depth2"), (F.col("depth") * F.col("x")).alias("depth_x"), "layer")


REACH = 39.0  # deviations from which on a kernel is zero in double precision
THIN = 1e-13  # sums below it are told by nearest distances or pairs


def density_at(places: DataFrame, cells: DataFrame) -> DataFrame:
    """id and log density (floor -20) at places (id, x, y) of cells (x, y), with Scott's bandwidth over all cells."""
    near, far = _densities(places, cells)
    return near.union(far.select("id", F.lit(-20.0)))


def density_near(places: DataFrame, cells: DataFrame) -> DataFrame:
    """id and log density of those places near any cell, as in `density_at`; all others have the floor and no row here."""
    return _densities(places, cells)[0]


def _densities(places: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id and log density of the places near any cell, and the places that have the floor.

    Sums come from moments of grid cells (kernel_sums.py). Where hardly anything is near, the density is
    below the logarithm's own floor and only the nearest cell's distance tells whether the sum is zero in
    double precision; if the bandwidth is so small that it may be above, such places meet the cells
    within 39 deviations one by one. Without cells, or with all in line, the floor; so have null places.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    held = cells.filter(finite("x") & finite("y"))
    n, mx, my, a, b, c = held.agg(F.count("*"), F.avg("x"), F.avg("y"), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    h = n ** (-1 / 3) if n else 0.0
    a, b, c = (v * h if v is not None else 0.0 for v in (a, b, c))
    det = a * b - c * c
    if not (n > 1 and a > 0 and det > 0):
        return places.select("id", F.lit(-20.0).alias("log_density")).filter(F.lit(False)), places
    x, y = F.col("x") - mx, F.col("y") - my
    round_ = [(x / math.sqrt(a)).alias("u"), ((y - c / a * x) / math.sqrt(det / a)).alias("v")]
    norm = n * 2 * math.pi * math.sqrt(det)
    source = held.select(F.lit(0).alias("c"), *round_)
    box = source.agg(F.min("u"), F.max("u"), F.min("v"), F.max("v")).first()
    # Outside the cells' box by REACH the kernels are zero in double precision: such places have the floor and are not shuffled.
    close = F.col("u").between(box[0] - REACH, box[1] + REACH) & F.col("v").between(box[2] - REACH, box[3] + REACH)
    placed = places.select("id", F.when(finite("x") & finite("y"), F.struct(*round_)).alias("at")).select(F.lit(0).alias("c"), "id", "at.*").withColumn("close", F.coalesce(close, F.lit(False)))
    at, far = placed.filter("close").drop("close"), placed.filter("not close").select("id")
    sums = kept(gauss_sums(at, source).select("id", "total"), "sums")
    thin = sums.filter(F.col("total") < THIN).select("id")
    found = sums.filter(F.col("total") >= THIN)
    if not thin.isEmpty():
        left = at.join(thin, "id").select("id", F.col("u").alias("x"), F.col("v").alias("y"))
        goals = source.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if norm * 1e-12 > THIN:
            last = math.sqrt(2 * (745.13 - max(0.0, math.log(norm))))  # beyond it, kernel and density are zero
            far = D.nearest_distance(left, goals)
            rest = far.select("id", F.when(F.col("distance") <= last, THIN / 2).otherwise(0.0).alias("total"))
        else:
            rest = _sums_by_pairs(left, goals)
        found = found.union(rest)
    return found.select("id", D.log_density(F.col("total") / norm).alias("log_density")), far


def _sums_by_pairs(places: DataFrame, cells: DataFrame, reach: float = REACH) -> DataFrame:
    """id and total, the sum of kernels, of places (id, x, y) over the cells (x, y) of touching grid cells; beyond `reach` a kernel is zero."""
    grid = [F.floor(F.col(z) / reach).cast("long").alias(f"g{z}") for z in "xy"]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), *grid).select("*", around.alias("o"))
    right = right.select("x2", "y2", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    kernel = F.coalesce(F.exp(-0.5 * (dx * dx + dy * dy)), F.lit(0.0))
    return places.select("*", *grid).join(right, ["gx", "gy"], "left").groupBy("id").agg(F.sum(kernel).alias("total"))


#: Depth from which each inner boundary starts, in order of its index.
SEED_DEPTH = (("L1_2", 0.07), ("L3_4", 0.35), ("L4_5", 0.5))


def boundary_features(boundary: DataFrame, cells: DataFrame, width: float, height: float, radius: float, offset: float, least: int = 10) -> DataFrame:
    """The twelve features of each boundary point, as an array in fixed order, and the offset to the annotated line, beside x, y and y_gt.

    `boundary` has id, boundary, x, y and y_gt, `cells` has x and y. Boundaries with fewer than `least`
    points are left out.
    """
    w = Window.partitionBy("boundary").orderBy("x")
    index = F.coalesce(*[F.when(F.col("boundary") == n, i) for i, (n, _) in enumerate(SEED_DEPTH)])
    seed = F.coalesce(*[F.when(F.col("boundary") == n, d) for n, d in SEED_DEPTH])
    inner = boundary.filter(index.isNotNull())
    # A row of each boundary: its ends, which windows over whole boundaries would have to hold all rows for.
    ends = inner.groupBy("boundary").agg(F.min(F.struct("x", "y")).alias("first"), F.max(F.struct("x", "y")).alias("last"), F.count("*").alias("size")).filter(F.col("size") >= least)
    rows = inner.withColumns({"left": F.lag("y", 2).over(w), "right": F.lead("y", 2).over(w)}).join(F.broadcast(ends), "boundary")
    rows = rows.withColumns({"left": F.coalesce("left", "first.y"), "right": F.coalesce("right", "last.y")})
    places = inner.join(F.broadcast(ends.select("boundary")), "boundary", "left_semi").select(F.col("id").cast("string").alias("id"), "x", "y")
    shifts = F.explode(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.lit(dy).alias("dy")) for k, dy in enumerate((0.0, -offset, offset))]))
    moved = places.select("id", "x", "y", shifts.alias("s")).select(F.concat("s.k", "id").alias("id"), "x", (F.col("y") + F.col("s.dy")).alias("y"))
    found = density_near(moved, cells)
    wide = [F.max(F.when(F.substring("id", 1, 1) == str(k), F.col("log_density"))).alias(f"log_density{k}") for k in range(3)]
    # What is near any cell is kept as a table of its own, which may be small beside the rows.
    dense = kept(found.groupBy(F.expr("substring(id, 2)").alias("_text")).agg(*wide), "densities")
    near = kept(counts_within(places, cells, radius).withColumnRenamed("id", "_near"), "counts")
    text = F.col("id").cast("string")
    rows = rows.join(dense, text == F.col("_text"), "left").join(near, text == F.col("_near"), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in [("near", 0), *[(f"log_density{k}", -20.0) for k in range(3)]]})
    total = cells.count()
    features = [
        F.col("x") / width, F.col("y") / height, F.col("log_density0"), F.col("log_density1"), F.col("log_density2"), F.lit(0.0),
        F.col("near") / 500, F.col("left") / height, F.col("right") / height, seed, index / 2, F.lit(math.sqrt(total) / 200),
    ]
    return rows.select("id", "boundary", "x", "y", "y_gt", F.array(*features).alias("features"), (F.col("y_gt") - F.col("y")).alias("offset"))


def counts_within(places: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """id and near: cells (x, y) within the closed radius of each place (id, x, y); places whose grid cell no cell touches have no row."""
    grid = [F.floor(F.col(c) / radius).cast("long").alias(f"g{c}") for c in "xy"]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), *grid).select("*", around.alias("o"))
    right = right.select("x2", "y2", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    box = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None or box[2] is None:
        box = (0.0, 0.0, 0.0, 0.0)
    close = F.col("x").between(box[0] - radius, box[1] + radius) & F.col("y").between(box[2] - radius, box[3] + radius)
    met = places.filter(close).select("id", "x", "y", *grid).join(right, ["gx", "gy"])
    return met.groupBy("id").agg(F.count_if(dx * dx + dy * dy <= radius * radius).alias("near"))


def model_grid(models: list[tuple[str, float]], errors: DataFrame) -> DataFrame:
    """Mean error before and after each model (name, share of the offset that it takes away) per boundary, over samples.

    Every model meets every sample and boundary (sample, boundary, mae); the models are a handful of names.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(s).alias("share")) for n, s in models]))
    grid = errors.select("sample", "boundary", "mae", each.alias("m")).withColumn("after", F.col("mae") * (1 - F.col("m.share")))
    mean = grid.groupBy(F.col("m.model").alias("model"), "boundary").agg(F.avg("mae").alias("before"), F.avg("after").alias("after"), F.count("*").alias("samples"))
    return mean.withColumn("improvement", (F.col("before") - F.col("after")) / F.greatest("before", F.lit(1e-8)) * 100)
