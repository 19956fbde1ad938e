"""Ordered polylines: (contour_id, seq, x, y). Order is data, so every window is by contour and seq."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lamina.operators import restoration


def order() -> WindowSpec:
    return Window.partitionBy("contour_id").orderBy("seq")


def step_length() -> Column:
    """Distance from the point before; 0 for the first."""
    return F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order()), F.col("y") - F.lag("y").over(order())), F.lit(0.0))


def arc_length(points: DataFrame) -> DataFrame:
    """Cumulative length along each polyline."""
    return points.withColumn("step", step_length()).withColumn("arc", F.sum("step").over(order()))


def every_nth(points: DataFrame, n: int) -> DataFrame:
    return points.withColumn("rn", F.row_number().over(order()) - 1).filter(F.col("rn") % n == 0).drop("rn")


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """y of the points k before and after, clamped to the ends."""
    whole = order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumns({"y_left": F.coalesce(F.lag("y", k).over(order()), F.first("y").over(whole)), "y_right": F.coalesce(F.lead("y", k).over(order()), F.last("y").over(whole))})


def without_repeats(points: DataFrame, columns: list[str]) -> DataFrame:
    """Drops a point that equals the one before in the columns."""
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.lag(c).over(order()))
    return points.withColumn("_same", same & (F.row_number().over(order()) > 1)).filter(~F.col("_same")).drop("_same")


def _runs(points: DataFrame, starts: Column) -> DataFrame:
    return points.withColumn("_new", F.when(starts, 1).otherwise(0)).withColumn("run", F.sum("_new").over(order())).drop("_new")


def runs_by_class(points: DataFrame, label: str, least: int) -> DataFrame:
    """Maximal runs of one class with at least so many points: first and last seq, count."""
    begun = _runs(points, ~F.col(label).eqNullSafe(F.lag(label).over(order())) | (F.row_number().over(order()) == 1))
    return begun.groupBy("contour_id", "run", label).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("run")


def split_by_gap(points: DataFrame, max_gap: float, least: int = 2) -> DataFrame:
    """Parts of a polyline without a step over max_gap, of at least `least` points."""
    begun = _runs(points, step_length() > max_gap)
    return begun.groupBy("contour_id", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("run")


def dashes(points: DataFrame, dash: int, gap: int) -> DataFrame:
    return points.withColumn("rn", F.row_number().over(order()) - 1).filter(F.col("rn") % (dash + gap) < dash).drop("rn")


def densified(points: DataFrame) -> DataFrame:
    """About one point for each unit of length; shared vertices once, the last vertex kept; rounded half to even."""
    ends = points.withColumns({"x1": F.lead("x").over(order()), "y1": F.lead("y").over(order())})
    n = F.when(F.col("x1").isNull(), 1).otherwise(F.greatest(F.lit(2), F.ceil(F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))).cast("int")))
    rows = ends.withColumn("n", n).select("contour_id", "seq", "x", "y", "x1", "y1", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    at = lambda a: F.rint(F.when(F.col("x1").isNull(), F.col(a)).otherwise(F.col(a) + (F.col(f"{a}1") - F.col(a)) * F.col("k") / F.col("n"))).cast("long")
    return rows.select("contour_id", "seq", F.col("k").cast("long").alias("k"), at("x").alias("px"), at("y").alias("py"))


def chaikin(points: DataFrame) -> DataFrame:
    """One round of corner cutting, ends kept; part 0 is the first point, 1 and 2 the cut corners, 3 the last."""
    ends = points.withColumns({"x1": F.lead("x").over(order()), "y1": F.lead("y").over(order()), "first": F.row_number().over(order()) == 1})
    point = lambda part, x, y: F.struct(F.lit(part).alias("part"), x.alias("px"), y.alias("py"))
    x, y, x1, y1 = (F.col(c) for c in ("x", "y", "x1", "y1"))
    made = F.array_compact(F.array(F.when(F.col("first"), point(0, x, y)), F.when(x1.isNotNull(), point(1, x * 0.75 + x1 * 0.25, y * 0.75 + y1 * 0.25)), F.when(x1.isNotNull(), point(2, x * 0.25 + x1 * 0.75, y * 0.25 + y1 * 0.75)), F.when(x1.isNull(), point(3, x, y))))
    return ends.select("contour_id", "seq", F.explode(made).alias("p")).select("contour_id", "seq", "p.part", "p.px", "p.py")


def _around(column: str, reach: int) -> Column:
    """Values of the points up to `reach` places before and after, in order; fewer near the ends."""
    return F.collect_list(column).over(order().rowsBetween(-reach, reach))


def median_filtered(points: DataFrame, size: int = 11) -> DataFrame:
    """Median of y over an odd window, reflected at the ends; polylines of at most `size` points stay as they are."""
    reach = size // 2
    placed = points.withColumns({"i": F.row_number().over(order()) - 1, "n": F.count("*").over(Window.partitionBy("contour_id")), "ys": _around("y", reach)})
    left = F.greatest(F.lit(0), reach - F.col("i"))
    right = F.greatest(F.lit(0), F.col("i") + reach + 1 - F.col("n")).cast("int")
    # Beyond an end its neighbours are seen again, the end itself first: they are all in the window.
    seen = F.concat(F.slice("ys", F.lit(1), left), "ys", F.slice("ys", F.size("ys") - right + 1, right))
    middle = F.element_at(F.sort_array(seen), reach + 1)
    return placed.withColumn("y", F.when(F.col("n") > size, middle).otherwise(F.col("y"))).drop("i", "n", "ys")


def gauss_smoothed(points: DataFrame, sigma: float = 2.0, max_kernel: int = 15) -> DataFrame:
    """Gaussian mean of x and y over 3 sigma, ends repeated; the two ends and polylines under 3 points stay."""
    widest = max(3, max_kernel) if max(3, max_kernel) % 2 else max(3, max_kernel) - 1
    reach = min(max(1, round(sigma * 3)), widest // 2)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    seen = {f"{c}s": _around(c, reach) for c in "xy"}
    placed = points.withColumns({"i": F.row_number().over(order()) - 1, "n": F.count("*").over(Window.partitionBy("contour_id")), **seen})

    def mean(c: str) -> Column:
        values = F.col(f"{c}s")
        before = F.array_repeat(F.element_at(values, 1), F.greatest(F.lit(0), reach - F.col("i")))
        after = F.array_repeat(F.element_at(values, -1), F.greatest(F.lit(0), F.col("i") + reach + 1 - F.col("n")).cast("int"))
        weighed = F.zip_with(F.concat(before, values, after), F.array(*map(F.lit, weights)), lambda v, w: v * w)
        return F.aggregate(weighed, F.lit(0.0), lambda total, v: total + v) / sum(weights)

    inner = (F.col("n") >= 3) & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    return placed.withColumns({c: F.when(inner, mean(c)).otherwise(F.col(c)) for c in "xy"}).drop("i", "n", "xs", "ys")


def chaikin_rounds(points: DataFrame, rounds: int) -> DataFrame:
    """Corner cutting repeated: contour_id, seq, x and y, numbered anew from 0; polylines under 3 points stay.

    What all rounds leave of an edge depends on its ends and the point after, so points meet those two by one sort; the many
    points made are neither sorted nor shuffled.
    """
    whole, w = Window.partitionBy("contour_id"), order()
    next_ = {f"{c}{k}": F.lead(c, k).over(w) for k in (1, 2) for c in "xy"}
    placed = points.select("contour_id", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole), **next_})
    ids = points.schema["contour_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            i, n = b["i"].to_numpy().astype(np.int64), b["n"].to_numpy()
            value = lambda c: b[c].to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
            null = lambda c: b[c].is_null().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            # Two coordinates and, for each, a mark that is above 0 where a null took part.
            at = np.stack([np.stack([np.where(null(f"{c}{k}"), 0.0, value(f"{c}{k}")) for c in "xy"] + [null(f"{c}{k}") * 1.0 for c in "xy"], axis=1) for k in ("", 1, 2)], axis=1)
            for begins, ends in ((True, False), (False, False), (False, True)):
                mine = np.flatnonzero((i < n - 1) & ((i == 0) == begins) & ((i == n - 2) == ends))
                made = at[mine, :2] if ends else at[mine]
                for _ in range(rounds):
                    p, q = made[:, :-1], made[:, 1:]
                    cut = np.stack([p * 0.75 + q * 0.25, p * 0.25 + q * 0.75], axis=2).reshape(len(mine), -1, 4)
                    made = np.concatenate([made[:, :1]] * begins + [cut] + [made[:, -1:]] * ends, axis=1)
                grown = 1 << rounds
                many = made.shape[1] if ends else 2 * grown - 1 if begins else grown
                first = np.zeros(len(mine), np.int64) if begins else grown * i[mine] + grown - 1
                flat = made[:, :many].reshape(-1, 4)
                xy = [pa.array(flat[:, c], mask=flat[:, c + 2] > 0) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([b["contour_id"].take(pa.array(np.repeat(mine, many))), pa.array((first[:, None] + np.arange(many)).ravel()), *xy], names=["contour_id", "seq", "x", "y"])

    made = placed.filter("n >= 3").drop("seq").mapInArrow(run, f"contour_id {ids}, seq long, x double, y double")
    return made.unionByName(placed.filter("n < 3").select("contour_id", F.col("seq").cast("long").alias("seq"), "x", "y"))


def runs_within(points: DataFrame, ok: Column, least: int) -> DataFrame:
    """Points of the runs in which `ok` holds throughout, of at least `least` points: adds run (its first seq), place from 0 and size."""
    kept = points.withColumn("_island", F.row_number().over(order())).filter(ok)
    island = Window.partitionBy("contour_id", "_gap")
    kept = kept.withColumn("_gap", F.col("_island") - F.row_number().over(order()))
    made = kept.withColumns({"run": F.min("seq").over(island), "size": F.count("*").over(island), "place": F.row_number().over(island.orderBy("seq")) - 1})
    return made.filter(F.col("size") >= least).drop("_island", "_gap")


def length_and_area(points: DataFrame) -> DataFrame:
    """contour_id, points, length (open) and area (closed) of each polyline."""
    w = order()
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = lambda c: F.coalesce(F.lead(c).over(w), first(c))
    cross = F.col("x") * F.col("y1") - F.col("x1") * F.col("y")
    rows = points.withColumns({"step": step_length(), "x1": after("x"), "y1": after("y")})
    found = rows.groupBy("contour_id").agg(F.count("*").alias("points"), F.sum("step").alias("length"), F.sum(cross).alias("twice"))
    return found.select("contour_id", "points", "length", (F.abs("twice") / 2).alias("area"))


def distance_to_lines(points: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each point (keys, x, y) its distance to the nearest segment of the polyline with the same keys.

    `lines` has the keys, contour_id, seq, x and y. Points of keys without a segment have no row.
    """
    ends = lines.withColumns({"x1": F.lead("x").over(order()), "y1": F.lead("y").over(order())}).filter("x1 is not null")
    segments = ends.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "x1", "y1")])
    dx, dy = F.col("s_x1") - F.col("s_x"), F.col("s_y1") - F.col("s_y")
    along = ((F.col("x") - F.col("s_x")) * dx + (F.col("y") - F.col("s_y")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    away = F.hypot(F.col("x") - F.col("s_x") - t * dx, F.col("y") - F.col("s_y") - t * dy)
    return points.join(segments, keys).groupBy(*points.columns).agg(F.min(away).alias("distance"))


def signed_distances(points: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each point (keys, x, y) its distance to the closed contour with the same keys, above 0 inside and below 0 outside.

    Inside is what a line to the right leaves by an odd number of crossings. A contour's segments are cut into parts of
    256, so that one long contour is many groups; a point's parts meet as their least distance and crossings.
    """
    w = order()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    ends = lines.withColumns({"x1": after("x"), "y1": after("y"), "_part": F.floor(F.col("seq") / 256)})
    sides = [F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).alias(f"_{c}") for c in ("x", "y", "x1", "y1")]
    segments = ends.groupBy(*keys, "_part").agg(*sides)
    met = points.withColumn("_row", F.monotonically_increasing_id()).join(segments, keys)
    names = list(points.columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            values = [b[f"_{c}"] for c in ("x", "y", "x1", "y1")]
            size = pc.list_value_length(values[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
            x, y, x1, y1 = (v.flatten().to_numpy(zero_copy_only=False) for v in values)
            px, py = (np.repeat(b[c].to_numpy(zero_copy_only=False).astype(float), size) for c in "xy")
            if not len(size):
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                dx, dy = x1 - x, y1 - y
                along, square = (px - x) * dx + (py - y) * dy, dx * dx + dy * dy
                t = np.clip(np.where(square == 0, 0.0, along / square), 0.0, 1.0)
                away = np.hypot(px - x - t * dx, py - y - t * dy)
                over = ((y > py) != (y1 > py)) & ~np.isnan(y) & ~np.isnan(y1) & ~np.isnan(py)
                crossed = over & (px < x + (py - y) * dx / dy)
            least = np.fmin.reduceat(away, begin)
            count = np.add.reduceat(crossed.astype(np.int64), begin)
            kept = [b[c] for c in ("_row", *names)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(least, mask=np.isnan(least)), pa.array(count)], names=["_row", *names, "_d", "_n"])

    met = met.select("_row", *points.columns, "_x", "_y", "_x1", "_y1").mapInArrow(run, f"_row long, {kinds}, _d double, _n long")
    found = met.groupBy("_row", *points.columns).agg(F.min("_d").alias("_d"), F.sum("_n").alias("_n"))
    return found.select(*points.columns, F.when(F.col("_n") % 2 == 1, F.col("_d")).otherwise(-F.col("_d")).alias("distance"))


def resampled(points: DataFrame, step: float = 1.0, least: float = 1e-6) -> DataFrame:
    """restoration.resampled() for polylines whose seq may have gaps: they are numbered first, in one sorted pass."""
    return restoration.resampled(points.withColumn("seq", F.row_number().over(order()) - 1), step, least=least)


#: Scanlines of a band, and crossings that a task sorts.
BAND, ROWS = 64, 1 << 19


def polygon_rows(points: DataFrame) -> DataFrame:
    """contour_id, y, x_from and x_to: whole pixels of each row inside the closed polygons, both ends included.

    A pixel is inside if a line to its left crosses the border an odd number of times, or if it lies on the
    border's crossing itself; crossing borders are no obstacle. An edge makes a row for each scanline that it
    crosses (its lower end included, its upper one not), and the crossings of a scanline are paired in order; level edges count as rows of
    their own.
    """
    w = order()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    edges = points.select("contour_id", F.col("x").alias("xa"), F.col("y").alias("ya"), after("x").alias("xb"), after("y").alias("yb"))
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    lines = edges.withColumns({"lo": F.ceil(low), "hi": F.ceil(high) - 1}).filter("lo <= hi")
    # Edges go to their bands of scanlines before they are many rows, to as many tasks as these rows will need.
    rows = lines.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    many = max(points.sparkSession.sparkContext.defaultParallelism, int(rows // ROWS) + 1)
    lines = lines.withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / BAND), F.floor(F.col("hi") / BAND)))).repartition(many, "contour_id", "band")
    lines = lines.withColumn("row", F.explode(F.sequence(F.greatest("lo", F.col("band") * BAND), F.least("hi", F.col("band") * BAND + BAND - 1))))
    x = F.col("xa") + (F.col("row") - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    met = lines.select("contour_id", "band", F.col("row").alias("y"), x.alias("x"))
    line = Window.partitionBy("contour_id", "band", "y").orderBy("x")
    paired = met.withColumns({"to": F.lead("x").over(line), "rn": F.row_number().over(line)}).filter("rn % 2 = 1")
    level = edges.filter("ya = yb and ya = floor(ya)").select("contour_id", F.col("ya").cast("long").alias("y"), F.least("xa", "xb").alias("x"), F.greatest("xa", "xb").alias("to"))
    spans = paired.select("contour_id", "y", "x", "to").unionByName(level)
    return spans.select("contour_id", "y", F.ceil("x").alias("x_from"), F.floor("to").alias("x_to")).filter("x_from <= x_to")
