"""Nearest distances by descending two grids together, with bounds that prune pairs of cells, and then cell by cell in Arrow."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators.staging import kept

LEAF = 16  # targets of a cell that is not split any more
MOST = 1 << 16  # points, and targets, that a group takes at once
PAIRS = 1 << 15  # points times targets that are compared without another split
LEVELS = 24  # cells are 4^24 times smaller than the whole at most, near the end of double precision
CELLS = 200_000  # cells up to which their table is sent to all tasks


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(c) < float("inf"))


def _box(p: str) -> list[Column]:
    return [F.min("x").alias(f"{p}x0"), F.max("x").alias(f"{p}x1"), F.min("y").alias(f"{p}y0"), F.max("y").alias(f"{p}y1")]


def _least(a: str, b: str) -> Column:
    """Distance between the boxes a and b, 0 where they meet."""
    gap = [F.greatest(F.lit(0.0), F.col(f"{b}{z}0") - F.col(f"{a}{z}1"), F.col(f"{a}{z}0") - F.col(f"{b}{z}1")) for z in "xy"]
    return F.hypot(*gap)


def _greatest(a: str, b: str) -> Column:
    """Greatest distance between places of the boxes a and b."""
    far = [F.greatest(F.col(f"{b}{z}1") - F.col(f"{a}{z}0"), F.col(f"{a}{z}1") - F.col(f"{b}{z}0")) for z in "xy"]
    return F.hypot(*far)


def closest(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """Index of the nearest target of each point. Points are halved across their longer side; a half leaves the targets beyond its bound."""
    out = np.empty(len(x), np.int64)
    # A power of two changes no digit, and squares of what is left neither overflow nor vanish.
    wide = max(max(x.max(), tx.max()) - min(x.min(), tx.min()), max(y.max(), ty.max()) - min(y.min(), ty.min()))
    x, y, tx, ty = (np.ldexp(v, -int(np.frexp(wide)[1])) for v in (x, y, tx, ty))
    todo = [(np.arange(len(x)), np.arange(len(tx)))]
    while todo:
        own, goal = todo.pop()
        px, py, gx, gy = x[own], y[own], tx[goal], ty[goal]
        if len(own) > 1 and len(own) * len(goal) > PAIRS:
            x0, x1, y0, y1 = px.min(), px.max(), py.min(), py.max()
            far = np.maximum(gx - x0, x1 - gx) ** 2 + np.maximum(gy - y0, y1 - gy) ** 2
            gap = np.maximum(np.maximum(x0 - gx, gx - x1), 0) ** 2 + np.maximum(np.maximum(y0 - gy, gy - y1), 0) ** 2
            on = gap <= far.min() * (1 + 1e-9)
            goal, gx, gy = goal[on], gx[on], gy[on]
            if len(own) * len(goal) > PAIRS:
                half = np.argpartition(px if x1 - x0 >= y1 - y0 else py, len(own) // 2)
                todo += [(own[half[: len(own) // 2]], goal), (own[half[len(own) // 2 :]], goal)]
                continue
        out[own] = goal[((px[:, None] - gx) ** 2 + (py[:, None] - gy) ** 2).argmin(axis=1)]
    return out


def nearest_distances(points: DataFrame, targets: dict[str, DataFrame], cell: float | None = None) -> DataFrame:
    """Adds to each point (x, y and other columns) its exact distance to the nearest of each table of targets (x, y), by the table's name.

    Points and targets share a grid whose cells are halved twice a level. A pair of cells is left if the
    boxes around their rows are farther apart than some other target cell's farthest place is from the
    point cell; cells whose points or targets do not fit a group are split, until target cells hold few or are
    at most `cell` wide. Then each point goes to the group of its cell, once, with all targets that its
    cell has left; equal hashes of two cells only bring more targets together. Only cells equally far from very many targets,
    as a circle's centre, take several groups, of which the least distance counts. The rows of points must differ, and are read
    once a level; x and y come back as double. Equal targets count once. Null and non-finite targets take no part, and such points
    get null, as all do without targets.
    """
    names, more = list(targets), [c for c in points.columns if c not in ("x", "y")]
    points = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *more)
    without = lambda rows: rows.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    fine = _finite("x") & _finite("y")
    left, odd = points.filter(fine), without(points.filter(~fine))
    each = [t.filter(fine).select(F.lit(k).alias("kind"), F.col("x").cast("double"), F.col("y").cast("double")) for k, t in enumerate(targets.values())]
    goals = kept(reduce(DataFrame.union, each).distinct(), "targets")
    t = goals.agg(F.count("*").alias("n"), *_box("")).first()
    p = left.agg(F.count("*").alias("n"), *_box("")).first()
    if not t.n or not p.n:
        return without(points)
    x0, y0 = min(t.x0, p.x0), min(t.y0, p.y0)
    side = max(max(t.x1, p.x1) - x0, max(t.y1, p.y1) - y0) or 1.0

    def keys(level: int, to: str) -> list[Column]:
        at = [F.floor((F.col(z) - start) / side * 4**level).cast("long") for z, start in (("x", x0), ("y", y0))]
        return [F.least(k, F.lit(4**level - 1)).alias(f"{to}{z}") for k, z in zip(at, "xy")]

    def parent(p: str) -> list[Column]:
        return [F.shiftright(f"{p}{z}", 2).alias(f"_{p}{z}") for z in "xy"]

    pairs, done, slack, several = None, [], 1 + 1e-9, False
    for level in range(1, LEVELS + 1):
        ours = left.groupBy(*keys(level, "p")).agg(F.count("*").alias("own"), *_box("a"))
        theirs = goals.groupBy("kind", *keys(level, "t")).agg(F.count("*").alias("n"), *_box("b"))
        if pairs is None:  # sixteen cells at most on either side
            met = ours.withColumn("_", F.lit(0)).join(theirs.withColumn("_", F.lit(0)), "_").withColumn("best", F.lit(float("inf")))
        else:
            met = pairs.join(ours.select("*", *parent("p")), ["_px", "_py"]).join(theirs.select("*", *parent("t")), ["kind", "_tx", "_ty"])
        of_ours = Window.partitionBy("px", "py")
        bound = met.repartition("px", "py").withColumn("best", F.min(F.least("best", _greatest("a", "b"))).over(Window.partitionBy("px", "py", "kind")))
        near = bound.filter(_least("a", "b") <= F.col("best") * slack).withColumns({"all": F.sum("n").over(of_ours), "top": F.max("n").over(of_ours)})
        last = level == LEVELS or (cell is not None and side / 4**level <= cell)
        one = (F.col("own") <= MOST) | ((F.col("ax0") == F.col("ax1")) & (F.col("ay0") == F.col("ay1")))
        near = near.withColumn("whole", (one & ((F.col("all") <= MOST) | (F.col("top") <= LEAF))) | F.lit(last))
        near = kept(near.select("px", "py", "kind", "tx", "ty", "best", "own", "all", "whole"), "pairs")
        seen = near.groupBy("whole").agg(F.count_distinct("px", "py").alias("cells"), F.max("all").alias("most")).collect()
        for row in seen:
            if row.whole:
                done.append((level, near.filter("whole").drop("whole", "best"), row.cells))
                several |= row.most > MOST
        if all(row.whole for row in seen):
            break
        pairs = near.filter("not whole").select(*[F.col(f"{c}{z}").alias(f"_{c}{z}") for c in "pt" for z in "xy"], "kind", "best")

    parts = lambda c: F.ceil(F.col(c) / MOST).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    some = lambda c, *of: F.when(F.col(c) > MOST, F.pmod(F.xxhash64(*of), parts(c))).otherwise(F.lit(0)).cast("int")
    rows = []
    for level, ready, cells in done:
        key = F.hash(F.lit(level), "px", "py", "i", "j").alias("key")
        places = ready.select("px", "py", "own", "all").distinct()
        places = F.broadcast(places) if cells <= CELLS else places
        mine = left.select("*", *keys(level, "p")).join(places, ["px", "py"])
        mine = mine.withColumn("i", some("own", "x", "y", *more)).withColumn("j", every("all"))
        rows.append(mine.select(key, F.lit(-1).alias("kind"), "x", "y", *more))
        theirs = goals.select("kind", "x", "y", *keys(level, "t")).join(ready, ["kind", "tx", "ty"])
        theirs = theirs.withColumn("j", some("all", "x", "y")).withColumn("i", every("own"))
        rows.append(theirs.select(key, "kind", "x", "y"))

    def measured(table: pa.Table) -> pa.Table:
        kind, x, y = (table[c].to_numpy() for c in ("kind", "x", "y"))
        own = np.flatnonzero(kind < 0)
        found, away = table.select(["x", "y", *more]).take(pa.array(own)), []
        for k in range(len(names)):
            goal = np.flatnonzero(kind == k)
            if not len(own) or not len(goal):
                away.append(pa.nulls(len(own), pa.float64()))
                continue
            at = goal[closest(x[own], y[own], x[goal], y[goal])]
            away.append(pa.array(np.hypot(x[own] - x[at], y[own] - y[at])))
        return pa.table([*found.columns, *away], names=[*found.column_names, *names])

    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    out = together.groupBy("key").applyInArrow(measured, without(left).schema)
    if several:
        out = out.groupBy(*points.columns).agg(*[F.min(n).alias(n) for n in names])
    return out.unionByName(odd)


def nearest_distance(points: DataFrame, targets: DataFrame, cell: float | None = None, name: str = "distance") -> DataFrame:
    """Exact distance of each point (id, x, y) to the nearest target (x, y), see nearest_distances; no rows if there are no targets, nor for null and non-finite places."""
    left = kept(points.select("id", "x", "y"), "points")
    return nearest_distances(left, {"_d": targets}, cell).filter("_d is not null").groupBy("id").agg(F.min("_d").alias(name))
