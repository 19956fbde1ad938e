"""Harmonic depth: the Laplace field between two boundaries, solved tile by tile with exchanged halos and a coarse grid, and sampled at points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.boundaries import interpolated
from lamina.operators.staging import kept
from lamina.operators.tiles import own, tile_map

OUTSIDE, FREE, FIXED = 0, 1, 2
COARSE = 96  # nodes a side of the grid between rounds


def solved(state: np.ndarray, value: np.ndarray, tolerance: float = 1e-12, most: int = 20_000) -> np.ndarray:
    """The block with its free cells at the mean of their neighbours in the domain, what is fixed and the outermost ring as they are.

    Conjugate gradients on the five-point stencil; a cell without neighbours is 0.
    """
    free = state == FREE
    free[[0, -1]], free[:, [0, -1]] = False, False
    inside = (state != OUTSIDE).astype(float)
    around = lambda a: np.roll(a, 1, 0) + np.roll(a, -1, 0) + np.roll(a, 1, 1) + np.roll(a, -1, 1)
    degree = np.maximum(around(inside), 1.0)
    apply = lambda u: np.where(free, degree * u - around(u), 0.0)
    start = np.where(inside > 0, value, 0.0)
    u = np.where(free, start, 0.0)
    r = np.where(free, around(np.where(free, 0.0, start)), 0.0) - apply(u)
    z = r / degree
    p, rz = z, float((r * z).sum())
    goal = tolerance * tolerance * max(1.0, float(free.sum()))
    for _ in range(most):
        if rz <= goal:
            break
        ap = apply(p)
        step = rz / float((p * ap).sum())
        u, r = u + step * p, r - step * ap
        z = r / degree
        rz, before = float((r * z).sum()), rz
        p = z + rz / before * p
    return np.where(free, u, start)


def _corners(step: int) -> list[tuple[int, int, Column]]:
    """The four coarse nodes around a cell (x, y), as steps from (x // step, y // step), and the share each has in the cell's value."""
    share = lambda c, i: F.col(c) % step / F.lit(float(step)) if i else 1 - F.col(c) % step / F.lit(float(step))
    return [(i, j, share("x", i) * share("y", j)) for i in (0, 1) for j in (0, 1)]


def _coarse_matrix(cells: DataFrame, width: int, height: int, tile: int, step: int) -> DataFrame:
    """sample, i, j and a: the equations of free cells for fields that are bilinear between nodes `step` apart and 0 on fixed cells."""
    wide = width // step + 2
    nodes = wide * (height // step + 2)

    def run(x0: int, y0: int, state: np.ndarray) -> dict[str, np.ndarray]:
        y, x = np.mgrid[y0 : y0 + len(state), x0 : x0 + len(state)]
        fx, fy, free = x % step / step, y % step / step, state == FREE
        at = np.stack([(y // step + j) * wide + x // step + i for i in (0, 1) for j in (0, 1)], axis=-1)
        share = np.stack([(fx if i else 1 - fx) * (fy if j else 1 - fy) * free for i in (0, 1) for j in (0, 1)], axis=-1)
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for there in ((slice(1, -1), slice(2, None)), (slice(2, None), slice(1, -1))):
            here = (slice(1, -1), slice(1, -1))
            met = (state[here] != OUTSIDE) & (state[there] != OUTSIDE) & (free[here] | free[there])
            both = np.concatenate([at[here][met], at[there][met]], axis=1)
            less = np.concatenate([share[here][met], -share[there][met]], axis=1)
            value = less[:, :, None] * less[:, None, :]
            keys.append((both[:, :, None] * nodes + both[:, None, :])[value != 0])
            values.append(value[value != 0])
        key, to = np.unique(np.concatenate(keys), return_inverse=True)
        return {"i": key // nodes, "j": key % nodes, "a": np.bincount(to, np.concatenate(values), len(key))}

    return tile_map(cells, {"state": OUTSIDE}, run, {"i": "long", "j": "long", "a": "double"}, width, height, 1, tile, False).groupBy("sample", "i", "j").agg(F.sum("a").alias("a"))


def _coarse_solved(table: pa.Table) -> pa.Table:
    """Values at the coarse nodes of one sample by conjugate gradients; rows without j are the right-hand side."""
    j = table["j"].is_valid().to_numpy()
    i, a = table["i"].to_numpy(), table["a"].to_numpy()
    node, row = np.unique(i[j], return_inverse=True)
    column = np.searchsorted(node, table["j"].filter(pa.array(j)).to_numpy())
    a, b, rhs = a[j], np.zeros(len(node)), ~j
    known = np.isin(i[rhs], node)
    np.add.at(b, np.searchsorted(node, i[rhs][known]), table["a"].to_numpy()[rhs][known])
    scale = np.maximum(np.bincount(row, np.where(row == column, a, 0.0), len(node)), 1e-12)
    u, r = np.zeros(len(node)), b
    z = r / scale
    p, rz = z, float(r @ z)
    goal = rz * 1e-16
    for _ in range(20_000):
        if rz <= goal:
            break
        ap = np.bincount(row, a * p[column], len(node))
        step = rz / float(p @ ap)
        u, r = u + step * p, r - step * ap
        z = r / scale
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return pa.table({"sample": pa.repeat(table["sample"][0], len(node)), "node": node, "e": u})


def _corrected(now: DataFrame, matrix: DataFrame, width: int, height: int, tile: int, step: int) -> DataFrame:
    """The field plus the bilinear correction that its residual asks for; `was` is the value before.

    Tiles are solved, so a residual is left only where two tiles meet, and the cells on either side of that tell it.
    """
    wide = width // step + 2
    edge = lambda c, *at: (F.col(c) % tile).isin(*at)

    def run(x0: int, y0: int, state: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        around = lambda a: np.roll(a, 1, 0) + np.roll(a, -1, 0) + np.roll(a, 1, 1) + np.roll(a, -1, 1)
        inside = (state != OUTSIDE).astype(float)
        x, y, r = own(np.where(state == FREE, around(inside * value) - around(inside) * value, 0.0), x0, y0, 1, width, height)
        on = ((x % tile == 0) | (x % tile == tile - 1) | (y % tile == 0) | (y % tile == tile - 1)) & (r != 0)
        return {"x": x[on], "y": y[on], "r": r[on]}

    near = now.filter(edge("x", 0, 1, tile - 2, tile - 1) | edge("y", 0, 1, tile - 2, tile - 1))
    left = tile_map(near, {"state": OUTSIDE, "value": 0.0}, run, {"x": "int", "y": "int", "r": "double"}, width, height, 1, tile, False)
    qx, qy = (F.floor(F.col(c) / step).cast("long") for c in ("x", "y"))
    to = F.explode(F.array(*[F.struct(((qy + j) * wide + qx + i).alias("i"), (F.col("r") * share).alias("a")) for i, j, share in _corners(step)]))
    asked = left.select("sample", to.alias("to")).groupBy("sample", F.col("to.i").alias("i")).agg(F.sum("to.a").alias("a"))
    rows = matrix.unionByName(asked, allowMissingColumns=True)
    found = rows.groupBy("sample").applyInArrow(_coarse_solved, f"sample {now.schema['sample'].dataType.simpleString()}, node long, e double")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j, _ in _corners(step)]))
    of = lambda i, j: F.max(F.when((F.col("c.i") == i) & (F.col("c.j") == j), F.col("e"))).alias(f"e{i}{j}")
    four = found.select("sample", (F.col("node") % wide).alias("nx"), F.floor(F.col("node") / wide).alias("ny"), "e", corner.alias("c"))
    four = four.groupBy("sample", (F.col("nx") - F.col("c.i")).alias("qx"), (F.col("ny") - F.col("c.j")).alias("qy")).agg(*[of(i, j) for i, j, _ in _corners(step)])
    more = sum((share * F.coalesce(f"e{i}{j}", F.lit(0.0)) for i, j, share in _corners(step)), F.lit(0.0))
    met = now.withColumns({"qx": qx, "qy": qy}).join(four, ["sample", "qx", "qy"], "left")
    return met.select("sample", "x", "y", "state", F.when(F.col("state") == FREE, F.col("value") + more).otherwise(F.col("value")).alias("value"), F.col("value").alias("was"))


def laplace(cells: DataFrame, width: int, height: int, tile: int = 128, halo: int = 32, tolerance: float = 1e-9, max_rounds: int = 500) -> DataFrame:
    """sample, x, y, state and value: the field in which each free cell is the mean of its neighbours in the domain.

    `cells` has the domain's cells with state FREE or FIXED and a first value. A round solves each tile
    with its halo for the values around it, and takes the tile's own part; it is written to the shared folder,
    and rounds end when no value moves by more than the tolerance. Between rounds a grid of at most COARSE nodes
    a side, or four cells wide, solves for what is left over long ways, so rounds do not grow with the field.
    """
    def run(x0: int, y0: int, state: np.ndarray, value: np.ndarray, was: np.ndarray) -> dict[str, np.ndarray]:
        x, y, made = own(solved(state, value), x0, y0, halo, width, height)
        _, _, kind = own(state, x0, y0, halo, width, height)
        _, _, old = own(was, x0, y0, halo, width, height)
        on = kind != OUTSIDE
        return {"x": x[on], "y": y[on], "state": kind[on], "value": made[on], "moved": np.abs(made - old)[on]}

    now = kept(cells.select("sample", "x", "y", F.col("state").cast("long").alias("state"), F.col("value").cast("double").alias("value")), "field")
    step = max(4, -(-max(width, height) // COARSE))
    matrix = kept(_coarse_matrix(now, width, height, tile, step), "coarse")
    first = now.withColumn("was", F.col("value"))
    for _ in range(max_rounds):
        now = kept(tile_map(first, {"state": OUTSIDE, "value": 0.0, "was": 0.0}, run, {"x": "int", "y": "int", "state": "long", "value": "double", "moved": "double"}, width, height, halo, tile, False), "field")
        if (now.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return now.drop("moved")
        first = _corrected(now, matrix, width, height, tile, step)
    raise RuntimeError(f"the field did not settle in {max_rounds} rounds")


def grid(points: DataFrame, max_dim: int) -> DataFrame:
    """Per sample: x0, y0, the cell size (least whole one with at most max_dim of them along the longer side), and x1, y1."""
    box = points.groupBy("sample").agg(*[f(c).cast("long").alias(n) for f, c, n in ((F.floor, F.min("x"), "x0"), (F.floor, F.min("y"), "y0"), (F.ceil, F.max("x"), "x1"), (F.ceil, F.max("y"), "y1"))])
    longest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
    return box.withColumn("size", F.greatest(F.lit(1), F.ceil(longest / max_dim)).cast("long"))


def _place(index: Column, low: str, high: str) -> Column:
    """Coordinate of a grid line; the last one lies at the end of the box, however near to the one before."""
    return F.least(F.col(low) + index * F.col("size"), F.col(high))


def ribbon(pia: DataFrame, white: DataFrame, box: DataFrame) -> DataFrame:
    """Grid cells between two lines (sample, x, y): sample, x, y (indices), state and a first value that is linear in each column."""
    lines = box.withColumn("ix", F.explode(F.sequence(F.lit(0), F.ceil((F.col("x1") - F.col("x0")) / F.col("size")).cast("int")))).withColumn("x", _place(F.col("ix"), "x0", "x1").cast("double"))
    at = lambda points: interpolated(points.select("sample", F.col("x").cast("double").alias("x"), "y"), lines.select("sample", "x"), "sample")
    met = lines.join(at(pia).withColumnRenamed("y", "py"), ["sample", "x"]).join(at(white).withColumnRenamed("y", "wy"), ["sample", "x"]).filter("py is not null and wy is not null")
    last = F.ceil((F.col("y1") - F.col("y0")) / F.col("size"))
    share = lambda v: (v - F.col("y0")) / F.col("size")
    top, bottom = F.least("py", "wy"), F.greatest("py", "wy")
    lo, hi = F.ceil(share(top)), F.when(bottom >= F.col("y1"), last).otherwise(F.floor(share(bottom)))

    def nearest(v: str) -> Column:
        low = F.least(F.floor(share(F.col(v))), last)
        high = F.least(low + 1, last)
        return F.when(F.abs(_place(high, "y0", "y1") - F.col(v)) < F.abs(_place(low, "y0", "y1") - F.col(v)), high).otherwise(low).cast("int")

    columns = met.select("sample", "ix", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), nearest("py").alias("p"), nearest("wy").alias("w")).filter("lo <= hi")
    every = F.array_distinct(F.concat(F.sequence("lo", "hi"), F.array("p", "w")))
    made = columns.select("sample", F.col("ix").alias("x"), "p", "w", F.explode(every).alias("y"))
    # Where both lines fall on one cell, white matter is written last.
    state = F.when((F.col("y") == F.col("p")) | (F.col("y") == F.col("w")), FIXED).otherwise(FREE)
    value = F.when(F.col("y") == F.col("w"), 1.0).when(F.col("y") == F.col("p"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("y") - F.col("p")) / (F.col("w") - F.col("p")))))
    return made.select("sample", "x", "y", state.alias("state"), value.alias("value"))


def harmonic_field(pia: DataFrame, white: DataFrame, points: DataFrame, max_dim: int = 1024, **how) -> tuple[DataFrame, DataFrame]:
    """The grid's box and its solved field (sample, x, y, value), clipped and stretched to 0..1 in each sample."""
    box = kept(grid(points.select("sample", "x", "y").union(pia.select("sample", "x", "y")).union(white.select("sample", "x", "y")), max_dim), "box")
    field = laplace(ribbon(pia, white, box), max_dim + 2, max_dim + 2, **how).withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))))
    span = field.groupBy("sample").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    even = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    return box, field.join(span, "sample").select("sample", "x", "y", F.when(F.col("high") > F.col("low"), even).otherwise(F.col("value")).alias("value"))


def sampled(points: DataFrame, box: DataFrame, field: DataFrame) -> DataFrame:
    """Adds depth to each point (sample, x, y): the field between the four grid lines around it, null where one of them is outside.

    The field's cells are brought together by four first, which are as few as the grid; each point then meets its own four at once.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    spread = field.select("sample", "x", "y", "value", corner.alias("c"))
    one = lambda i, j: F.max(F.when((F.col("c.i") == i) & (F.col("c.j") == j), F.col("value"))).alias(f"v{i}{j}")
    four = spread.groupBy("sample", (F.col("x") - F.col("c.i")).alias("ix"), (F.col("y") - F.col("c.j")).alias("iy")).agg(F.count("*").alias("n"), *[one(i, j) for i in (0, 1) for j in (0, 1)])
    four = kept(four.filter("n = 4").drop("n"), "corners")
    low = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("size")), F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / F.col("size")) - 1)
    asked = points.join(box, "sample", "left").withColumns({"ix": F.greatest(low("x"), F.lit(0)).cast("int"), "iy": F.greatest(low("y"), F.lit(0)).cast("int")})
    part = lambda c: (F.col(c) - _place(F.col(f"i{c}"), f"{c}0", f"{c}1")) / (_place(F.col(f"i{c}") + 1, f"{c}0", f"{c}1") - _place(F.col(f"i{c}"), f"{c}0", f"{c}1"))
    asked = asked.withColumns({"fx": part("x"), "fy": part("y")}).select(*points.columns, "ix", "iy", "fx", "fy")
    share = lambda i, j: (F.col("fx") if i else 1 - F.col("fx")) * (F.col("fy") if j else 1 - F.col("fy"))
    depth = sum((F.col(f"v{i}{j}") * share(i, j) for i in (0, 1) for j in (0, 1)), F.lit(0.0))
    return asked.join(four, ["sample", "ix", "iy"], "left").select(*points.columns, depth.alias("depth"))
