"""Rasters in tiles: pixels of a tile and of a halo around it as NumPy blocks, labels merged across tile edges, filled holes.

A raster is a long table (sample, x, y and values). No group holds more than a tile with its halo,
so a large image is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.graph import components
from lamina.operators.staging import kept

TILE = 256
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _all_tiles(pixels: DataFrame, width: int, height: int, tile: int) -> DataFrame:
    """One row for each tile of the canvas of each sample that has a pixel."""
    steps = lambda size: F.sequence(F.lit(0), F.lit(-(-size // tile) - 1))
    rows = pixels.select("sample").distinct().withColumn("tile_r", F.explode(steps(height)))
    return rows.withColumn("tile_c", F.explode(steps(width)))


def tile_map(
    pixels: DataFrame,
    columns: dict[str, float],
    run: Callable[..., dict[str, np.ndarray]],
    out: dict[str, str],
    width: int,
    height: int,
    halo: int = 0,
    tile: int = TILE,
    every: bool = True,
) -> DataFrame:
    """sample and the columns `out` that `run` makes of each tile of a canvas of width x height.

    `run` gets x0 and y0 (the block's first column and row, halo included; below 0 at the canvas's edge), and for
    each of `columns` a block of (tile + 2 halo) squared with the pixels' values, its default elsewhere.
    Pixels off the canvas take no part. With `every`, tiles without pixels are run too.
    """
    on = pixels.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    lap = lambda c, size: F.sequence(F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / tile).cast("int"), F.floor(F.least(F.col(c) + halo, F.lit(size - 1)) / tile).cast("int"))
    rows = on.select("sample", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *columns)
    rows = rows.withColumn("tile_r", F.explode(lap("y", height))).withColumn("tile_c", F.explode(lap("x", width)))
    if every:
        rows = rows.unionByName(_all_tiles(on, width, height, tile), allowMissingColumns=True)
    return _run_tiles(rows, columns, run, out, width, height, halo, tile)


def _run_tiles(rows: DataFrame, columns: dict[str, float], run, out: dict[str, str], width: int, height: int, halo: int, tile: int) -> DataFrame:
    fields = [pa.field(k, _ARROW[t]) for k, t in out.items()]
    size = tile + 2 * halo

    def made(key: tuple, table: pa.Table) -> pa.Table:
        sample, r, c = key
        table = table.filter(table["x"].is_valid())
        x0, y0 = c.as_py() * tile - halo, r.as_py() * tile - halo
        ix, iy = table["x"].to_numpy() - x0, table["y"].to_numpy() - y0
        blocks = {}
        for name, default in columns.items():
            values = table[name].to_numpy(zero_copy_only=False)
            block = np.full((size, size), default, bool if isinstance(default, bool) else float if isinstance(default, float) else np.int64)
            block[iy, ix] = values
            blocks[name] = block
        found = run(x0=x0, y0=y0, **blocks)
        n = len(next(iter(found.values())))
        return pa.table([pa.array([sample.as_py()] * n, sample.type), *(pa.array(found[f.name], f.type) for f in fields)], names=["sample", *(f.name for f in fields)])

    kind = rows.schema["sample"].dataType.simpleString()
    return rows.groupBy("sample", "tile_r", "tile_c").applyInArrow(made, f"sample {kind}, " + ", ".join(f"{k} {t}" for k, t in out.items()))


def own(block: np.ndarray, x0: int, y0: int, halo: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and values of the tile itself within the canvas, flat."""
    size = len(block) - 2 * halo
    w, h = min(size, width - x0 - halo), min(size, height - y0 - halo)
    y, x = np.mgrid[y0 + halo : y0 + halo + h, x0 + halo : x0 + halo + w]
    return x.ravel(), y.ravel(), block[halo : halo + h, halo : halo + w].ravel()


def on_canvas(shape: tuple[int, int], x0: int, y0: int, width: int, height: int) -> np.ndarray:
    y, x = np.arange(y0, y0 + shape[0]), np.arange(x0, x0 + shape[1])
    return ((y >= 0) & (y < height))[:, None] & ((x >= 0) & (x < width))[None]


def reflected(block: np.ndarray, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """The block with what lies off the canvas mirrored about the edge pixels, as far as the block holds their images."""
    def index(start: int, many: int, size: int) -> np.ndarray:
        at = np.arange(start, start + many)
        at = np.where(at < 0, -at, at)
        at = np.where(at >= size, 2 * (size - 1) - at, at)
        return np.clip(np.clip(at, 0, size - 1) - start, 0, many - 1)

    return block[np.ix_(index(y0, block.shape[0], height), index(x0, block.shape[1], width))]


# ---------------------------------------------------------------- labels


def labels(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Least flat index of the component of each pixel of a small mask, -1 outside; by runs of rows, joined until nothing changes."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    step = np.diff(flat, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    out = np.full((h, w), -1, np.int64)
    if not len(row):
        return out
    reach = 1 if diagonal else 0
    wide = w + 4
    first = np.searchsorted(row * wide + end, (row - 1) * wide + start - reach, side="right")
    last = np.searchsorted(row * wide + start, (row - 1) * wide + end + reach, side="left")
    many = np.maximum(0, last - first)
    down = np.repeat(np.arange(len(row)), many)
    up = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    root = np.arange(len(row))
    while True:
        a, b = root[up], root[down]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    lengths = end - start
    at = np.repeat(row * w + start, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out.ravel()[at] = np.repeat((row * w + start)[root], lengths)
    return out


def mask_components(mask: DataFrame, width: int, height: int = 1 << 30, tile: int = TILE) -> DataFrame:
    """sample, x, y and component (least y * width + x) of a mask's pixels; pixels that touch at a side or corner belong together.

    Each tile labels its own pixels; only labels that meet across tile edges go to the graph search.
    """

    def run(x0: int, y0: int, on: np.ndarray) -> dict[str, np.ndarray]:
        found = labels(on, True)
        y, x = np.nonzero(on)
        at = found[y, x]
        return {"x": x + x0, "y": y + y0, "local": (at // tile + y0) * width + at % tile + x0}

    part = kept(tile_map(mask.select("sample", "x", "y", F.lit(True).alias("on")), {"on": False}, run, {"x": "int", "y": "int", "local": "long"}, width, height, 0, tile, False), "labels")
    return part.select("sample", "x", "y", F.col("local")).join(_merged(part, tile, True), ["sample", "local"], "left").select("sample", "x", "y", F.coalesce("component", "local").alias("component"))


def _merged(part: DataFrame, tile: int, diagonal: bool) -> DataFrame:
    """sample, local and component (least local) of the labels that meet another one across a tile edge."""
    edge = part.filter((F.pmod("x", F.lit(tile)).isin(0, tile - 1)) | F.pmod("y", F.lit(tile)).isin(0, tile - 1))
    steps = ((1, 0), (0, 1), (1, 1), (-1, 1)) if diagonal else ((1, 0), (0, 1))
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    to = edge.select("sample", F.col("local").alias("a"), "x", "y", F.explode(ahead).alias("o")).select("sample", "a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    met = to.join(edge.select("sample", "x", "y", F.col("local").alias("b")), ["sample", "x", "y"]).filter("a != b")
    node = lambda c: F.struct("sample", F.col(c).alias("at"))
    found = components(met.select(node("a").alias("u"), node("b").alias("v")).distinct())
    return found.select(F.col("node.sample").alias("sample"), F.col("node.at").alias("local"), F.col("component.at").alias("component"))


def filled_holes(mask: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """sample, x and y of a mask with its holes: background pixels that no path over sides leads from to the canvas's edge.

    Tiles label their background twice: first to find, by labels at tile edges alone, which
    ones are shut in; then to fill those.
    """
    canvas = lambda shape, x0, y0: on_canvas(shape, x0, y0, width, height)

    def rims(x0: int, y0: int, on: np.ndarray) -> dict[str, np.ndarray]:
        free = ~on & canvas(on.shape, x0, y0)
        found = labels(free, False)
        rim = np.zeros_like(on)
        rim[[0, -1]], rim[:, [0, -1]] = True, True
        y, x = np.nonzero(free & rim | free & ~canvas(on.shape, x0 - 1, y0 - 1) | free & ~canvas(on.shape, x0 + 1, y0 + 1))
        at = found[y, x]
        px, py = x + x0, y + y0
        return {"x": px, "y": py, "local": (at // tile + y0) * width + at % tile + x0, "open": (px == 0) | (py == 0) | (px == width - 1) | (py == height - 1)}

    pixels = kept(mask.select("sample", "x", "y"), "mask").withColumn("on", F.lit(True))
    rim = kept(tile_map(pixels, {"on": False}, rims, {"x": "int", "y": "int", "local": "long", "open": "boolean"}, width, height, 0, tile), "rims")
    merged = rim.groupBy("sample", "local").agg(F.max("open").alias("open")).join(_merged(rim, tile, False), ["sample", "local"], "left").withColumn("component", F.coalesce("component", "local"))
    shut = merged.groupBy("sample", "component").agg(F.max("open").alias("out")).filter("not out")
    holes = merged.join(shut, ["sample", "component"], "left_semi")
    marks = holes.select("sample", (F.col("local") % width).cast("int").alias("x"), F.floor(F.col("local") / width).cast("int").alias("y"), F.lit(False).alias("on"), F.lit(True).alias("hole"))

    def fill(x0: int, y0: int, on: np.ndarray, hole: np.ndarray) -> dict[str, np.ndarray]:
        free = ~on & canvas(on.shape, x0, y0)
        found = labels(free, False)
        shut = np.zeros(on.size + 1, bool)
        shut[:-1] = True
        edge = np.concatenate([found[[0, -1]].ravel(), found[:, [0, -1]].ravel(), found[free & (~canvas(on.shape, x0 - 1, y0 - 1) | ~canvas(on.shape, x0 + 1, y0 + 1))]])
        shut[edge] = False
        shut[np.flatnonzero(hole)] = True
        y, x = np.nonzero(on | free & shut[found])
        return {"x": x + x0, "y": y + y0}

    rows = pixels.withColumn("hole", F.lit(False)).unionByName(marks)
    return tile_map(rows, {"on": False, "hole": False}, fill, {"x": "int", "y": "int"}, width, height, 0, tile)
