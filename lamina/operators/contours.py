"""Contours of masks by list ranking: the sides of border pixels are a linked list, ordered by pointer doubling.

Each side of a mask pixel that faces the background has one successor, with the mask on its left. A tile
follows its own sides to where they leave it; what is left is a list of such stretches, and each round of
joins doubles how far one of them sees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators.staging import kept
from lamina.operators.tiles import TILE, filled_holes, tile_map

#: Sides west, south, east and north: the way out of the pixel (x, y); the way along it is that of the next side.
_OUT = ((-1, 0), (0, 1), (1, 0), (0, -1))


def _sides(on: np.ndarray) -> tuple[np.ndarray, ...]:
    """y, x and side of all sides that face the background in the inner part of a block with a halo of 1, y, x and side of the
    successor of each, and the distance from the pixel that the border comes from: 0 if it was in this one before."""
    inner = np.zeros_like(on)
    inner[1:-1, 1:-1] = on[1:-1, 1:-1]
    parts = []
    for side, (ox, oy) in enumerate(_OUT):
        tx, ty = _OUT[(side + 1) % 4]
        y, x = np.nonzero(inner & ~np.roll(on, (-oy, -ox), (0, 1)))
        ahead, across = on[y + ty, x + tx], on[y + oy + ty, x + ox + tx]
        ny = np.where(across, y + oy + ty, np.where(ahead, y + ty, y))
        nx = np.where(across, x + ox + tx, np.where(ahead, x + tx, x))
        turn = np.where(across, (side + 3) % 4, np.where(ahead, side, (side + 1) % 4))
        step = np.where(on[y + oy - ty, x + ox - tx], np.sqrt(2.0), np.where(on[y - ty, x - tx], 1.0, 0.0))
        parts.append((y, x, np.full(len(y), side), ny, nx, turn, step))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _stretches(node: np.ndarray, after: np.ndarray) -> dict[str, np.ndarray]:
    """For each node of lists that may leave the set: the first node of its stretch (the least one of a loop), its place there, and on first nodes the rest."""
    order = np.argsort(node)
    node, after = node[order], after[order]
    n = len(node)
    at = np.minimum(np.searchsorted(node, after), max(n - 1, 0))
    here = node[at] == after if n else np.zeros(0, bool)
    before = np.full(n, -1)
    before[at[here]] = np.flatnonzero(here)
    # Backwards: how far the first node is and the least node on the way, by doubling.
    jump = np.where(before >= 0, before, np.arange(n))
    steps, low, low_at = (before >= 0).astype(np.int64), np.minimum(np.arange(n), jump), np.where(jump < np.arange(n), 1, 0)
    for _ in range(max(1, int(n).bit_length())):
        better = low[jump] < low
        low_at = np.where(better, steps + low_at[jump], low_at)
        low = np.minimum(low, low[jump])
        steps, jump = steps + steps[jump], jump[jump]
    closed = before[jump] >= 0
    first = np.where(closed, low, jump)
    place = np.where(closed, low_at, steps)
    length = np.bincount(first, minlength=n)
    last = np.flatnonzero(~here)
    goes = np.zeros(n, np.int64)
    goes[first[last]] = after[last]
    least, least_at = np.full(n, n), np.zeros(n, np.int64)
    np.minimum.at(least, first, np.arange(n))
    least_at[first] = place[least[first]]
    head = first == np.arange(n)
    back = np.argsort(order)
    out = {
        "path": node[first], "place": place, "head": head, "length": length,
        "next": np.where(closed, node, goes), "low": node[np.minimum(least, max(n - 1, 0))] if n else node, "low_at": least_at,
    }
    return {k: v[back] for k, v in out.items()}


def _traced(mask: DataFrame, width: int, height: int, tile: int) -> DataFrame:
    def run(x0: int, y0: int, on: np.ndarray) -> dict[str, np.ndarray]:
        y, x, side, ny, nx, turn, step = _sides(on)
        node = ((y + y0) * width + x + x0) * 4 + side
        found = _stretches(node, ((ny + y0) * width + nx + x0) * 4 + turn)
        near = sum(on[y + dy, x + dx].astype(int) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        fresh = (step > 0) | (near == 1) & (side == 0)
        return {"node": node, "x": x + x0, "y": y + y0, "fresh": fresh, "step": step, **{k: found[k] for k in ("path", "place", "head", "length", "next", "low", "low_at")}}

    kinds = {"node": "long", "x": "int", "y": "int", "fresh": "boolean", "step": "double", "path": "long", "place": "long", "head": "boolean", "length": "long", "next": "long", "low": "long", "low_at": "long"}
    return kept(tile_map(mask.select("sample", "x", "y", F.lit(True).alias("on")), {"on": False}, run, kinds, width, height, 1, tile, False), "sides")


def _ranked(paths: DataFrame) -> DataFrame:
    """sample, path, loop (least node of its loop) and lead (steps from the path's start to it) of the stretches, by pointer doubling.

    A round joins each stretch with the one it points to; when no least node changes, every loop is seen whole.
    """
    now = kept(paths.select("sample", "path", "next", "low", F.col("low_at").alias("lead"), F.col("length").alias("span")), "ranks")
    while True:
        ahead = now.select("sample", F.col("path").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"), F.col("lead").alias("lead2"), F.col("span").alias("span2"))
        met = now.join(ahead, ["sample", "next"])
        less = F.col("low2") < F.col("low")
        # Spans of loops seen several times over are kept small; their leads are final by then.
        made = met.select("sample", "path", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), F.when(less, F.col("span") + F.col("lead2")).otherwise(F.col("lead")).alias("lead"), F.least(F.col("span") + F.col("span2"), F.lit(1 << 60)).alias("span"), less.alias("changed"))
        now = kept(made, "ranks")
        if not now.agg(F.max("changed")).first()[0]:
            return now.select("sample", "path", F.col("low").alias("loop"), "lead")


def contours(mask: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """Pixels of the borders of a mask (sample, x, y) in order: sample, loop, outer, seq, x, y and step.

    Pixels that touch at a corner belong together. A loop starts at its first pixel by rows and goes down
    first; a pixel comes up as often as the border passes it. loop is the number of the first side, outer tells
    borders from those of holes, step is the distance from the pixel before (of the first one: from the last; 0 for one alone).
    """
    nodes = _traced(mask, width, height, tile)
    paths = nodes.filter("head")
    ranks = _ranked(paths)
    loops = kept(paths.select("sample", "path", "length").join(ranks, ["sample", "path"]), "loops")
    sizes = loops.groupBy("sample", "loop").agg(F.sum("length").alias("total"))
    placed = nodes.filter("fresh").join(loops.select("sample", "path", "loop", "lead"), ["sample", "path"]).join(sizes, ["sample", "loop"])
    rank = F.pmod(F.col("place") - F.col("lead"), F.col("total"))
    # The first pixel may have been entered by a side before the loop's first one: then its rank is among the last.
    placed = placed.withColumn("rank", rank).withColumn("stretch", F.floor(F.col("rank") / (1 << 16)))
    counts = placed.groupBy("sample", "loop", "stretch").agg(F.count("*").alias("many"), F.min("rank").alias("least"))
    by_loop = Window.partitionBy("sample", "loop")
    heads = counts.select("sample", "loop", "stretch", F.coalesce(F.sum("many").over(by_loop.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("many").over(by_loop).alias("all"), F.min("least").over(by_loop).alias("least"))
    met = placed.join(heads, ["sample", "loop", "stretch"])
    index = F.row_number().over(Window.partitionBy("sample", "loop", "stretch").orderBy("rank")) - 1 + F.col("before")
    turned = F.when(F.col("least") > 0, 1).otherwise(0)
    return met.select("sample", "loop", (F.col("loop") % 4 == 0).alias("outer"), F.pmod(index + turned, F.col("all")).alias("seq"), "x", "y", "step")


def outer_contours(mask: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """The outer borders of a mask; those of parts that lie in a hole of another one are left out."""
    return contours(filled_holes(mask, width, height, tile), width, height, tile).filter("outer")


def longest(loops: DataFrame) -> DataFrame:
    """The loop of each sample whose open length is greatest, of equal ones the first: its rows of contours()."""
    sizes = loops.groupBy("sample", "loop").agg(F.sum(F.when(F.col("seq") > 0, F.col("step")).otherwise(0.0)).alias("length"))
    best = sizes.groupBy("sample").agg(F.max(F.struct(F.round("length", 6).alias("length"), (-F.col("loop")).alias("order"))).alias("b"))
    return loops.join(best.select("sample", (-F.col("b.order")).alias("loop"), F.col("b.length").alias("length")), ["sample", "loop"])
