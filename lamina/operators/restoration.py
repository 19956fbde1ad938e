"""Long polylines in chunks: smoothing and resampling by arc length, with a halo of points around each chunk.

A polyline is (contour_id, seq, x, y) with seq from 0 without gaps. No group holds more than a chunk, so one
long contour is many tasks; only one row a chunk (its length) meets the others of its contour.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators.staging import kept

CHUNK = 1 << 13
#: Points of the first resampling, above which a contour is restored chunk by chunk.
WHOLE = 1 << 16


def gauss_weights(sigma: float, max_kernel: int) -> np.ndarray:
    """Weights over 3 deviations on each side, in a kernel of odd size `max_kernel` at most."""
    widest = max(3, max_kernel) if max(3, max_kernel) % 2 else max(3, max_kernel) - 1
    reach = min(max(1, round(sigma * 3)), widest // 2)
    raw = np.exp(-np.arange(-reach, reach + 1.0) ** 2 / (2 * sigma * sigma))
    return raw / raw.sum()


def smoothed(points: np.ndarray, rounds: int, weights: np.ndarray | None) -> np.ndarray:
    """Points after rounds of corner cutting and a Gaussian mean with repeated ends; ends stay, and so does what has under 3 points."""
    for _ in range(rounds):
        if len(points) < 3:
            break
        made = np.empty((2 * len(points), 2))
        made[0], made[-1] = points[0], points[-1]
        made[1:-1:2] = points[:-1] * 0.75 + points[1:] * 0.25
        made[2:-1:2] = points[:-1] * 0.25 + points[1:] * 0.75
        points = made
    if weights is None or len(points) < 3:
        return points
    reach = len(weights) // 2
    wide = np.pad(points, ((reach, reach), (0, 0)), mode="edge")
    made = np.stack([np.convolve(wide[:, c], weights[::-1], "valid") for c in (0, 1)], axis=1)
    made[[0, -1]] = points[[0, -1]]
    return made


class _Chunk:
    """What a chunk of smoothed points owns: its kept points, their distances to the next kept ones."""

    def __init__(self, table: pa.Table, chunk: int, size: int, halo: int, rounds: int, weights: np.ndarray | None, least: float):
        seq = table["seq"].to_numpy()
        order = np.argsort(seq, kind="stable")
        seq, grown = seq[order], 1 << rounds
        points = np.stack([table[c].to_numpy()[order].astype(float) for c in "xy"], axis=1)
        few = seq[0] == 0 and len(seq) < 3 and seq[-1] < (chunk + 1) * size + halo - 1
        grown = 1 if few else grown
        made = smoothed(points, rounds, weights)
        begin = int(seq[0]) * grown
        step = np.concatenate([[np.inf if seq[0] == 0 else 0.0], np.hypot(*np.diff(made, axis=0).T)])
        keep = np.flatnonzero(step > least)
        mine = (keep + begin >= chunk * size * grown) & (keep + begin < (chunk + 1) * size * grown)
        at = made[keep]
        along = np.hypot(*np.diff(at, axis=0).T) if len(at) else np.zeros(0)
        after = np.vstack([at[1:], at[-1:]])
        self.at, self.after = at[mine], after[mine]
        self.along = np.append(along, 0.0)[: len(at)][mine]


def _rows(points: DataFrame, size: int, halo: int) -> DataFrame:
    """Each point in its chunk and in those whose halo it belongs to."""
    lap = lambda d: F.floor((F.col("seq") + d) / size)
    return points.select("contour_id", F.col("seq").cast("long").alias("seq"), "x", "y", F.explode(F.sequence(F.greatest(lap(-halo), F.lit(0)), lap(halo))).alias("chunk"))


def resampled(points: DataFrame, step: float = 1.0, rounds: int = 0, sigma: float = 0.0, max_kernel: int = 0, least: float = 1e-6, size: int = CHUNK) -> DataFrame:
    """contour_id, k, px and py: points at equal arc lengths, about one per step (0.25 at least) and no fewer than before; both ends kept.

    Before, corners are cut `rounds` times and, with a sigma, points smoothed by a Gaussian mean. Points
    that repeat the one before go first; a polyline of one place stays one point. Chunks are
    measured in a first pass and cut in a second one; smoothed points are made anew, not stored.
    """
    weights = gauss_weights(sigma, max_kernel) if sigma else None
    halo = (len(weights) // 2 >> rounds) + 2 + rounds if weights is not None else 2 + rounds
    halo = max(halo, 8)
    rows = _rows(points, size, halo)
    kind = points.schema["contour_id"].dataType.simpleString()

    def measure(key: tuple, table: pa.Table) -> pa.Table:
        part = _Chunk(table, key[1].as_py(), size, halo, rounds, weights, least)
        return pa.table({"contour_id": pa.array([key[0].as_py()], key[0].type), "chunk": [key[1].as_py()], "n": [len(part.at)], "length": [float(part.along.sum())]})

    lengths = kept(rows.groupBy("contour_id", "chunk").applyInArrow(measure, f"contour_id {kind}, chunk long, n long, length double").filter("n > 0"), "lengths")
    whole, before = Window.partitionBy("contour_id"), Window.partitionBy("contour_id").orderBy("chunk")
    table = lengths.withColumns({"hi": F.sum("length").over(before), "points": F.sum("n").over(whole), "final": F.col("chunk") == F.max("chunk").over(whole)})
    table = table.withColumns({"lo": F.coalesce(F.lag("hi").over(before), F.lit(0.0)), "total": F.max("hi").over(whole)})
    table = table.withColumn("parts", F.greatest(F.ceil(F.col("total") / max(step, 0.25)), F.col("points") - 1)).select("contour_id", "chunk", "lo", "hi", "total", "parts", "final")

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        part = _Chunk(table, key[1].as_py(), size, halo, rounds, weights, least)
        lo, hi, total, parts, final = (table[c][0].as_py() for c in ("lo", "hi", "total", "parts", "final"))
        k, at = np.zeros(0, np.int64), np.zeros((0, 2))
        if total > 0:
            k = np.arange(max(0, math.floor(lo * parts / total) - 1), min(parts - 1, math.ceil(hi * parts / total) + 1) + 1)
            place = k * total / parts
            k, place = k[(place >= lo) & (place < hi)], place[(place >= lo) & (place < hi)]
            arc = lo + np.concatenate([[0.0], np.cumsum(part.along)[:-1]])
            i = np.maximum(np.searchsorted(arc, place, side="right") - 1, 0)
            share = np.where(part.along[i] > 0, (place - arc[i]) / np.where(part.along[i] > 0, part.along[i], 1.0), 0.0)
            at = part.at[i] + (part.after[i] - part.at[i]) * share[:, None]
        if final:
            k, at = np.append(k, parts), np.vstack([at, part.at[-1:]])
        return pa.table({"contour_id": pa.array([key[0].as_py()] * len(k), key[0].type), "k": pa.array(k, pa.int64()), "px": at[:, 0], "py": at[:, 1]})

    return rows.join(table, ["contour_id", "chunk"]).groupBy("contour_id", "chunk").applyInArrow(cut, f"contour_id {kind}, k long, px double, py double")


def without_repeats(points: DataFrame, columns: list[str], size: int = CHUNK) -> DataFrame:
    """Drops a point that equals the one before in the columns; the first of a chunk is compared with the last of the chunk before."""
    chunked = points.withColumn("chunk", F.floor(F.col("seq") / size))
    ends = chunked.groupBy("contour_id", "chunk").agg(F.max(F.struct("seq", *columns)).alias("last"))
    ends = ends.select("contour_id", "chunk", F.lag("last").over(Window.partitionBy("contour_id").orderBy("chunk")).alias("last"))
    own = Window.partitionBy("contour_id", "chunk").orderBy("seq")
    met = chunked.withColumn("_before", F.lag(F.struct("seq", *columns)).over(own)).join(ends, ["contour_id", "chunk"])
    before = F.coalesce("_before", "last")
    same = before.isNotNull()
    for c in columns:
        same &= F.col(c).eqNullSafe(before[c])
    return met.filter(~same).select(*points.columns)


def _resampled_whole(points: np.ndarray, step: float, least: float = 1e-6) -> np.ndarray:
    """What resampled() gives for a polyline of one chunk."""
    if not len(points):
        return points
    at = points[np.concatenate([[True], np.hypot(*np.diff(points, axis=0).T) > least])]
    along = np.hypot(*np.diff(at, axis=0).T)
    total = float(along.sum())
    if not total > 0:
        return at[-1:]
    parts = max(math.ceil(total / max(step, 0.25)), len(at) - 1)
    place = np.arange(parts) * total / parts
    arc = np.concatenate([[0.0], np.cumsum(along)])[:-1]
    i = np.maximum(np.searchsorted(arc, place, side="right") - 1, 0)
    share = (place - arc[i]) / along[i]
    return np.vstack([at[i] + (at[i + 1] - at[i]) * share[:, None], at[-1:]])


def _restored_short(points: DataFrame, width: int, height: int, step: float, rounds: int, weights: np.ndarray | None) -> DataFrame:
    """restored() of scaled contours that a task holds whole: nothing but their own points is shuffled."""
    kind = points.schema["contour_id"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["seq"].to_numpy(), kind="stable")
        line = np.stack([table[c].to_numpy()[order].astype(float) for c in "xy"], axis=1)
        made = _resampled_whole(smoothed(_resampled_whole(line, step), rounds, weights), step)
        made = np.rint(np.clip(made, 0.0, [width - 1.0, height - 1.0])).astype(np.int32)
        keep = np.flatnonzero(np.concatenate([[True], (made[1:] != made[:-1]).any(axis=1)]))
        keep = keep if len(keep) > 1 else keep[:0]
        return pa.table({"contour_id": pa.array([key[0].as_py()] * len(keep), key[0].type), "seq": pa.array(keep, pa.int64()), "x": made[keep, 0], "y": made[keep, 1]})

    return points.groupBy("contour_id").applyInArrow(run, f"contour_id {kind}, seq long, x int, y int")


def restored(points: DataFrame, scale: float, width: int, height: int, step: float = 1.0, rounds: int = 3, sigma: float = 15.0, max_kernel: int = 601, whole: int = WHOLE) -> DataFrame:
    """contour_id, seq, x and y (whole pixels of the canvas) of boundaries found at a reduced scale.

    Points are scaled up, resampled, smoothed and resampled again, rounded half to even and clipped; repeats go, and polylines
    of under two points. Contours of up to about `whole` resampled points are made in one task each, from their own points;
    longer ones go chunk by chunk, with tables between the steps.
    """
    large = points.select("contour_id", F.col("seq").cast("long").alias("seq"), (F.col("x") / scale).alias("x"), (F.col("y") / scale).alias("y"))
    along = Window.partitionBy("contour_id").orderBy("seq")
    far = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along)), F.lit(0.0))
    sized = large.withColumn("_far", far).groupBy("contour_id").agg((F.greatest(F.sum("_far") / max(step, 0.25), F.count("*")) > whole).alias("long"))
    sized = kept(sized, "sizes")
    weights = gauss_weights(sigma, max_kernel) if sigma else None
    short = _restored_short(large.join(sized.filter("not long"), "contour_id", "left_semi"), width, height, step, rounds, weights)
    if sized.filter("long").isEmpty():
        return short
    large = large.join(sized.filter("long"), "contour_id", "left_semi")
    named = lambda r: r.select("contour_id", F.col("k").alias("seq"), F.col("px").alias("x"), F.col("py").alias("y"))
    even = kept(named(resampled(large, step)), "resampled")
    put = lambda c, size: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), F.col(c)))).cast("int").alias(c)
    placed = kept(named(resampled(even, step, rounds, sigma, max_kernel)).select("contour_id", "seq", put("x", width), put("y", height)), "placed")
    left = without_repeats(placed, ["x", "y"])
    sizes = placed.groupBy("contour_id").agg(F.countDistinct("x", "y").alias("places")).filter("places < 2")
    return short.unionByName(left.join(sizes, "contour_id", "left_anti"))
