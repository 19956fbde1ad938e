"""Exact Euclidean distance transforms of whole rasters: columns by windows, rows by the lower envelope of parabolas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a raster that one group holds.
ROWS = 16


def _nearest(at: np.ndarray, up: np.ndarray, width: int) -> np.ndarray:
    """Squared distance of each place 0 to width - 1 of a row: the least (x - at)^2 + up. `at` ascends; all are whole numbers.

    The best candidate moves right with x, so the places between two known ones need only the
    candidates between theirs: each level of halving looks at every candidate about once.
    """
    best = np.full(width, -1, np.int64)
    out = np.zeros(width, np.int64)
    step = 1 << max(0, (width - 1).bit_length())
    while step:
        x = np.arange(step - 1 if step > 1 else 0, width, step)
        x = x[best[x] < 0]
        if len(x):
            left, right = x - x % (2 * step) - 1, x - x % (2 * step) + 2 * step - 1
            lo = np.where(left >= 0, best[np.maximum(left, 0)], 0)
            hi = np.where(right < width, best[np.minimum(right, width - 1)], len(at) - 1)
            lo, hi = np.where(lo < 0, 0, lo), np.where(hi < 0, len(at) - 1, hi)
            many = hi - lo + 1
            begin = np.cumsum(many) - many
            k = np.arange(many.sum()) - np.repeat(begin - lo, many)
            value = (np.repeat(x, many) - at[k]) ** 2 + up[k]
            least = np.minimum.reduceat(value, begin)
            hit = np.flatnonzero(value == np.repeat(least, many))
            first = hit[np.searchsorted(hit, begin)]
            best[x], out[x] = k[first], least
        step >>= 1
    return out


def seed_distances(seeds: DataFrame, width: int, height: int, rows: int = ROWS) -> DataFrame:
    """sample, kind, x, y and squared (long): squared distance of every pixel of the canvas to the nearest seed of its kind.

    `seeds` has sample, kind, x and y; those off the canvas take no part, kinds without one have no rows. A
    column's seeds share its pixels among them, without a join; a group then holds `rows` rows of one kind.
    """
    on = seeds.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select("sample", "kind", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    column = Window.partitionBy("sample", "kind", "x").orderBy("y")
    above, below = F.lag("y").over(column), F.lead("y").over(column)
    mine = on.withColumns({"lo": F.coalesce(F.floor((above + F.col("y")) / 2).cast("int") + 1, F.lit(0)), "hi": F.coalesce(F.floor((F.col("y") + below) / 2).cast("int"), F.lit(height - 1))})
    # A column meets a block of rows once: what it is far from in each of them follows from its seeds there.
    each = mine.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / rows).cast("int"), F.floor(F.col("hi") / rows).cast("int"))))
    kinds = {c: on.schema[c].dataType.simpleString() for c in ("sample", "kind")}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sample, kind, block = key
        x, y, lo, hi = (table[c].to_numpy().astype(np.int64) for c in ("x", "y", "lo", "hi"))
        top = block.as_py() * rows
        parts = []
        for row in range(top, min(top + rows, height)):
            met = np.flatnonzero((lo <= row) & (row <= hi))
            met = met[np.argsort(x[met], kind="stable")]
            if len(met):
                parts.append((row, _nearest(x[met], (y[met] - row) ** 2, width)))
        n = width * len(parts)
        ys = np.repeat([r for r, _ in parts], width) if parts else np.zeros(0, np.int64)
        squared = np.concatenate([d for _, d in parts]) if parts else ys
        return pa.table({"sample": pa.array([sample.as_py()] * n, sample.type), "kind": pa.array([kind.as_py()] * n, kind.type), "x": pa.array(np.tile(np.arange(width), len(parts)), pa.int32()), "y": pa.array(ys, pa.int32()), "squared": pa.array(squared, pa.int64())})

    return each.groupBy("sample", "kind", "block").applyInArrow(run, f"sample {kinds['sample']}, kind {kinds['kind']}, x int, y int, squared long")


def depth_raster(pia: DataFrame, white: DataFrame, width: int, height: int) -> DataFrame:
    """sample, x, y, d_pia, d_white and depth of every pixel: how far along it lies from pia (0) to white matter (1).

    Samples that lack one of the two have no rows.
    """
    both = pia.select("sample", F.lit(0).alias("kind"), "x", "y").unionByName(white.select("sample", F.lit(1).alias("kind"), "x", "y"))
    far = F.sqrt(F.col("squared").cast("double"))
    met = seed_distances(both, width, height).groupBy("sample", "x", "y").agg(F.max(F.when(F.col("kind") == 0, far)).alias("d_pia"), F.max(F.when(F.col("kind") == 1, far)).alias("d_white"))
    return met.filter("d_pia is not null and d_white is not null").withColumn("depth", F.col("d_pia") / (F.col("d_pia") + F.col("d_white") + 1e-8))
