"""Filters of gray rasters (sample, x, y, v) and masks by tiles with halos: blur, running extrema, top-hat, paraboloid, local equalisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.colours import contrast
from lamina.operators.geometry import ellipse
from lamina.operators.tiles import TILE, own, on_canvas, reflected, tile_map

# Kernels of the small odd sizes.
SMALL_KERNELS = {1: (1.0,), 3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}


def gaussian_kernel(size: int) -> tuple[float, ...]:
    """Weights of an odd size; beyond the small ones the deviation follows from the size."""
    if size in SMALL_KERNELS:
        return SMALL_KERNELS[size]
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return tuple(w / sum(raw) for w in raw)


def blurred(gray: DataFrame, size: int, width: int, height: int, tile: int = TILE) -> DataFrame:
    """Gaussian blur, mirrored at the canvas's edges, rounded half up; pixels that the table lacks count as 0 and get a value."""
    weights, halo = gaussian_kernel(size), size // 2

    def run(x0: int, y0: int, v: np.ndarray) -> dict[str, np.ndarray]:
        whole = reflected(v, x0, y0, width, height)
        many = len(v) - 2 * halo
        across = sum(w * whole[:, k : k + many] for k, w in enumerate(weights))
        down = np.zeros_like(v)
        down[halo : halo + many, halo : halo + many] = sum(w * across[k : k + many] for k, w in enumerate(weights))
        x, y, made = own(down, x0, y0, halo, width, height)
        return {"x": x, "y": y, "v": np.floor(made + 0.5).astype(np.int64)}

    return tile_map(gray, {"v": 0.0}, run, {"x": "int", "y": "int", "v": "int"}, width, height, halo, tile)


def spans(shape: str, size: int) -> dict[int, int]:
    """Half width of each row of a kernel of odd size, `rect` or `ellipse`."""
    r = size // 2
    if shape == "rect":
        return {dy: r for dy in range(-r, r + 1)}
    return {dy: max(dx for dx, row in ellipse(size) if row == dy) for dy in range(-r, r + 1)}


def extreme(block: np.ndarray, rows: dict[int, int], op: np.ufunc, outside: float) -> np.ndarray:
    """Least or greatest value under a kernel given by its rows, `outside` beyond the block.

    Extrema over 2, 4, 8, ... neighbours along x are made once; a row of any width is then the
    extremum of two of them, so a kernel costs its height and not its area.
    """
    r = max(rows)
    side = max(rows.values())
    padded = np.pad(block, ((r, r), (side, side)), constant_values=outside)
    h, w = block.shape
    powers = [padded]
    while 2 << (len(powers) - 1) <= 2 * side + 1:
        last, half = powers[-1], 1 << (len(powers) - 1)
        powers.append(op(last[:, :-half], last[:, half:]))
    along = {}
    for half in set(rows.values()):
        wide = 2 * half + 1
        level = wide.bit_length() - 1
        table, begin = powers[level], side - half
        along[half] = op(table[:, begin : begin + w], table[:, begin + wide - (1 << level) :][:, :w])
    out = None
    for dy, half in rows.items():
        part = along[half][r + dy : r + dy + h]
        out = part if out is None else op(out, part)
    return out


def opened_gray(gray: DataFrame, size: int, width: int, height: int, shape: str = "ellipse", tile: int = TILE) -> DataFrame:
    """Adds `background`, the gray opening of each pixel of the canvas: greatest of least values under the kernel, none beyond the canvas."""
    rows, halo = spans(shape, size), 2 * (size // 2)

    def run(x0: int, y0: int, v: np.ndarray) -> dict[str, np.ndarray]:
        here = on_canvas(v.shape, x0, y0, width, height)
        low = extreme(np.where(here, v, np.inf), rows, np.minimum, np.inf)
        high = extreme(np.where(here, low, -np.inf), rows, np.maximum, -np.inf)
        x, y, made = own(high, x0, y0, halo, width, height)
        return {"x": x, "y": y, "v": own(v, x0, y0, halo, width, height)[2].astype(np.int64), "background": made.astype(np.int64)}

    return tile_map(gray, {"v": 0.0}, run, {"x": "int", "y": "int", "v": "int", "background": "int"}, width, height, halo, tile)


def enhanced(gray: DataFrame, width: int, height: int, size: int = 51, alpha: float = 1.5, beta: float = 10.0, tile: int = TILE) -> DataFrame:
    """sample, x, y and v: the image less its gray opening (top-hat), then brighter and with more contrast."""
    opened = opened_gray(gray, size, width, height, tile=tile)
    return opened.select("sample", "x", "y", contrast(F.greatest(F.col("v") - F.col("background"), F.lit(0)), alpha, beta).alias("v"))


def morphed(mask: DataFrame, steps: list[tuple[str, str, int, int]], width: int, height: int, tile: int = TILE) -> DataFrame:
    """A mask after several steps (`open`, `close`, `dilate` or `erode`; kernel shape; odd size; times) in one pass over tiles.

    The plane around the canvas is empty, and what grows out of the canvas can shrink back into it.
    """
    plan = []
    for what, shape, size, times in steps:
        rows = spans(shape, size)
        grow, shrink = (np.maximum, rows), (np.minimum, rows)
        plan += {"open": [shrink] * times + [grow] * times, "close": [grow] * times + [shrink] * times, "dilate": [grow] * times, "erode": [shrink] * times}[what]
    halo = sum(max(rows) for _, rows in plan)

    def run(x0: int, y0: int, on: np.ndarray) -> dict[str, np.ndarray]:
        now = on.astype(np.uint8)
        for op, rows in plan:
            now = extreme(now, rows, op, 0)
        x, y, made = own(now, x0, y0, halo, width, height)
        return {"x": x[made > 0], "y": y[made > 0]}

    return tile_map(mask.select("sample", "x", "y", F.lit(True).alias("on")), {"on": False}, run, {"x": "int", "y": "int"}, width, height, halo, tile, False)


def paraboloid_background(gray: DataFrame, radius: int, width: int, height: int, tile: int = TILE) -> DataFrame:
    """sample, x, y, v and raised: the greatest of v less a parabola of the radius over each row, then of that over each column.

    The parabola ends where it has fallen by 255. A tile needs only the halo of that reach, and only the distances
    at which a parabola can still win over the block's own range.
    """
    reach = math.ceil(math.sqrt(2 * radius * 255))

    def run(x0: int, y0: int, v: np.ndarray) -> dict[str, np.ndarray]:
        here = on_canvas(v.shape, x0, y0, width, height)
        now = np.where(here, v, -np.inf)
        for axis in (1, 0):
            source, now = now, now.copy()
            seen = source[np.isfinite(source)]
            far = min(reach, int(math.sqrt(2 * radius * (seen.max() - seen.min()))) + 1, source.shape[axis] - 1)
            for d in range(1, far + 1):
                less = d * d / (2.0 * radius)
                if axis:
                    np.maximum(now[:, d:], source[:, :-d] - less, out=now[:, d:])
                    np.maximum(now[:, :-d], source[:, d:] - less, out=now[:, :-d])
                else:
                    np.maximum(now[d:], source[:-d] - less, out=now[d:])
                    np.maximum(now[:-d], source[d:] - less, out=now[:-d])
        x, y, made = own(now, x0, y0, reach, width, height)
        return {"x": x, "y": y, "v": own(v, x0, y0, reach, width, height)[2].astype(np.int64), "raised": made}

    return tile_map(gray, {"v": 0.0}, run, {"x": "int", "y": "int", "v": "int", "raised": "double"}, width, height, reach, tile)


def less_background(raised: DataFrame, alpha: float = 1.5) -> DataFrame:
    """sample, x, y and v: the image less its background (never above the image), stretched to 0..255 in each sample, with more contrast."""
    left = raised.withColumn("left", F.col("v") - F.least(F.col("raised"), F.col("v").cast("double")))
    span = left.groupBy("sample").agg(F.min("left").alias("lo"), F.max("left").alias("hi"))
    even = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("left") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0)
    return left.join(span, "sample").select("sample", "x", "y", contrast(even, alpha, 0.0).alias("v"))


def equalised(gray: DataFrame, width: int, height: int, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Local histogram equalisation with a limit: sample, x, y and v.

    Each of tiles x tiles parts of the canvas (widened by mirrored pixels to whole parts) has a histogram
    cut at the limit, what was cut dealt evenly, and a table of its sums; a pixel blends the tables of the four
    parts around it. The tables of four parts are one row, which a pixel meets by one join.
    """
    exact = width % tiles == 0 and height % tiles == 0
    wide, high = (n if exact else n + tiles - n % tiles for n in (width, height))
    tw, th = wide // tiles, high // tiles
    area = tw * th
    limit = max(1, int(clip * area / 256))

    def seen(c: str, size: int, whole: int):
        mirror = 2 * (size - 1) - F.col(c)
        return F.explode(F.array_compact(F.array(F.col(c), F.when((mirror >= size) & (mirror < whole), mirror))))

    at = gray.select("sample", "v", seen("x", width, wide).alias("x"), "y").select("sample", "v", "x", seen("y", height, high).alias("y"))
    counts = at.groupBy("sample", F.floor(F.col("y") / th).alias("r"), F.floor(F.col("x") / tw).alias("c"), "v").agg(F.count("*").alias("n"))
    bins = counts.groupBy("sample", "r", "c").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(255))
    bins = bins.withColumn("h", F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("long")))
    bins = bins.withColumn("cut", F.aggregate("h", F.lit(0).cast("long"), lambda s, n: s + F.greatest(n - limit, F.lit(0))))
    bins = bins.withColumns({"even": F.floor(F.col("cut") / 256), "rest": F.pmod("cut", F.lit(256))})
    step = F.greatest(F.floor(F.lit(256) / F.greatest("rest", F.lit(1))), F.lit(1))
    extra = lambda i: F.when((F.pmod(i, step) == 0) & (F.floor(i / step) < F.col("rest")), 1).otherwise(0)
    bins = bins.withColumn("h", F.transform("h", lambda n, i: F.least(n, F.lit(limit)) + F.col("even") + extra(i)))
    running = F.transform(every, lambda i: F.aggregate(F.slice("h", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, n: s + n))
    tables = bins.select("sample", "r", "c", F.transform(running, lambda s: F.least(F.lit(255), F.rint(s * F.lit(255.0 / area)).cast("int"))).alias("lut"))
    roles = lambda c: F.array_compact(F.array(F.struct(F.col(c).alias("q"), F.lit(1).alias("k")), F.struct((F.col(c) - 1).alias("q"), F.lit(2).alias("k")), F.when(F.col(c) == 0, F.struct((F.col(c) - 1).alias("q"), F.lit(1).alias("k"))), F.when(F.col(c) == tiles - 1, F.struct(F.col(c).alias("q"), F.lit(2).alias("k")))))
    dealt = tables.withColumn("i", F.explode(roles("r"))).withColumn("j", F.explode(roles("c")))
    corner = lambda a, b: F.max(F.when((F.col("i.k") == a) & (F.col("j.k") == b), F.col("lut"))).alias(f"l{a}{b}")
    quads = dealt.groupBy("sample", F.col("i.q").alias("qr"), F.col("j.q").alias("qc")).agg(*[corner(a, b) for a in (1, 2) for b in (1, 2)])
    spot = lambda c, size: F.col(c) / F.lit(float(size)) - 0.5
    placed = gray.select("sample", "x", "y", "v", F.floor(spot("y", th)).alias("qr"), F.floor(spot("x", tw)).alias("qc"))
    met = placed.join(quads, ["sample", "qr", "qc"])
    fx, fy = spot("x", tw) - F.col("qc"), spot("y", th) - F.col("qr")
    of = lambda t: F.coalesce(F.col(t)[F.col("v")], F.lit(0))
    blend = (of("l11") * (1 - fx) + of("l12") * fx) * (1 - fy) + (of("l21") * (1 - fx) + of("l22") * fx) * fy
    return met.select("sample", "x", "y", F.least(F.lit(255), F.rint(F.round(blend, 9))).cast("int").alias("v"))
