"""Gaussian-process curves: likelihoods of a hyperparameter grid as rows, the posterior on a fine grid, layers from sure peaks.

The kernel is a constant times a Matern 5/2 kernel, plus white noise. A sample's curve is one row of
at most some tens of bins; curve and hyperparameters meet as rows, and Arrow batches of them are factored at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators import density as D
from lamina.operators.staging import kept

#: Bounds of the constant, the length and the noise.
BOUNDS = ((0.1, 10.0), (0.02, 0.5), (1e-4, 0.5))
#: Places of each on the first grid, evenly in the logarithm.
PLACES = (5, 7, 7)
FINE = 500
_ROWS = 256


def kernel(distance: np.ndarray, constant: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Constant times Matern 5/2, for one pair of values a row."""
    r = np.sqrt(5.0) * distance / length[:, None, None]
    return constant[:, None, None] * (1 + r + r * r / 3) * np.exp(-r)


def _factored(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean and deviation of y, the Cholesky factor of each row's covariance and its solution for the even y."""
    mean, sd = y.mean(1, keepdims=True), y.std(1, keepdims=True)
    sd = np.where(sd > 0, sd, 1.0)
    even = (y - mean) / sd
    k = kernel(np.abs(x[:, :, None] - x[:, None, :]), theta[:, 0], theta[:, 1])
    k[:, np.arange(k.shape[1]), np.arange(k.shape[1])] += theta[:, 2:3] + 1e-10
    low = np.linalg.cholesky(k)
    half = np.linalg.solve(low, even[:, :, None])
    return mean, sd, low, half[:, :, 0]


def _by_size(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch with equally many bins: their places, x, y and hyperparameters."""
    xs, ys, theta = (b.column(b.schema.get_field_index(c)) for c in ("xs", "ys", "theta"))
    sizes = np.array([len(v) for v in xs])
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        for k in range(0, len(at), _ROWS):
            part = at[k : k + _ROWS]
            yield part, *(np.array([c[int(i)].as_py() for i in part], float) for c in (xs, ys, theta))


def _likelihoods(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, -np.inf)
            for at, x, y, theta in _by_size(b):
                _, _, low, half = _factored(x, y, theta)
                n = x.shape[1]
                out[at] = -0.5 * (half**2).sum(1) - np.log(low[:, np.arange(n), np.arange(n)]).sum(1) - n / 2 * np.log(2 * np.pi)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "likelihood"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, likelihood double")


def fitted(curve: DataFrame, zooms: int = 3) -> DataFrame:
    """sample, xs, ys, theta (constant, length, noise) and likelihood: the best of a grid, then of finer grids around the best."""
    point = F.struct("center", "density")
    whole = curve.groupBy("sample").agg(F.sort_array(F.collect_list(point)).alias("c")).select("sample", F.transform("c", lambda p: p["center"]).alias("xs"), F.transform("c", lambda p: p["density"]).alias("ys"))
    axes = [np.geomspace(*b, n) for b, n in zip(BOUNDS, PLACES, strict=True)]
    steps = [float(a[1] / a[0]) for a in axes]

    def each(rows: DataFrame, values: list) -> DataFrame:
        """Every combination of three lists of values as theta."""
        for name, column in zip(("t0", "t1", "t2"), values, strict=True):
            rows = rows.withColumn(name, F.explode(column))
        return rows.select("sample", "xs", "ys", F.array("t0", "t1", "t2").alias("theta"))

    best = lambda rows: kept(_likelihoods(rows).groupBy("sample").agg(F.max(F.struct("likelihood", "theta")).alias("b"), F.first("xs").alias("xs"), F.first("ys").alias("ys")).select("sample", "xs", "ys", "b.theta", "b.likelihood"), "fit")
    now = best(each(whole, [F.array(*map(F.lit, a.tolist())) for a in axes]))
    for _ in range(zooms):
        steps = [s**0.4 for s in steps]
        now = best(each(now, [F.array_distinct(F.array(*[F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("theta")[i] * s**d)) for d in (-2, -1, 0, 1, 2)])) for i, (s, (lo, hi)) in enumerate(zip(steps, BOUNDS, strict=True))]))
    return now


def posterior(fits: DataFrame, places: int = FINE) -> DataFrame:
    """sample, bin, center, mean and std of the fitted curves at even places from 0 to 1; std includes the noise."""
    grid = np.linspace(0.0, 1.0, places)
    kind = fits.schema["sample"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x, y, theta in _by_size(b):
                mean, sd, low, half = _factored(x, y, theta)
                to = kernel(np.abs(x[:, :, None] - grid[None, None, :]), theta[:, 0], theta[:, 1])
                v = np.linalg.solve(low, to)
                made = np.einsum("rnp,rn->rp", v, half) * sd + mean
                left = np.maximum(theta[:, :1] + theta[:, 2:3] - (v**2).sum(1), 0.0)
                names = b.column(0).take(pa.array(np.repeat(at, places)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(places), len(at)), pa.int32()), pa.array(np.tile(grid, len(at))), pa.array(made.ravel()), pa.array((np.sqrt(left) * sd).ravel())], names=["sample", "bin", "center", "mean", "std"])

    return fits.select("sample", "xs", "ys", "theta").mapInArrow(run, f"sample {kind}, bin int, center double, mean double, std double")


def sure_peaks(curve: DataFrame, lowest: float = 0.05, highest: float = 0.8, share: float = 0.08) -> DataFrame:
    """sample, p and q: depths of the two peaks with the highest mean over deviation; samples with fewer have no row.

    Peaks keep a tenth of the searched places apart, the higher ones first; where two or more are prominent by the
    share of the range, the others do not count.
    """
    inside = curve.filter(F.col("center").between(lowest, highest))
    size = inside.groupBy("sample").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 10)).alias("distance"), (F.max("mean") - F.min("mean")).alias("range"))
    found = D.peaks(inside, "mean", FINE).join(curve.select("sample", "bin", "center", "std"), ["sample", "bin"])
    found = found.groupBy("sample").agg(F.collect_list(F.struct("height", "bin", "prominence", "center", "std")).alias("found")).join(size, "sample")
    apart = found.withColumn("apart", D._apart(F.col("found"), F.col("distance")))
    strong = F.filter("apart", lambda p: p["prominence"] >= F.col("range") * share)
    chosen = apart.withColumn("apart", F.when(F.size(strong) >= 2, strong).otherwise(F.col("apart"))).filter(F.size("apart") >= 2)
    ranked = F.reverse(F.array_sort(F.transform("apart", lambda p: F.struct((p["height"] / (p["std"] + 1e-10)).alias("score"), p["center"].alias("center")))))
    two = chosen.select("sample", ranked[0]["center"].alias("a"), ranked[1]["center"].alias("b"))
    return two.select("sample", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))


def gp_layers(curve: DataFrame) -> DataFrame:
    """sample, layer, start, end, mean_density and uncertainty of curves (sample, bin, center, density).

    Bounds lie where the fitted curve's second derivative changes sign, as for peaks of a plain curve; samples without two
    peaks get the default layers, with null uncertainty.
    """
    fine = kept(posterior(fitted(curve)), "posterior")
    step = 1.0 / (FINE - 1)
    bend = D.gradient(D.gradient(fine, "mean", "slope", step), "slope", "bend", step)
    after = F.lead("bend").over(Window.partitionBy("sample").orderBy("bin"))
    share = F.abs("bend") / (F.abs("bend") + F.abs("after") + 1e-8)
    turns = bend.withColumn("after", after).filter(F.col("bend") * F.col("after") < 0).select("sample", (F.col("center") + share * step).alias("depth"))
    found = D.mean_density(D.bounds_to_layers(D.bounds_between(sure_peaks(fine), turns)), curve)
    middle = F.least(F.ceil((F.col("start") + F.col("end")) / 2 * (FINE - 1)), F.lit(FINE - 1)).cast("int")
    named = found.withColumn("bin", middle).join(fine.select("sample", "bin", F.col("std").alias("uncertainty")), ["sample", "bin"]).drop("bin")
    usual = D.layers_of(curve).join(found.select("sample").distinct(), "sample", "left_anti")
    return named.unionByName(usual.withColumn("uncertainty", F.lit(None).cast("double")))
