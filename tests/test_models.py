"""Gaussian-process curves and the refinement model against plain NumPy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import density as D
from lamina.operators import gaussian_process as G
from lamina.operators import refinement as R


def _curve(spark):
    rng = np.random.default_rng(42)
    rows = []
    for s, peaks in (("two", (0.25, 0.55)), ("none", ())):
        for i in range(50):
            c = (i + 0.5) * 0.02
            rows.append((s, i, c, float(0.5 + sum(0.35 * np.exp(-((c - p) ** 2) / 0.006) for p in peaks) + (rng.normal(0, 0.01) if peaks else c))))
    return spark.createDataFrame(rows, "sample string, bin int, center double, density double")


def _plain(x, y, theta, at):
    """Log likelihood, mean and deviation by dense inverses."""
    c, length, noise = theta
    k = lambda a, b: (lambda r: c * (1 + r + r * r / 3) * np.exp(-r))(np.sqrt(5) * np.abs(a[:, None] - b[None]) / length)
    z = (y - y.mean()) / y.std()
    full = k(x, x) + (noise + 1e-10) * np.eye(len(x))
    inverse = np.linalg.inv(full)
    score = -0.5 * z @ inverse @ z - 0.5 * np.linalg.slogdet(full)[1] - len(x) / 2 * np.log(2 * np.pi)
    to = k(x, at)
    return score, to.T @ inverse @ z * y.std() + y.mean(), np.sqrt(c + noise - np.einsum("ij,ik,kj->j", to, inverse, to)) * y.std()


def test_fits_and_posteriors(spark):
    curve = _curve(spark)
    fits = {r.sample: r for r in G.fitted(curve).collect()}
    fine = {s: [] for s in fits}
    for r in G.posterior(G.fitted(curve)).orderBy("sample", "bin").collect():
        fine[r.sample].append((r.mean, r.std))
    rng = np.random.default_rng(1)
    for s, r in fits.items():
        x, y = np.array(r.xs), np.array(r.ys)
        score, mean, std = _plain(x, y, r.theta, np.linspace(0, 1, G.FINE))
        assert abs(score - r.likelihood) < 1e-4 * abs(score)
        got = np.array(fine[s])
        assert np.abs(got[:, 0] - mean).max() < 1e-4 and np.abs(got[:, 1] - std).max() < 1e-3
        others = [np.exp(rng.uniform(*np.log(b))) for _ in range(300) for b in G.BOUNDS]
        assert all(_plain(x, y, t, x[:1])[0] < r.likelihood + 0.05 for t in zip(*[iter(others)] * 3, strict=True))


def test_layers_from_sure_peaks_and_default_ones(spark):
    got = {}
    for r in G.gp_layers(_curve(spark)).collect():
        got.setdefault(r.sample, {})[r.layer] = r
    two = got["two"]
    assert two["L1"].start == 0 and two["L5/6"].end == 1 and all(r.uncertainty > 0 for r in two.values())
    assert two["L1"].end < 0.25 < two["L2/3"].end < 0.55 < two["L4"].end < 0.7
    assert {(r.layer, r.start, r.end) for r in got["none"].values()} == set(D.DEFAULT_LAYERS) and all(r.uncertainty is None for r in got["none"].values())


def test_curves_without_spread_or_rows(spark):
    flat = spark.createDataFrame([("f", i, (i + 0.5) * 0.02, 1.0) for i in range(50)], "sample string, bin int, center double, density double")
    assert G.gp_layers(flat).count() == 4
    assert G.gp_layers(flat.limit(0)).count() == 0


def _rows(spark, n=1500):
    rng = np.random.default_rng(3)
    x = rng.random((n, 4))
    y = 5 * x[:, 0] - 3 * np.abs(x[:, 1] - 0.5) + 2
    return x, y, spark.createDataFrame([(f"b{i % 2}", i, float(i), [float(v) for v in x[i]], float(y[i])) for i in range(n)], "boundary string, x int, y double, features array<double>, offset double")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    weights = [rng.normal(size=w.shape) for w in R.start("mlp", 4)]
    x, y = rng.normal(size=(9, 4)), rng.normal(size=9)
    _, made = R.gradients(weights, x, y, 0.5)
    for w, g in zip(weights, made, strict=True):
        for _ in range(5):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            before = w[at]
            w[at] = before + 1e-6
            up = R.gradients(weights, x, y, 0.5)[0]
            w[at] = before - 1e-6
            down = R.gradients(weights, x, y, 0.5)[0]
            w[at] = before
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_a_round_sums_all_batches(spark):
    x, y, rows = _rows(spark, 700)
    model = R.Refiner([np.random.default_rng(2).normal(size=w.shape) for w in R.start("residual", 4)], np.zeros(4), np.ones(4))
    packed = R.batches(rows)
    parts = packed.collect()
    assert sum(len(p.ys) for p in parts) == 700 and max(len(p.ys) for p in parts) == R.BATCH
    found = R._sums(packed.repartition(3), model, 0.5)
    want = [R.gradients(model.weights, np.array(p.xs).reshape(-1, 4), np.array(p.ys), 0.5) for p in parts if not p.check]
    total = sum(np.concatenate([g.ravel() for g in gs]) for _, gs in want)
    assert np.allclose([found[i] for i in range(len(total))], total)
    assert abs(found[R._LOSS] - sum(v for v, _ in want)) < 1e-6 * found[R._LOSS]


@pytest.mark.parametrize("kind", ["mlp", "residual"])
def test_training_learns_and_repeats(spark, kind):
    x, y, rows = _rows(spark)
    model = R.train(rows, kind, 0.03, smooth=0.0, rounds=50, patience=20)
    assert np.abs(model(x) - y).mean() < 0.25 * np.abs(y - np.median(y)).mean()
    assert min(s for _, s in model.history) < model.history[0][1]
    if kind == "mlp":
        again = R.train(rows.repartition(7), kind, 0.03, smooth=0.0, rounds=50, patience=20)
        assert np.abs(model(x) - again(x)).max() < 0.05
        moved = R.refined(rows.withColumn("more", F.lit(1)), model, 3).collect()
        assert len(moved) == len(x) and np.mean([abs(r.refined - r.y - y[r.x]) for r in moved]) < 2


def test_training_without_rows(spark):
    none = _rows(spark, 3)[2].limit(0)
    assert R.refined(none, R.train(none)).count() == 0
