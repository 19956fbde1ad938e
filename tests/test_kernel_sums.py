"""Kernel sums by moments against all pairs."""

import numpy as np
import pytest

from lamina.operators import density, kernel_sums


def _pairs(places, sources):
    d = places[:, None] - sources[None]
    return np.exp(-0.5 * (d * d).sum(axis=2)).sum(axis=1)


def _frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


@pytest.mark.parametrize("spread", [0.3, 6.0, 60.0])
def test_sums_equal_all_pairs(spark, spread, monkeypatch):
    monkeypatch.setattr(kernel_sums, "ROWS", 300)  # several tasks a block
    rng = np.random.default_rng(3)
    sources = np.concatenate([rng.normal(0, spread, (900, 2)), np.repeat([[0.5, -1.0]], 400, axis=0)])
    places = np.concatenate([rng.normal(0, spread, (400, 2)), sources[:200], [[1000.0, 1000.0], [0.0, 0.0], [-1.0, 16.0]]])
    rows = [("a", i, float(u), float(v)) for i, (u, v) in enumerate(places)]
    held = [("a", float(u), float(v)) for u, v in sources]
    bad = [("a", -1, None, 1.0), ("a", -2, float("nan"), 1.0), ("a", -3, float("inf"), 0.0), (None, -4, 0.0, 0.0)]
    got = kernel_sums.gauss_sums(
        _frame(spark, rows + bad + [("b", 10_000, 0.0, 0.0), ("none", 10_001, 0.0, 0.0)], "c string, id long, u double, v double").repartition(5),
        _frame(spark, held + [("b", 0.0, 1.0), ("a", None, 0.0), ("a", float("inf"), 0.0), (None, 0.0, 0.0)], "c string, u double, v double").repartition(7),
    )
    got = {r.id: r.total for r in got.collect()}
    want = _pairs(places, sources)
    assert len(got) == len(places) + 2
    assert np.abs(np.array([got[i] for i in range(len(places))]) - want).max() < 1e-10
    assert abs(got[10_000] - np.exp(-0.5)) < 1e-12 and got[10_001] == 0.0


def test_batches_do_not_part_a_cell(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        points = _frame(spark, [(1, i, i % 5 / 5, i % 3 / 3) for i in range(200)], "c int, id long, u double, v double")
        got = {r.id: r.total for r in kernel_sums.gauss_sums(points, points.drop("id")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = np.array([(i % 5 / 5, i % 3 / 3) for i in range(200)])
    assert np.abs(np.array([got[i] for i in range(200)]) - _pairs(at, at)).max() < 1e-9


def test_empty_tables(spark):
    points = _frame(spark, [(1, 1, 0.0, 0.0)], "c int, id long, u double, v double")
    none = points.limit(0)
    assert [r.total for r in kernel_sums.gauss_sums(points, none.drop("id")).collect()] == [0.0]
    assert kernel_sums.gauss_sums(none, points.drop("id")).count() == 0


def test_density_of_far_and_dense_samples(spark):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(0, 1, (700, 2)) @ [[1.0, 0.4], [0.0, 0.2]], [[30.0, 20.0]]]) + 1e6
    points = _frame(spark, [("s", i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [("one", 900, 1.0, 2.0), ("line", 901, 0.0, 0.0), ("line", 902, 1.0, 1.0), ("s", 903, None, 0.0)], "sample string, id long, x double, y double")
    got = {r.id: r.density for r in density.kernel_density(points).collect()}
    n = len(at)
    cov = np.cov(at.T) * n ** (-1 / 3)
    d = at[:, None] - at[None]
    want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d)).sum(axis=1) / (n * 2 * np.pi * np.sqrt(np.linalg.det(cov))) * np.sqrt(n)
    assert np.abs(np.array([got[i] for i in range(n)]) / want - 1).max() < 1e-7
    assert got[900] == 1.0 and set(got) == set(range(n)) | {900}
