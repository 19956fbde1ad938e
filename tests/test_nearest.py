"""Nearest distances by two grids against all pairs."""

import numpy as np
import pytest

from lamina.operators import nearest


def _distances(spark, points, targets, **kw):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    t = spark.createDataFrame([(float(x), float(y)) for x, y in targets], "x double, y double")
    got = {r.id: r.distance for r in nearest.nearest_distance(p.repartition(5), t.repartition(3), **kw).collect()}
    return np.array([got[i] for i in range(len(points))])


def _pairs(points, targets):
    return np.hypot(*(np.asarray(points)[:, None] - np.asarray(targets)[None]).transpose(2, 0, 1)).min(axis=1)


def _places(kind):
    rng = np.random.default_rng(2)
    if kind == "line":
        x = np.linspace(0, 1000, 900)
        return rng.uniform(-200, 1200, (500, 2)), np.stack([x, 30 * np.sin(x / 50)], axis=1)
    if kind == "clusters":
        hot = rng.normal(0, 1e-6, (600, 2)) + [[5.0, 5.0]]
        return np.concatenate([hot[:100], rng.uniform(-9, 9, (300, 2)), [[1e6, -1e6]]]), np.concatenate([hot, np.repeat([[1.0, 2.0]], 300, axis=0), rng.uniform(-9, 9, (50, 2))])
    if kind == "few":
        return rng.uniform(0, 1, (50, 2)), np.array([[0.5, 0.5], [2.0, 2.0]])
    return np.array([[3.0, 3.0], [3.0, 3.0]]), np.array([[3.0, 3.0]] * 40)


@pytest.mark.parametrize("kind", ["line", "clusters", "few", "same"])
def test_equals_all_pairs(spark, kind):
    points, targets = _places(kind)
    assert np.abs(_distances(spark, points, targets) - _pairs(points, targets)).max() < 1e-9


def test_bad_rows_and_empty_tables(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, float("inf"), 0.0)], "id long, x double, y double")
    t = spark.createDataFrame([(3.0, 4.0), (None, 1.0), (float("nan"), 0.0), (float("-inf"), 0.0)], "x double, y double")
    assert [tuple(r) for r in nearest.nearest_distance(p, t, name="far").collect()] == [(1, 5.0)]
    assert nearest.nearest_distance(p, t.limit(0)).count() == 0 and nearest.nearest_distance(p.limit(0), t).count() == 0


def test_far_points_make_few_pairs_of_cells(spark, monkeypatch):
    """F1 (r04): points far from a long line of targets came to a dozen pairs of cells each, which were written and shuffled."""
    x = np.arange(4000) * 5.0
    points = np.stack([np.repeat(x, 2), np.random.default_rng(4).uniform(100, 900, 8000)], axis=1)
    targets = np.stack([x, np.random.default_rng(5).integers(0, 50, 4000)], axis=1)
    pairs, keep = [], nearest.kept

    def counted(df, name="round"):
        out = keep(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(nearest, "kept", counted)
    assert np.abs(_distances(spark, points, targets) - _pairs(points, targets)).max() < 1e-9
    assert sum(pairs) < len(points)


def test_several_tables_of_targets_at_once(spark):
    x = np.arange(1000) * 5.0
    rng = np.random.default_rng(4)
    points = np.stack([np.repeat(x, 3), rng.uniform(100, 900, 3000)], axis=1)
    targets = np.stack([x, rng.integers(0, 50, 1000)], axis=1)
    p, t = (spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double") for rows in (points, targets))
    got = nearest.nearest_distances(p, {"near": t, "far": t.withColumn("y", 2000 - t.y), "none": t.limit(0)})
    rows = {(r.x, r.y): r for r in got.collect()}
    assert np.abs(_pairs(points, targets) - [rows[tuple(p)].near for p in points]).max() < 1e-9
    assert np.abs(_pairs(points, targets * [1, -1] + [0, 2000]) - [rows[tuple(p)].far for p in points]).max() < 1e-9
    assert len(rows) == 3000 and all(r.none is None for r in rows.values())


def test_groups_of_limited_size(spark, monkeypatch):
    """Where a cell's points or targets do not fit a group, several take a share each, and the least distance counts."""
    monkeypatch.setattr(nearest, "MOST", 50)
    angle = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    circle = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (3 + 1e-13 * np.arange(400)[:, None])
    points = np.concatenate([np.zeros((120, 2)), [[0.5, 0.25], [7.0, 7.0]]])
    assert np.abs(_distances(spark, points, circle) - _pairs(points, circle)).max() < 1e-9
    x = np.random.default_rng(6).normal(0, 1, (500, 2))
    assert np.abs(_distances(spark, x, circle) - _pairs(x, circle)).max() < 1e-9
