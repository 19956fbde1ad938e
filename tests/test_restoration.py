"""Chunked smoothing and resampling against plain versions on whole polylines."""

import math
import os

import numpy as np
import pytest

from lamina.operators import boundaries, polylines, restoration
from lamina.operators.staging import shared_dir

SCHEMA = "contour_id long, seq long, x double, y double"


def _lines():
    rng = np.random.default_rng(7)
    walk = np.cumsum(rng.normal(0, 3, (300, 2)), axis=0) + 200
    repeats = np.repeat(rng.random((40, 2)) * 90, rng.integers(1, 5, 40), axis=0)
    return {1: walk, 2: repeats, 3: rng.random((2, 2)) * 50, 4: np.array([[5.0, 5.0]] * 4), 5: np.array([[7.0, 8.0]]), 6: rng.random((17, 2)) * 30}


LINES = _lines()


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, p in LINES.items() for i, (x, y) in enumerate(p)], SCHEMA).repartition(5)


def _resample(p, step):
    keep = np.concatenate([[True], np.hypot(*np.diff(p, axis=0).T) > 1e-6]) if len(p) > 1 else np.ones(1, bool)
    p = p[keep]
    arc = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))]) if len(p) > 1 else np.zeros(1)
    if len(p) < 2:
        return p
    many = max(math.ceil(arc[-1] / max(step, 0.25)) + 1, len(p))
    at = np.linspace(0, arc[-1], many)
    return np.stack([np.interp(at, arc, p[:, c]) for c in (0, 1)], axis=1)


def _smooth(p, rounds, sigma, most):
    for _ in range(rounds):
        if len(p) >= 3:
            p = np.array([p[0], *[q for a, b in zip(p, p[1:], strict=False) for q in (0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b)], p[-1]])
    if len(p) < 3:
        return p
    widest = max(3, most) if max(3, most) % 2 else max(3, most) - 1
    reach = min(max(1, round(sigma * 3)), widest // 2)
    w = np.exp(-np.arange(-reach, reach + 1.0) ** 2 / (2 * sigma * sigma))
    out = np.array([sum(w[d + reach] * p[min(max(i + d, 0), len(p) - 1)] for d in range(-reach, reach + 1)) / w.sum() for i in range(len(p))])
    out[[0, -1]] = p[[0, -1]]
    return out


def _back(df, names=("k", "px", "py")):
    out = {}
    for r in df.collect():
        out.setdefault(r.contour_id, []).append(tuple(r[n] for n in names))
    return {c: sorted(v) for c, v in out.items()}


@pytest.mark.parametrize("size", [16, 1 << 13])
@pytest.mark.parametrize("how", [(0, 0.0, 0), (3, 15.0, 601), (2, 1.5, 7)])
def test_resampled_in_chunks(points, size, how):
    rounds, sigma, most = how
    got = _back(restoration.resampled(points, 1.3, rounds, sigma, most, size=size))
    for c, p in LINES.items():
        want = _resample(_smooth(p, rounds, sigma, most) if sigma else p, 1.3)
        assert [k for k, _, _ in got[c]] == list(range(len(want))), c
        assert np.abs(np.array([r[1:] for r in got[c]]) - want).max() < 1e-6, c


def test_restored_boundaries(points):
    got = _back(restoration.restored(points, 0.4, 600, 500, 4.0, 3, 15.0, 601), ("seq", "x", "y"))
    for c, p in LINES.items():
        made = _resample(_smooth(_resample(p / 0.4, 4.0), 3, 15.0, 601), 4.0)
        made = np.rint(np.clip(made, 0, [599, 499])).astype(int)
        want = [tuple(q) for i, q in enumerate(made) if not i or (q != made[i - 1]).any()]
        assert [r[1:] for r in got.get(c, [])] == (want if len(want) > 1 else []), c


def test_short_boundaries_are_restored_without_tables_of_points(spark, points):
    """only long contours are written between the steps; both ways give the same rows."""
    tables = lambda: {n for n in os.listdir(shared_dir(spark)) if n.startswith(("placed", "resampled"))}
    start = tables()
    short = _back(restoration.restored(points, 0.4, 600, 500, 4.0), ("seq", "x", "y"))
    assert tables() == start
    assert short == _back(restoration.restored(points, 0.4, 600, 500, 4.0, whole=0), ("seq", "x", "y"))
    mixed = _back(restoration.restored(points, 0.4, 600, 500, 4.0, whole=200), ("seq", "x", "y"))
    assert short == mixed and len(tables()) > len(start)


def test_repeats_across_chunks(spark):
    rows = spark.createDataFrame([(1, i, float(i // 3), 0.0) for i in range(50)] + [(2, 0, None, 1.0), (2, 1, None, 1.0)], SCHEMA)
    got = _back(restoration.without_repeats(rows, ["x", "y"], 4), ("seq", "x"))
    assert [s for s, _ in got[1]] == list(range(0, 50, 3)) and got[2] == [(0, None)]
    assert restoration.resampled(rows.limit(0)).count() == 0


def test_polylines_with_gaps_in_their_numbers(spark):
    rows = spark.createDataFrame([(1, 5, 0.0, 0.0), (1, 900000, 3.0, 4.0)], SCHEMA)
    assert [(r.k, r.px, r.py) for r in polylines.resampled(rows, 2.5).orderBy("k").collect()] == [(0, 0.0, 0.0), (1, 1.5, 2.0), (2, 3.0, 4.0)]


def test_interpolation_across_stretches(spark):
    rng = np.random.default_rng(1)
    xs = np.sort(rng.choice(500, 40, replace=False))
    ys = rng.random(40)
    knots = spark.createDataFrame([("b", int(x), float(y)) for x, y in zip(xs, ys, strict=True)], "k string, x int, y double")
    wanted = spark.createDataFrame([("b", x) for x in range(-20, 520)], "k string, x int")
    got = {r.x: r.y for r in boundaries.interpolated(knots, wanted, "k", 13).collect()}
    assert len(got) == 540 and all(abs(got[x] - np.interp(x, xs, ys)) < 1e-12 for x in got)
