"""Edge cases of boundaries, geometry, components and files that the tables do not hold."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import boundaries, colours, density, features, geometry, graph, polylines
from lamina.sources import files


def test_edges_at_the_border_of_the_canvas(spark):
    mask = spark.createDataFrame([("a", "L1", x, y) for x in range(4) for y in range(2)], "sample string, layer string, x int, y int")
    got = {r.x: (r.top, r.bottom) for r in boundaries.column_edges(mask, 4, 5).collect()}
    assert got == {x: (1, 2) for x in range(4)}  # the upper rows have no neighbour outside the mask on the canvas


def test_interpolation_is_clamped_and_takes_medians(spark):
    knots = spark.createDataFrame([("b", 2, 1.0), ("b", 2, 3.0), ("b", 4, 6.0), ("c", 0, 1.0)], "k string, x int, y double")
    wanted = spark.createDataFrame([("b", x) for x in (0, 2, 3, 9)] + [("d", 1)], "k string, x int")
    got = {(r.k, r.x): r.y for r in boundaries.interpolated(knots, wanted, "k").collect()}
    assert got == {("b", 0): 2.0, ("b", 2): 2.0, ("b", 3): 4.0, ("b", 9): 6.0, ("d", 1): None}


def test_inner_boundaries_of_merged_and_separate_layers(spark):
    bounds = spark.createDataFrame([("s", 0.0, 0.1, 0.3, 0.5, 0.7, 1.0)], "sample string, b0 double, b1 double, b2 double, b3 double, b4 double, b5 double")
    for merged in (True, False):
        got = {r.boundary: r.depth for r in boundaries.inner_boundaries(density.bounds_to_layers(bounds, merged)).collect()}
        assert got == {"L1_2": 0.1, "L3_4": 0.5, "L4_5": 0.7}


def test_first_palette_colour_wins(spark):
    near = spark.createDataFrame([(255, 100, 100), (240, 115, 85), (239, 100, 100), (255, 255, 100)], "b int, g int, r int")
    assert [r.layer for r in near.select(colours.palette_layer().alias("layer")).collect()] == ["L1", "L1", None, "L5/6"]


def test_components_touch_at_corners(spark):
    mask = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 3, 0), ("b", 0, 0)], "sample string, x int, y int")
    got = {(r.sample, r.x, r.y): r.component for r in graph.mask_components(mask, 10).collect()}
    assert got == {("a", 0, 0): 0, ("a", 1, 1): 0, ("a", 3, 0): 3, ("b", 0, 0): 0}
    assert {(r.sample, r.component, r.pixels) for r in graph.largest(graph.mask_components(mask, 10)).collect()} == {("a", 0, 2), ("b", 0, 1)}


def test_sizes_and_kernels():
    assert geometry.odd_size(51, 0.1) == 5 and geometry.odd_size(51, 0.08) == 5 and geometry.pixel_offset(-37.5, 1.625) == -23
    assert len(geometry.ellipse(3)) == 5 and len(geometry.ellipse(5)) == 17
    with pytest.raises(ValueError):
        geometry.odd_size(51, 0)


def test_density_of_lone_and_lined_up_points(spark):
    one = spark.createDataFrame([("a", 1, 0.0, 0.0)], "sample string, id int, x double, y double")
    assert [r.density for r in density.kernel_density(one).collect()] == [1.0]
    line = spark.createDataFrame([(float(i), 0.0) for i in range(5)], "x double, y double")
    assert [r.log_density for r in features.density_at(one, line).collect()] == [-20.0]
    four = spark.createDataFrame([("a", i, float(i % 2), float(i // 2)) for i in range(4)], "sample string, id int, x double, y double")
    s = (1 / 3) * 4 ** (-1 / 3)
    want = sum(math.exp(-0.5 * (dx + dy) / s) for dx in (0, 1) for dy in (0, 1)) / (4 * 2 * math.pi * s) * 2
    assert all(abs(r.density - want) < 1e-9 for r in density.kernel_density(four).collect())


def test_files_without_names_and_of_many_kinds(spark, tmp_path):
    (tmp_path / "p.csv").write_text("first,second\n1,2\nx,4\n")
    got = files.first_two(spark.read.option("header", True).csv(str(tmp_path))).collect()
    assert [(r.x, r.y) for r in got] == [(1.0, 2.0), (None, 4.0)]
    listed = spark.createDataFrame([("a", "a.PNG"), ("a", "a.tif"), ("b", "b.txt"), ("c", "c.Jpg")], "stem string, path string")
    assert {(r.stem, r.path) for r in files.best_paths(listed, ("tif", "png", "jpg")).collect()} == {("a", "a.tif"), ("c", "c.Jpg")}


def _cut_twice(p, rounds):
    for _ in range(rounds):
        p = [p[0], *[q for a, b in zip(p, p[1:], strict=False) for q in (0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b)], p[-1]]
    return p


def test_cut_corners_are_not_sorted_again(spark):
    """whatever the rounds, contours are sorted once, before their points are many."""
    rng = np.random.default_rng(4)
    lines = {c: rng.random(n) * 100 for c, n in ((1, 3), (2, 4), (3, 9), (4, 2), (5, 1))}
    rows = spark.createDataFrame([(c, 2 * i, float(i), float(v)) for c, y in lines.items() for i, v in enumerate(y)] + [(6, i, float(i), None if i == 1 else 1.0) for i in range(5)], "contour_id int, seq long, x double, y double")
    for rounds in (0, 1, 2, 3):
        got = {}
        out = polylines.chaikin_rounds(rows, rounds)
        for r in out.orderBy("contour_id", "seq").collect():
            got.setdefault(r.contour_id, []).append((r.seq, r.x, r.y))
        for c, y in lines.items():
            if len(y) < 3:
                assert got[c] == [(2 * i, float(i), v) for i, v in enumerate(y)]
                continue
            assert [s for s, _, _ in got[c]] == list(range(len(y) << rounds))
            assert [v for _, _, v in got[c]] == _cut_twice(list(y), rounds)
            assert [x for _, x, _ in got[c]] == _cut_twice([float(i) for i in range(len(y))], rounds)
        assert sum(v is None for _, _, v in got[6]) == {0: 1, 1: 4, 2: 10, 3: 22}[rounds] and len(got[6]) == 5 << rounds
    plans = [polylines.chaikin_rounds(rows, r)._jdf.queryExecution().optimizedPlan().toString().count("Window ") for r in (1, 3)]
    assert plans[0] == plans[1]


def test_polygons_in_bands(spark, monkeypatch):
    """the tasks that sort scanlines grow with their number, and bands of scanlines change no row."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(c, i, float(x), float(y)) for c in range(5) for i, (x, y) in enumerate(rng.integers(-90, 200, (12, 2)))], "contour_id int, seq long, x double, y double")
    whole = sorted(map(tuple, polylines.polygon_rows(rows).collect()))
    monkeypatch.setattr(polylines, "BAND", 3)
    monkeypatch.setattr(polylines, "ROWS", 100)
    made = polylines.polygon_rows(rows)
    assert sorted(map(tuple, made.collect())) == whole
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and max(int(n) for n in re.findall(r"RepartitionByExpression .*?(\d+)$", plan, re.M)) > 20


def test_curve_of_summed_cells(spark):
    """F8: layer_analysis sums cells by pixel and bin first; parts, nulls and cells outside give the curve of the cells."""
    rows = spark.createDataFrame([("a", i % 7, i / 40, None if i % 5 == 0 else i * 0.3) for i in range(45)] + [("b", 0, 7.0, 1.0), ("c", 0, 0.5, None)], "sample string, x int, depth double, density double")
    parts = rows.groupBy("sample", "x", density.bin_of(rows.depth).alias("bin")).agg(F.sum("density").alias("total"), F.count("density").alias("n"))
    want, got = ({(r.sample, r.bin): r.density for r in c.collect()} for c in (density.curve(rows), density.curve_of_sums(parts)))
    assert set(got) == set(want) and len(want) == 150 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_signed_distances_in_batches(spark):
    """distances are made in batches, not by lambdas on rows; repeated points, missing places and level sides are as before."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 4.0), (0.0, 4.0)]
    lines = spark.createDataFrame([(1, 1, i, x, y) for i, (x, y) in enumerate(square)], "k int, contour_id int, seq long, x double, y double")
    points = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 6.0, 2.0), (1, 2, 4.0, 4.0), (1, 3, None, 2.0), (1, 4, 7.0, 8.0), (2, 5, 0.0, 0.0)], "k int, seq int, x double, y double")
    made = polylines.signed_distances(points, lines, ["k"])
    assert {r.seq: r.distance and abs(r.distance) * (1 if r.distance > 0 else -1) for r in made.collect()} == {0: 1.0, 1: -2.0, 2: 0.0, 3: None, 4: -5.0}
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_places_far_from_all_cells_have_the_floor_and_no_row_of_sums(spark):
    cells = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(35)], "x double, y double")
    places = spark.createDataFrame([("in", 3.0, 2.0), ("far", 1e6, 2.0), ("none", None, 2.0)], "id string, x double, y double")
    assert [r.id for r in features.density_near(places, cells).collect()] == ["in"]
    found = {r.id: r.log_density for r in features.density_at(places, cells).collect()}
    assert found["far"] == found["none"] == -20.0 and -20.0 < found["in"] < 0
    assert {r.id: r.near for r in features.counts_within(places, cells, 1.0).collect()} == {"in": 5}
