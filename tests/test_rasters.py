"""Rasters in tiles against plain NumPy or Python versions on the whole image."""

import math

import numpy as np
import pytest

from lamina.operators import contours, distances, filters, graph, harmonic, masks, polylines, tiles
from lamina.queries import QUERIES
from lamina.views import view

W, H = 43, 39
OUT = ((-1, 0), (0, 1), (1, 0), (0, -1))


def _masks():
    rng = np.random.default_rng(1)
    out = {s: rng.random((H, W)) < p for s, p in (("a", 0.6), ("b", 0.3), ("c", 0.85))}
    out["d"] = np.zeros((H, W), bool)
    out["d"][5, 3:40] = out["d"][20:30, 10:35] = out["d"][0, 0] = True
    out["d"][22:25, 12:20] = False
    out["d"][23, 15] = True
    return out


MASKS = _masks()


@pytest.fixture(scope="module")
def mask(spark):
    rows = [(s, int(x), int(y)) for s, m in MASKS.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "sample string, x int, y int").repartition(6)


def _flood(m, diagonal):
    """Least flat index of each component, by a plain search."""
    h, w = m.shape
    found = np.full((h, w), -1)
    for start in range(h * w):
        if m[divmod(start, w)] and found[divmod(start, w)] < 0:
            todo = [divmod(start, w)]
            found[todo[0]] = start
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        p, q = y + dy, x + dx
                        if (dy or dx) and (diagonal or not (dy and dx)) and 0 <= p < h and 0 <= q < w and m[p, q] and found[p, q] < 0:
                            found[p, q] = start
                            todo.append((p, q))
    return found


def test_labels_of_a_block():
    rng = np.random.default_rng(0)
    for _ in range(40):
        m = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.random()
        for diagonal in (False, True):
            assert (tiles.labels(m, diagonal) == _flood(m, diagonal)).all()


def test_components_across_tiles_and_partitions(spark, mask):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.sample, r.x, r.y): r.component for r in tiles.mask_components(mask, W, H, 16).collect()}
        same = {(r.sample, r.x, r.y): r.component for r in graph.mask_components(mask, W).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for s, m in MASKS.items():
        found = _flood(m, True)
        want |= {(s, x, y): found[y, x] for y, x in zip(*np.nonzero(m), strict=True)}
    assert got == want == same


def _filled(m):
    found = _flood(~m, False)
    out = {*found[0], *found[-1], *found[:, 0], *found[:, -1]} - {-1}
    return ~np.isin(found, list(out))


def test_holes_across_tiles(mask):
    got = {(r.sample, r.x, r.y) for r in tiles.filled_holes(mask, W, H, 16).collect()}
    assert got == {(s, x, y) for s, m in MASKS.items() for y, x in zip(*np.nonzero(_filled(m)), strict=True)}


def _borders(m):
    h, w = m.shape
    on = lambda x, y: 0 <= x < w and 0 <= y < h and m[y, x]
    seen, loops = set(), {}
    for y, x, s in np.ndindex(h, w, 4):
        if on(x, y) and not on(x + OUT[s][0], y + OUT[s][1]) and (x, y, s) not in seen:
            pixels, at = [], (x, y, s)
            while at not in seen:
                seen.add(at)
                a, b, d = at
                if not pixels or pixels[-1] != (a, b):
                    pixels.append((a, b))
                (ox, oy), (tx, ty) = OUT[d], OUT[(d + 1) % 4]
                at = (a + ox + tx, b + oy + ty, (d + 3) % 4) if on(a + ox + tx, b + oy + ty) else (a + tx, b + ty, d) if on(a + tx, b + ty) else (a, b, (d + 1) % 4)
            if len(pixels) > 1 and pixels[-1] == pixels[0]:
                pixels.pop()
            loops[(y * w + x) * 4 + s] = pixels
    return loops


def test_contours_across_tiles(mask):
    got = {}
    for r in contours.contours(mask, W, H, 16).collect():
        got.setdefault((r.sample, r.loop), []).append((r.seq, r.x, r.y, r.step))
    want = {(s, k): v for s, m in MASKS.items() for k, v in _borders(m).items()}
    assert set(got) == set(want)
    for key, pixels in want.items():
        rows = sorted(got[key])
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:3] for r in rows] == pixels
        assert all(abs(math.hypot(r[1] - rows[i - 1][1], r[2] - rows[i - 1][2]) - r[3]) < 1e-9 for i, r in enumerate(rows))


def test_known_contours(spark):
    square = [("s", x, y) for x in range(2, 5) for y in range(1, 4)]
    line = [("l", x, 7) for x in range(4)]
    rows = spark.createDataFrame([*square, *line, ("p", 5, 5)], "sample string, x int, y int")
    got = {}
    for r in contours.contours(rows, 10, 10, 4).orderBy("sample", "seq").collect():
        got.setdefault(r.sample, []).append((r.x, r.y))
    assert got["s"] == [(2, 1), (2, 2), (2, 3), (3, 3), (4, 3), (4, 2), (4, 1), (3, 1)]
    assert got["l"] == [(0, 7), (1, 7), (2, 7), (3, 7), (2, 7), (1, 7)] and got["p"] == [(5, 5)]


def test_parts_in_holes_have_no_outer_contour(mask):
    loops = contours.outer_contours(mask.filter("sample = 'd'"), W, H, 16)
    assert {r.loop for r in loops.select("loop").distinct().collect()} == {0, (5 * W + 3) * 4, (20 * W + 10) * 4}
    assert {(r.loop, r.length) for r in contours.longest(loops).select("loop", "length").distinct().collect()} == {((5 * W + 3) * 4, 71.0)}
    assert contours.contours(mask.limit(0), W, H).count() == 0


def test_lower_envelope():
    rng = np.random.default_rng(2)
    for _ in range(400):
        w = int(rng.integers(1, 70))
        at = np.sort(rng.choice(w, int(rng.integers(1, w + 1)), replace=False)).astype(np.int64)
        up = rng.integers(0, 60, len(at)) ** 2
        assert (distances._nearest(at, up, w) == ((np.arange(w)[:, None] - at) ** 2 + up).min(1)).all()


def test_distances_of_every_pixel(spark):
    rng = np.random.default_rng(3)
    seeds = [("a", k, int(x), int(y)) for k, n in (("p", 9), ("w", 1)) for x, y in rng.integers(0, 50, (n, 2))] + [("b", "p", 99, 0), ("a", "p", -1, 4)]
    got = {(r.kind, r.x, r.y): r.squared for r in distances.seed_distances(spark.createDataFrame(seeds, "sample string, kind string, x int, y int"), 50, 50, 7).collect()}
    for k in "pw":
        own = np.array([(x, y) for s, kind, x, y in seeds if kind == k and s == "a" and x >= 0])
        assert all(got[k, x, y] == ((own - (x, y)) ** 2).sum(1).min() for x in range(50) for y in range(50))
    assert len(got) == 5000


def _dense(cells):
    """Field values by a dense linear solve."""
    free = [c for c, (state, _) in cells.items() if state == harmonic.FREE]
    index = {c: i for i, c in enumerate(free)}
    a, b = np.zeros((len(free), len(free))), np.zeros(len(free))
    for (x, y), i in index.items():
        near = [c for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if c in cells]
        a[i, i] = max(1, len(near))
        for c in near:
            if c in index:
                a[i, index[c]] -= 1
            else:
                b[i] += cells[c][1]
    return {c: v[1] for c, v in cells.items()} | dict(zip(free, np.linalg.solve(a, b), strict=True))


@pytest.mark.parametrize("max_dim,tile,halo", [(40, 16, 8), (60, 64, 8)])
def test_harmonic_depth_against_a_dense_solve(spark, max_dim, tile, halo):
    rng = np.random.default_rng(0)
    schema = "sample string, x double, y double"
    pia = spark.createDataFrame([("a", float(x), float(8 + 6 * np.sin(x / 9) + rng.random())) for x in range(3, 95, 2)], schema)
    white = spark.createDataFrame([("a", float(x), float(60 - 10 * np.sin(x / 13) + rng.random())) for x in range(0, 97, 3)], schema)
    points = spark.createDataFrame([("a", float(x), float(y)) for x, y in rng.random((200, 2)) * [99.3, 71.5]] + [("a", 50.0, 30.0)] * 2, schema)
    box, field = harmonic.harmonic_field(pia, white, points, max_dim, tile=tile, halo=halo)
    cells = {(r.x, r.y): (r.state, r.value) for r in harmonic.ribbon(pia, white, box).collect()}
    want = _dense(cells)
    low, high = min(want.values()), max(want.values())
    got = {(r.x, r.y): r.value for r in field.collect()}
    assert set(got) == set(want) and max(abs(got[c] - (want[c] - low) / (high - low)) for c in got) < 1e-7
    b = box.first()
    xs, ys = ([*range(lo, hi, b["size"]), hi] for lo, hi in ((b.x0, b.x1), (b.y0, b.y1)))
    rows = harmonic.sampled(points, box, field).collect()
    assert len(rows) == 202
    for r in rows:
        i, j = (max(0, min(int(np.searchsorted(v, c, side="right")) - 1, len(v) - 2)) for v, c in ((xs, r.x), (ys, r.y)))
        corners = [(i, j), (i + 1, j), (i, j + 1), (i + 1, j + 1)]
        if not all(c in got for c in corners):
            assert r.depth is None
            continue
        u, v = (r.x - xs[i]) / (xs[i + 1] - xs[i]), (r.y - ys[j]) / (ys[j + 1] - ys[j])
        assert abs(r.depth - sum(got[c] * s for c, s in zip(corners, ((1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v), strict=True))) < 1e-9


def test_a_cell_of_the_domain_without_neighbours_is_zero():
    state = np.zeros((5, 5), np.int64)
    state[2, 2] = harmonic.FREE
    assert harmonic.solved(state, np.full((5, 5), 0.7))[2, 2] == 0


def _image(seed=5):
    return np.random.default_rng(seed).integers(0, 256, (H, W))


def _table(spark, image):
    return spark.createDataFrame([("a", x, y, int(image[y, x])) for y in range(H) for x in range(W)], "sample string, x int, y int, v int")


def _back(df, column):
    out = np.zeros((H, W))
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def _extreme(image, offsets, op, outside):
    pad = max(max(map(abs, o)) for o in offsets)
    wide = np.pad(image.astype(float), pad, constant_values=outside)
    return op.reduce([wide[pad + dy : pad + dy + H, pad + dx : pad + dx + W] for dx, dy in offsets])


@pytest.mark.parametrize("size,tile", [(51, 16), (7, 32)])
def test_gray_opening_with_a_large_ellipse(spark, size, tile):
    image = _image()
    offsets = [(dx, dy) for dy, half in filters.spans("ellipse", size).items() for dx in range(-half, half + 1)]
    want = _extreme(_extreme(image, offsets, np.minimum, np.inf), offsets, np.maximum, -np.inf)
    got = filters.opened_gray(_table(spark, image), size, W, H, tile=tile)
    assert (_back(got, "background") == want).all()


@pytest.mark.parametrize("size", [3, 11])
def test_blur_is_mirrored_at_the_edges(spark, size):
    image, k = _image(), np.array(filters.gaussian_kernel(size))
    wide = np.pad(image.astype(float), size // 2, mode="reflect")
    want = np.array([[(wide[y : y + size, x : x + size] * np.outer(k, k)).sum() for x in range(W)] for y in range(H)])
    assert np.abs(_back(filters.blurred(_table(spark, image), size, W, H, 16), "v") - np.floor(want + 0.5)).max() <= 1e-9


def test_paraboloid_and_what_it_leaves(spark):
    image = _image()
    across = np.max([image[:, i][:, None] - (i - np.arange(W)) ** 2 / 102.0 for i in range(W)], axis=0)
    want = np.max([across[i][None] - ((i - np.arange(H)) ** 2 / 102.0)[:, None] for i in range(H)], axis=0)
    raised = filters.paraboloid_background(_table(spark, image), 51, W, H, 16)
    assert np.abs(_back(raised, "raised") - want).max() < 1e-9
    # The background is nowhere below the image, so nothing is left of it.
    assert not _back(filters.less_background(raised), "v").any()


def test_closing_comes_back_from_beyond_the_canvas(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 0, 8)], "sample string, x int, y int")
    got = {(r.x, r.y) for r in filters.morphed(rows, [("close", "rect", 5, 1)], W, H, 16).collect()}
    assert got == {(0, y) for y in range(5, 9)}
    assert filters.morphed(rows, [("erode", "rect", 3, 1)], W, H, 16).count() == 0


def test_equal_largest_parts_leave_the_first(spark):
    rows = spark.createDataFrame([("a", 9, 0), ("a", 0, 5), ("b", 1, 1), ("b", 2, 2), ("b", 9, 9)], "sample string, x int, y int")
    assert {tuple(r) for r in masks.largest_part(rows, 20, 8).collect()} == {("a", 9, 0), ("b", 1, 1), ("b", 2, 2)}


def test_polygons_that_cross_themselves(spark):
    bow = [("b", 0, 0), ("b", 6, 6), ("b", 6, 0), ("b", 0, 6)]
    level = [("l", 0, 0), ("l", 4, 0), ("l", 4, 3), ("l", 0, 3)]
    rows = spark.createDataFrame([(c, i, float(x), float(y)) for i, (c, x, y) in enumerate(bow + level)], "contour_id string, seq int, x double, y double")
    got = {}
    for r in polylines.polygon_rows(rows).collect():
        got.setdefault((r.contour_id, r.y), set()).update(range(r.x_from, r.x_to + 1))
    assert got["b", 1] == {0, 1, 5, 6} and got["b", 3] == set(range(7)) and got["b", 5] == {0, 1, 5, 6}
    assert all(got["l", y] == set(range(5)) for y in range(4))


def test_points_are_not_multiplied_to_meet_the_field(spark):
    """of a point one row meets its four cells; the plan has no aggregation over points, and null places stay."""
    box = spark.createDataFrame([("a", 0, 0, 1, 4, 4)], "sample string, x0 long, y0 long, size long, x1 long, y1 long")
    field = spark.createDataFrame([("a", x, y, x + 10.0 * y) for x in range(5) for y in range(4)], "sample string, x int, y int, value double")
    points = spark.createDataFrame([("a", 1.5, 2.25), ("a", 1.5, 3.5), ("a", None, 1.0), ("b", 1.0, 1.0)], "sample string, x double, y double")
    found = harmonic.sampled(points, box, field)
    assert [r.depth for r in sorted(found.collect(), key=str)] == [24.0, None, None, None]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_do_not_grow_with_the_field(spark):
    """F4 (r04): with halos alone the same field of 5 x 5 tiles does not settle in twenty rounds."""
    rng = np.random.default_rng(3)
    lo, hi = rng.integers(0, 12, 160), rng.integers(146, 158, 160)
    state = np.zeros((162, 162), np.int64)
    for x in range(160):
        state[lo[x] : hi[x] + 1, x] = harmonic.FREE
        state[[lo[x], hi[x]], x] = harmonic.FIXED
    y, x = np.nonzero(state)
    value = np.where((state[y, x] == harmonic.FIXED) & (y > 80), 1.0, 0.0)
    cells = spark.createDataFrame([("a", int(a), int(b), int(state[b, a]), float(v)) for a, b, v in zip(x, y, value)], "sample string, x int, y int, state int, value double")
    found = harmonic.laplace(cells, 162, 162, tile=32, halo=8, max_rounds=20)
    block, start = np.zeros((164, 164), np.int64), np.zeros((164, 164))
    block[1:-1, 1:-1] = state
    start[y + 1, x + 1] = value
    want = harmonic.solved(block, start)
    assert max(abs(r.value - want[r.y + 1, r.x + 1]) for r in found.collect()) < 1e-7


def test_harmonic_depth_on_the_grid_of_the_reference(spark):
    """F4 (r04): the query solves on a grid of up to 1024 cells a side, as the reference does, not 128."""
    folder = "/root/testdata/sf0.001"
    got = {(r.x, r.y): r for r in QUERIES["harmonic_depth"](spark, folder).collect()}
    edge, cells = view(spark, folder, "v_boundary").toPandas(), view(spark, folder, "v_cells").selectExpr("cx", "cy").toPandas().drop_duplicates()
    assert len(got) == len(cells)
    lines = [edge[edge.boundary == name].groupby("x").y.median() for name in ("pia", "white")]
    every = [np.concatenate([cells.cx, *(ln.index for ln in lines)]), np.concatenate([cells.cy, *lines])]
    low, high = [int(np.floor(v.min())) for v in every], [int(np.ceil(v.max())) for v in every]
    size = -(-(max(h - lo for lo, h in zip(low, high)) + 1) // 1024)
    xs, ys = (np.unique([*range(lo, h + 1, size), h]).astype(float) for lo, h in zip(low, high))
    state, value = np.zeros((len(ys) + 2, len(xs) + 2), np.int64), np.zeros((len(ys) + 2, len(xs) + 2))
    for i, (p, w) in enumerate(zip(*(np.interp(xs, ln.index, ln) for ln in lines))):
        state[np.flatnonzero((ys >= min(p, w)) & (ys <= max(p, w))) + 1, i + 1] = harmonic.FREE
        for v, at in ((0.0, p), (1.0, w)):
            j = np.abs(ys - at).argmin() + 1
            state[j, i + 1], value[j, i + 1] = harmonic.FIXED, v
    field = harmonic.solved(state, value)
    inside, field = state[1:-1, 1:-1] != 0, field[1:-1, 1:-1].clip(0, 1)
    field = (field - field[inside].min()) / (field[inside].max() - field[inside].min())
    by_field = 0
    for x, y in cells.itertuples(index=False):
        i, j = (min(max(int(np.searchsorted(v, c, side="right")) - 1, 0), len(v) - 2) for v, c in ((xs, x), (ys, y)))
        row = got[x, y]
        assert row.by_distance == (not inside[j : j + 2, i : i + 2].all())
        if not row.by_distance:
            u, v = (x - xs[i]) / (xs[i + 1] - xs[i]), (y - ys[j]) / (ys[j + 1] - ys[j])
            assert abs(row.depth - (np.array([1 - v, v]) @ field[j : j + 2, i : i + 2] @ np.array([1 - u, u]))) < 1e-6
            by_field += 1
    assert by_field > len(cells) / 2
