"""Queries on points, masks, tiles and polylines, each with its SQL in the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import density as D
from lamina.operators import geometry as G
from lamina.operators import graph as H
from lamina.operators import polylines as P
from lamina.operators import raster as R
from lamina.operators import restoration as S
from lamina.queries import _STEP, _W
from lamina.registry import add

SIZE = 100


def _l4(pixels: DataFrame) -> DataFrame:
    return pixels.filter("gt_layer = 'L4'").select("sample", "x", "y")


# ---------------------------------------------------------------- points

add(
    "affine_points",
    "v_boundary",
    lambda b: G.inside(G.affine(b.select("boundary", "x", "y"), 0.8125, 12.4, G.pixel_offset(-37.5, 1.625)), 400, 800),
    """SELECT boundary, X AS x, Y AS y FROM (SELECT boundary, cast(round_even(x * 8125e-4 + 124e-1, 0) AS int) AS X, cast(round_even(y * 8125e-4 - 23, 0) AS int) AS Y FROM v_boundary) q
 WHERE X >= 0 AND X < 400 AND Y >= 0 AND Y < 800""",
)
add(
    "clip_points",
    "v_points2d",
    lambda p: G.inside(p.select("id", (F.col("x") * 100).alias("x"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("y") * 100).alias("y")), 50, 20).select("id", F.rint("x").cast("int").alias("x"), F.rint("y").cast("int").alias("y")),
    """SELECT id, cast(round_even(x * 100, 0) AS int) AS x, cast(round_even(y * 100, 0) AS int) AS y FROM v_points2d
 WHERE id % 5 <> 0 AND x * 100 >= 0 AND x * 100 < 50 AND y * 100 >= 0 AND y * 100 < 20""",
)
add(
    "clamp_points",
    "v_boundary",
    lambda b: G.clamped(b.select("boundary", "x", "y"), 0.1, 40, 90),
    """SELECT boundary, greatest(0, least(39, cast(round_even(x * 1e-1, 0) AS int))) AS x, greatest(0, least(89, cast(round_even(y * 1e-1, 0) AS int))) AS y FROM v_boundary""",
)
add(
    "restore_points",
    "v_boundary",
    lambda b: b.select("boundary", "x", F.round(F.col("x") / 0.4, 2).alias("full_x"), F.rint(F.col("y") / F.lit(0.4 * 0.4)).cast("long").alias("area_px"), F.round(F.col("y") * 0.1625 * 0.1625, 6).alias("area_um2")),
    """SELECT boundary, x, round(x / 4e-1, 2) AS full_x, cast(round_even(y / (4e-1 * 4e-1), 0) AS bigint) AS area_px, round(y * 1625e-4 * 1625e-4, 6) AS area_um2 FROM v_boundary""",
)
add(
    "point_heatmap",
    "v_points2d",
    lambda p: p.groupBy(F.rint(F.col("y") * 40).cast("int").alias("row"), F.rint(F.col("x") * 40).cast("int").alias("col")).agg(F.count("*").alias("n")),
    """SELECT cast(round_even(y * 40, 0) AS int) AS "row", cast(round_even(x * 40, 0) AS int) AS col, count(*) AS n FROM v_points2d GROUP BY 1, 2""",
)

# ---------------------------------------------------------------- masks

add("resize_nearest", "v_pixels", lambda p: G.shrunk(_l4(p), 2), "SELECT sample, cast(x / 2 AS int) AS x, cast(y / 2 AS int) AS y FROM v_pixels WHERE gt_layer = 'L4' AND x % 2 = 0 AND y % 2 = 0")
add(
    "resize_area",
    "v_pixels",
    lambda p: G.covered_share(_l4(p), 4),
    "SELECT sample, cast(floor(x / 4) AS int) AS x, cast(floor(y / 4) AS int) AS y, count(*) / 16e0 AS share FROM v_pixels WHERE gt_layer = 'L4' GROUP BY 1, 2, 3",
)
add(
    "restore_mask",
    "v_pixels",
    lambda p: G.enlarged(G.shrunk(_l4(p), 2), 2),
    """SELECT sample, cast(x + i.i AS int) AS x, cast(y + j.j AS int) AS y FROM v_pixels, generate_series(0, 1) AS i(i), generate_series(0, 1) AS j(j)
 WHERE gt_layer = 'L4' AND x % 2 = 0 AND y % 2 = 0""",
)
add(
    "warp_nearest",
    "v_pixels",
    lambda p: G.warped(_l4(p), 1.5, 3.0, -2.0, 140, 90),
    """SELECT p.sample, cast(X.v AS int) AS x, cast(Y.v AS int) AS y FROM generate_series(0, 139) AS X(v), generate_series(0, 89) AS Y(v), v_pixels p
 WHERE p.gt_layer = 'L4' AND p.x = round_even((X.v - 3) / 15e-1, 0) AND p.y = round_even((Y.v + 2) / 15e-1, 0)""",
)
add(
    "fill_between",
    "v_boundary",
    lambda b: G.filled(b.filter("boundary in ('L1_2', 'L3_4')").groupBy("x").agg(F.lit("s").alias("sample"), F.min("y").alias("top"), F.max("y").alias("bottom"))).groupBy("y").agg(F.count("*").alias("columns")),
    """SELECT cast(y.y AS int) AS y, count(*) AS columns FROM (SELECT x, cast(round_even(min(y), 0) AS bigint) AS t, cast(round_even(max(y), 0) AS bigint) AS b
 FROM v_boundary WHERE boundary IN ('L1_2', 'L3_4') GROUP BY 1) q, generate_series(t, b) AS y(y) GROUP BY 1""",
)
_KERNEL = "(VALUES " + ", ".join(f"({dx}, {dy})" for dx, dy in G.ellipse(5)) + ") AS k(dx, dy)"
_BY_KERNEL = f"(SELECT sample, x + dx AS x, y + dy AS y, count(*) AS n FROM v_pixels, {_KERNEL} WHERE gt_layer = 'L4' GROUP BY 1, 2, 3) q"
add("dilate_ellipse", "v_pixels", lambda p: G.spread(_l4(p), G.ellipse(5)).select("sample", "x", "y"), f"SELECT sample, x, y FROM {_BY_KERNEL}")
add("erode_ellipse", "v_pixels", lambda p: G.spread(_l4(p), G.ellipse(5)).filter(f"n = {len(G.ellipse(5))}").select("sample", "x", "y"), f"SELECT sample, x, y FROM {_BY_KERNEL} WHERE n = {len(G.ellipse(5))}")


def _morph_sql(source: str, least: int) -> str:
    return f"""SELECT sample, x + i.i AS x, y + j.j AS y FROM ({source}) s, generate_series(-1, 1) AS i(i), generate_series(-1, 1) AS j(j)
 GROUP BY 1, 2, 3 HAVING count(*) >= {least}"""


_L4_SQL = "SELECT sample, x, y FROM v_pixels WHERE gt_layer = 'L4'"
_INT = "SELECT sample, cast(x AS int) AS x, cast(y AS int) AS y FROM ({}) q"
add("open_mask", "v_pixels", lambda p: R.opened(_l4(p)), _INT.format(_morph_sql(_morph_sql(_L4_SQL, 9), 1)))
add("close_mask", "v_pixels", lambda p: R.eroded(R.dilated(_l4(p))), _INT.format(_morph_sql(_morph_sql(_L4_SQL, 1), 9)))
add(
    "margin_mask",
    "v_pixels",
    lambda p: R.eroded(_l4(p)).filter("x between 5 and 94 and y between 5 and 94"),
    f"SELECT * FROM ({_INT.format(_morph_sql(_L4_SQL, 9))}) m WHERE x BETWEEN 5 AND 94 AND y BETWEEN 5 AND 94",
)
add(
    "threshold_mask",
    "v_gray",
    lambda g: g.join(R.otsu(g), "sample").groupBy("sample", (F.col("v") > F.col("threshold") * 1.1).alias("bright")).agg(F.count("*").alias("n")),
    """WITH h AS (SELECT sample, v, count(*) AS n FROM v_gray GROUP BY 1, 2), c AS (SELECT sample, v, sum(n) OVER (PARTITION BY sample ORDER BY v) AS w0, sum(n * v) OVER (PARTITION BY sample ORDER BY v) AS s0,
 sum(n) OVER (PARTITION BY sample) AS w, sum(n * v) OVER (PARTITION BY sample) AS s FROM h),
 t AS (SELECT sample, v, cast(w0 AS double) * (w - w0) * power(cast(s0 AS double) / w0 - cast(s - s0 AS double) / (w - w0), 2) AS score FROM c WHERE w0 < w),
 o AS (SELECT sample, v AS t FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, v) AS rn FROM t) q WHERE rn = 1)
 SELECT g.sample, g.v > t * 11e-1 AS bright, count(*) AS n FROM v_gray g JOIN o USING (sample) GROUP BY 1, 2""",
)
add(
    "mask_algebra",
    "v_pixels",
    lambda p: _mask_algebra(p),
    """SELECT sample, count(*) FILTER (WHERE a AND g) AS both, count(*) FILTER (WHERE a OR g) AS either, count(*) FILTER (WHERE a AND NOT g) AS only_ours, count(*) FILTER (WHERE NOT a AND NOT g) AS neither
 FROM (SELECT sample, algo_layer = 'L4' AS a, coalesce(gt_layer = 'L4', false) AS g FROM v_pixels) q GROUP BY 1""",
)


def _mask_algebra(pixels: DataFrame) -> DataFrame:
    """Intersection, union, difference and complement of two masks, counted in one pass."""
    ours, theirs = F.col("algo_layer") == "L4", F.coalesce(F.col("gt_layer") == "L4", F.lit(False))
    sets = {"both": ours & theirs, "either": ours | theirs, "only_ours": ours & ~theirs, "neither": ~ours & ~theirs}
    return pixels.groupBy("sample").agg(*[F.count_if(v).alias(k) for k, v in sets.items()])


add(
    "overlap_code",
    "v_pixels",
    lambda p: p.groupBy("sample", F.when(F.col("algo_layer") == F.col("gt_layer"), 3).when(F.col("gt_layer").isNull(), 1).otherwise(2).alias("code")).agg(F.count("*").alias("n"), F.sum(F.abs(F.length("algo_layer") - F.coalesce(F.length("gt_layer"), F.lit(0)))).alias("difference")),
    """SELECT sample, CASE WHEN algo_layer = gt_layer THEN 3 WHEN gt_layer IS NULL THEN 1 ELSE 2 END AS code, count(*) AS n,
 cast(sum(abs(length(algo_layer) - coalesce(length(gt_layer), 0))) AS bigint) AS difference FROM v_pixels GROUP BY 1, 2""",
)
add(
    "overlay_union",
    "v_pixels",
    lambda p: _overlay_union(p),
    """SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(b.l, a.l) AS layer
 FROM (SELECT sample, x, y, algo_layer AS l FROM v_pixels WHERE algo_layer = 'L1') a
 FULL JOIN (SELECT sample, x + 3 AS x, y + 2 AS y, gt_layer AS l FROM v_pixels WHERE gt_layer = 'L1' OR gt_layer = 'L2/3') b ON a.sample = b.sample AND a.x = b.x AND a.y = b.y""",
)


def _overlay_union(pixels: DataFrame) -> DataFrame:
    """All pixels of two layers of an image, where both are the upper one's."""
    under = pixels.filter("algo_layer = 'L1'").select("sample", "x", "y", F.col("algo_layer").alias("low"))
    over = pixels.filter("gt_layer in ('L1', 'L2/3')").select("sample", (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"), F.col("gt_layer").alias("high"))
    return under.join(over, ["sample", "x", "y"], "full").select("sample", "x", "y", F.coalesce("high", "low").alias("layer"))


add("filled_pixels", "v_pixels", lambda p: p.groupBy("sample").agg(F.count("gt_layer").alias("filled"), F.count("*").alias("pixels")), "SELECT sample, count(gt_layer) AS filled, count(*) AS pixels FROM v_pixels GROUP BY 1")
_TOUCH = """m AS (SELECT sample, x, y, cast(y AS bigint) * 100 + x AS k FROM v_pixels WHERE algo_layer = 'L1'),
reach AS (SELECT sample, x, y, k FROM m UNION SELECT m.sample, m.x, m.y, r.k FROM reach r JOIN m ON m.sample = r.sample AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1),
parts AS (SELECT sample, x, y, min(k) AS component FROM reach GROUP BY 1, 2, 3)"""


def _l1(pixels: DataFrame) -> DataFrame:
    return pixels.filter("algo_layer = 'L1'").select("sample", "x", "y")


add("components", "v_pixels", lambda p: H.mask_components(_l1(p), SIZE), f"WITH RECURSIVE {_TOUCH} SELECT * FROM parts")
add(
    "largest_component",
    "v_pixels",
    lambda p: H.largest(H.mask_components(_l1(p), SIZE)),
    f"""WITH RECURSIVE {_TOUCH} SELECT sample, component, n AS pixels FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, component) AS rn
 FROM (SELECT sample, component, count(*) AS n FROM parts GROUP BY 1, 2) c) q WHERE rn = 1""",
)
add(
    "pixel_depth",
    "v_pixels",
    lambda p: _pixel_depth(p),
    """SELECT q.x, q.y, round(min(sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y))), 6) AS distance
 FROM (SELECT x, y FROM v_pixels WHERE sample = 'A' AND x % 3 = 0 AND y % 3 = 0) q, (SELECT x, y FROM v_pixels WHERE sample = 'A' AND gt_layer = 'L1' AND x % 7 = 0) s GROUP BY 1, 2""",
    "distance",
)


def _pixel_depth(pixels: DataFrame) -> DataFrame:
    """Exact distance of each pixel of a coarse raster to the nearest seed of the upper layer."""
    one = pixels.filter("sample = 'A'")
    grid = one.filter("x % 3 = 0 and y % 3 = 0").select((F.col("y") * SIZE + F.col("x")).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    seeds = one.filter("gt_layer = 'L1' and x % 7 = 0").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return D.nearest_distance(grid, seeds).select((F.col("id") % SIZE).cast("int").alias("x"), F.floor(F.col("id") / SIZE).cast("int").alias("y"), "distance")


# ---------------------------------------------------------------- tiles and labels

add(
    "tile_halo",
    "v_cells",
    lambda c: G.halo_tiles(c, 256, 32).groupBy("sample", "tile_r", "tile_c").agg(F.count("*").alias("n")),
    """SELECT sample, cast(floor(cy / 192) AS bigint) + i.i AS tile_r, cast(floor(cx / 192) AS bigint) + j.j AS tile_c, count(*) AS n
 FROM v_cells, generate_series(-1, 1) AS i(i), generate_series(-1, 1) AS j(j)
 WHERE (i.i = 0 OR (i.i = -1 AND cy < floor(cy / 192) * 192 + 32 AND cy >= 192) OR (i.i = 1 AND cy >= (floor(cy / 192) + 1) * 192 - 32))
 AND (j.j = 0 OR (j.j = -1 AND cx < floor(cx / 192) * 192 + 32 AND cx >= 192) OR (j.j = 1 AND cx >= (floor(cx / 192) + 1) * 192 - 32)) GROUP BY 1, 2, 3""",
)
add(
    "tile_pruning",
    "v_cells v_pixels",
    lambda c, p: _tile_pruning(c, p),
    """WITH t AS (SELECT DISTINCT sample, cast(floor(x / 8) AS bigint) AS c, cast(floor(y / 8) AS bigint) AS r FROM v_pixels WHERE gt_layer = 'L4')
 SELECT q.sample, tile_r, tile_c, count(*) AS n FROM (SELECT sample, cast(floor(cy / 8) AS bigint) AS tile_r, cast(floor(cx / 8) AS bigint) AS tile_c FROM v_cells) q
 JOIN t ON t.sample = q.sample AND t.r = tile_r AND t.c = tile_c GROUP BY 1, 2, 3""",
)


def _tile_pruning(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Cells by tile, of the tiles that hold a pixel of the mask only."""
    used = pixels.filter("gt_layer = 'L4'").select("sample", F.floor(F.col("y") / 8).alias("tile_r"), F.floor(F.col("x") / 8).alias("tile_c")).distinct()
    counts = cells.groupBy("sample", F.floor(F.col("cy") / 8).alias("tile_r"), F.floor(F.col("cx") / 8).alias("tile_c")).agg(F.count("*").alias("n"))
    return counts.join(used, ["sample", "tile_r", "tile_c"], "left_semi")


def _first_claim(cells: DataFrame) -> DataFrame:
    """One cell a pixel, the first by tile; cells numbered in the order of their tiles."""
    tiled = cells.select("sample", F.floor(F.col("cx") / 2).alias("px"), F.floor(F.col("cy") / 4).alias("py"), "area_px", F.floor(F.col("cy") / 192).alias("tile_r"), F.floor(F.col("cx") / 192).alias("tile_c"))
    kept = G.first_claims(tiled, ["sample", "px", "py"], ["tile_r", "tile_c", "area_px"])
    return G.numbered(kept, "sample", ["tile_r", "tile_c"], ["py", "px"]).select("sample", "px", "py", "area_px", "id")


add(
    "first_claim",
    "v_cells",
    _first_claim,
    """SELECT sample, px, py, area_px, row_number() OVER (PARTITION BY sample ORDER BY tile_r, tile_c, py, px) AS id FROM (SELECT *, row_number() OVER (PARTITION BY sample, px, py ORDER BY tile_r, tile_c, area_px) AS rn
 FROM (SELECT sample, cast(floor(cx / 2) AS bigint) AS px, cast(floor(cy / 4) AS bigint) AS py, area_px, cast(floor(cy / 192) AS bigint) AS tile_r, cast(floor(cx / 192) AS bigint) AS tile_c FROM v_cells) t) q WHERE rn = 1""",
)
add(
    "label_filter",
    "v_labels",
    G.labels,
    """SELECT sample, label, area, round(cx, 6) AS cx, round(cy, 6) AS cy, cast(row_number() OVER (PARTITION BY sample ORDER BY label) AS int) AS number
 FROM (SELECT *, avg(area) OVER (PARTITION BY sample) AS mean FROM (SELECT sample, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM v_labels GROUP BY 1, 2) a) q WHERE area >= 5e-1 * mean""",
    "cx cy",
)
add(
    "throughput",
    "v_cells",
    lambda c: c.groupBy("sample").agg(F.count("*").alias("cells"), F.countDistinct(F.floor(F.col("cy") / 192), F.floor(F.col("cx") / 192)).alias("tiles"), F.sum("area_px").alias("work")).select("sample", "cells", "tiles", F.coalesce(F.col("work") / F.nullif(F.col("tiles"), F.lit(0)) / 1000, F.lit(0.0)).alias("seconds_a_tile"), F.coalesce(F.col("cells") / F.nullif(F.col("work") / 1000, F.lit(0.0)), F.lit(0.0)).alias("cells_a_second")),
    """SELECT sample, cells, tiles, round(coalesce(work / nullif(tiles, 0) / 1000, 0), 6) AS seconds_a_tile, round(coalesce(cells / nullif(work / 1000, 0), 0), 6) AS cells_a_second
 FROM (SELECT sample, count(*) AS cells, count(DISTINCT (floor(cy / 192), floor(cx / 192))) AS tiles, cast(sum(area_px) AS double) AS work FROM v_cells GROUP BY 1) q""",
    "seconds_a_tile cells_a_second",
)

# ---------------------------------------------------------------- polylines

_RING = f"""SELECT contour_id, count(*) AS points, sum(step) AS length, abs(sum(x * y1 - x1 * y)) / 2 AS area FROM (SELECT contour_id, x, y, {_STEP} AS step,
 coalesce(lead(x) {_W}, first_value(x) {_W}) AS x1, coalesce(lead(y) {_W}, first_value(y) {_W}) AS y1 FROM v_vertices) q GROUP BY 1"""
add("contour_measures", "v_vertices", lambda v: P.length_and_area(v), f"SELECT contour_id, points, round(length, 6) AS length, round(area, 6) AS area FROM ({_RING}) m", "length area")
add(
    "longest_contour",
    "v_vertices",
    lambda v: P.length_and_area(v).filter("length >= 50 and points >= 4").groupBy((F.col("contour_id") % 10).alias("part")).agg(F.max_by("contour_id", "length").alias("longest"), F.max_by("contour_id", "area").alias("widest")),
    f"SELECT contour_id % 10 AS part, arg_max(contour_id, length) AS longest, arg_max(contour_id, area) AS widest FROM ({_RING}) m WHERE length >= 50 AND points >= 4 GROUP BY 1",
)
_ISLANDS = f"""(SELECT *, min(seq) OVER (PARTITION BY contour_id, gap) AS run, count(*) OVER (PARTITION BY contour_id, gap) AS size, row_number() OVER (PARTITION BY contour_id, gap ORDER BY seq) - 1 AS place
 FROM (SELECT *, seq - row_number() {_W} AS gap FROM v_vertices WHERE y >= 20 AND y <= 200) g) i"""
_IN = lambda: (F.col("y") >= 20) & (F.col("y") <= 200)
add("in_bounds_runs", "v_vertices", lambda v: P.runs_within(v, _IN(), 2).groupBy("contour_id", "run").agg(F.count("*").alias("n")), f"SELECT contour_id, run, count(*) AS n FROM {_ISLANDS} WHERE size >= 2 GROUP BY 1, 2")
add("valid_dashes", "v_vertices", lambda v: P.runs_within(v, _IN(), 4).filter("place % 5 < 3").select("contour_id", "seq"), f"SELECT contour_id, seq FROM {_ISLANDS} WHERE size >= 4 AND place % 5 < 3")


def _cut(source: str) -> str:
    w = "OVER (PARTITION BY contour_id ORDER BY seq)"
    parts = f"""SELECT contour_id, seq, 0 AS part, x, y FROM e WHERE first UNION ALL SELECT contour_id, seq, 1, x * 75e-2 + x1 * 25e-2, y * 75e-2 + y1 * 25e-2 FROM e WHERE x1 IS NOT NULL
 UNION ALL SELECT contour_id, seq, 2, x * 25e-2 + x1 * 75e-2, y * 25e-2 + y1 * 75e-2 FROM e WHERE x1 IS NOT NULL UNION ALL SELECT contour_id, seq, 3, x, y FROM e WHERE x1 IS NULL"""
    return f"""SELECT contour_id, row_number() OVER (PARTITION BY contour_id ORDER BY seq, part) - 1 AS seq, x, y FROM (WITH e AS (SELECT contour_id, seq, x, y, lead(x) {w} AS x1, lead(y) {w} AS y1, row_number() {w} = 1 AS first FROM ({source}) s) {parts}) p"""


_MANY = "SELECT contour_id, seq, x, y FROM (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n FROM v_vertices) c WHERE n >= 3"
add(
    "chaikin_rounds",
    "v_vertices",
    lambda v: P.chaikin_rounds(v, 2).select("contour_id", F.col("seq").cast("long").alias("seq"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
    f"""SELECT contour_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM ({_cut(_cut(_MANY))}) t
 UNION ALL SELECT contour_id, seq, round(x, 6), round(y, 6) FROM (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n FROM v_vertices) c WHERE n < 3""",
)


def _to_next(vertices: DataFrame) -> DataFrame:
    """Distance of each vertex to the line of the contour after its own."""
    lines = vertices.select((F.col("contour_id") - 1).alias("pair"), "contour_id", "seq", "x", "y")
    points = vertices.select(F.col("contour_id").alias("pair"), "seq", "x", "y", "event_type")
    return P.distance_to_lines(points, lines, ["pair"])


_AWAY = f"""(WITH s AS (SELECT contour_id, x, y, x1 - x AS dx, y1 - y AS dy FROM (SELECT contour_id, x, y, lead(x) {_W} AS x1, lead(y) {_W} AS y1 FROM v_vertices) l WHERE x1 IS NOT NULL)
 SELECT contour_id, seq, min(sqrt(power(px - x - t * dx, 2) + power(py - y - t * dy, 2))) AS distance FROM (SELECT v.contour_id, v.seq, v.x AS px, v.y AS py, s.x, s.y, dx, dy,
 greatest(0, least(1, coalesce(((v.x - s.x) * dx + (v.y - s.y) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM v_vertices v JOIN s ON s.contour_id = v.contour_id + 1) q GROUP BY 1, 2) a"""
add("line_distance", "v_vertices", lambda v: _to_next(v).select(F.col("pair").alias("contour_id"), "seq", "distance"), f"SELECT contour_id, seq, round(distance, 6) AS distance FROM {_AWAY}", "distance")


_CLOSED = f"""(WITH s AS (SELECT contour_id, x, y, x1, y1 FROM (SELECT contour_id, x, y, coalesce(lead(x) {_W}, first_value(x) {_W}) AS x1, coalesce(lead(y) {_W}, first_value(y) {_W}) AS y1 FROM v_vertices) l),
 d AS (SELECT v.contour_id, v.seq, v.x AS px, v.y AS py, s.*, x1 - s.x AS dx, y1 - s.y AS dy FROM v_vertices v JOIN s ON s.contour_id = v.contour_id + 1),
 t AS (SELECT *, greatest(0, least(1, coalesce(((px - x) * dx + (py - y) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM d)
 SELECT contour_id, seq, min(sqrt(power(px - x - t * dx, 2) + power(py - y - t * dy, 2))) * CASE WHEN count(*) FILTER (WHERE (y > py) <> (y1 > py) AND px < x + (py - y) * dx / nullif(dy, 0)) % 2 = 1 THEN 1 ELSE -1 END AS distance FROM t GROUP BY 1, 2) a"""


def _signed_to_next(vertices: DataFrame) -> DataFrame:
    """Signed distance of each vertex to the closed contour after its own."""
    lines = vertices.select((F.col("contour_id") - 1).alias("pair"), "contour_id", "seq", "x", "y")
    points = vertices.select(F.col("contour_id").alias("pair"), "seq", "x", "y")
    return P.signed_distances(points, lines, ["pair"]).select(F.col("pair").alias("contour_id"), "seq", (F.round("distance", 6) + 0.0).alias("distance"))


add("signed_distance", "v_vertices", _signed_to_next, f"SELECT contour_id, seq, round(distance, 6) + 0e0 AS distance FROM {_CLOSED}")


def _split_by_distance(vertices: DataFrame) -> DataFrame:
    """Runs of vertices far from (GM, three at least) and near to (WM, two at least) the next contour's line."""
    far = F.when(F.col("distance") > 10, "GM").otherwise("WM")
    classed = _to_next(vertices).select(F.col("pair").alias("contour_id"), "seq", far.alias("side"))
    return P.runs_by_class(classed, "side", 2).filter("side = 'WM' or n >= 3")


add(
    "split_by_distance",
    "v_vertices",
    _split_by_distance,
    f"""SELECT contour_id, side, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM (SELECT *, sum(s) {_W} AS run FROM (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) {_W} THEN 1 ELSE 0 END AS s
 FROM (SELECT contour_id, seq, CASE WHEN distance > 10 THEN 'GM' ELSE 'WM' END AS side FROM {_AWAY}) c) d) e GROUP BY contour_id, run, side HAVING count(*) >= CASE side WHEN 'WM' THEN 2 ELSE 3 END""",
)


def _restored(vertices: DataFrame) -> DataFrame:
    """Boundary restoration: scale up, resample, cut corners, smooth, resample, round, clip, drop repeats, keep two points or more."""
    return S.restored(vertices, 0.4, 4000, 4000, 4.0)


add("boundary_restoration", "v_vertices", _restored, None)
add(
    "left_to_right",
    "v_vertices",
    lambda v: v.filter("y > 0").select("contour_id", "seq", F.row_number().over(P.Window.partitionBy("contour_id").orderBy("y", "seq")).alias("place")),
    "SELECT contour_id, seq, cast(row_number() OVER (PARTITION BY contour_id ORDER BY y, seq) AS int) AS place FROM v_vertices WHERE y > 0",
)
