"""Queries on boundaries, colours and layers, each with its SQL in the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import boundaries as B
from lamina.operators import colours as C
from lamina.operators import density as D
from lamina.operators import geometry as G
from lamina.queries import _CURVE, _GRAD
from lamina.operators.staging import kept
from lamina.registry import add

SIZE = 100


def _mask(pixels: DataFrame, which: str) -> DataFrame:
    return pixels.filter(F.col(which).isNotNull()).select("sample", F.col(which).alias("layer"), "x", "y")


def _edges_sql(which: str, name: str) -> str:
    full = "(3 - CASE WHEN x IN (0, 99) THEN 1 ELSE 0 END) * (3 - CASE WHEN y IN (0, 99) THEN 1 ELSE 0 END)"
    return f"""{name}_n AS (SELECT sample, {which} AS layer, x + i.i AS x, y + j.j AS y, count(*) AS n
 FROM v_pixels, generate_series(-1, 1) AS i(i), generate_series(-1, 1) AS j(j) WHERE {which} IS NOT NULL GROUP BY 1, 2, 3, 4),
{name} AS (SELECT sample, layer, cast(x AS int) AS x, cast(min(y) AS int) AS "top", cast(max(y) AS int) AS bottom
 FROM {name}_n WHERE x BETWEEN 0 AND 99 AND y BETWEEN 0 AND 99 AND n < {full} GROUP BY 1, 2, 3)"""


_BOTH = f"WITH {_edges_sql('algo_layer', 'ours')}, {_edges_sql('gt_layer', 'theirs')} "
add(
    "column_edges",
    "v_pixels",
    lambda p: B.column_edges(_mask(p, "algo_layer"), SIZE, SIZE),
    f"WITH {_edges_sql('algo_layer', 'ours')} SELECT * FROM ours",
)
add(
    "edge_errors",
    "v_pixels",
    lambda p: B.edge_errors(B.column_edges(_mask(p, "algo_layer"), SIZE, SIZE), B.column_edges(_mask(p, "gt_layer"), SIZE, SIZE)),
    _BOTH
    + """SELECT a.sample, a.layer, count(*) AS columns, round(avg(abs(a.top - b.top)), 6) AS top_error, round(avg(abs(a.bottom - b.bottom)), 6) AS bottom_error,
 round((avg(abs(a.top - b.top)) + avg(abs(a.bottom - b.bottom))) / 2, 6) AS error_px FROM ours a JOIN theirs b USING (sample, layer, x) GROUP BY 1, 2""",
    "top_error bottom_error error_px",
)
add(
    "common_columns",
    "v_pixels",
    lambda p: _mask(p, "algo_layer").select("sample", "layer", "x").intersect(_mask(p, "gt_layer").select("sample", "layer", "x")).groupBy("sample", "layer").agg(F.count("*").alias("columns")),
    """SELECT sample, layer, count(*) AS columns FROM (SELECT sample, algo_layer AS layer, x FROM v_pixels
 INTERSECT SELECT sample, gt_layer, x FROM v_pixels WHERE gt_layer IS NOT NULL) q GROUP BY 1, 2""",
)


def _every_seventh(boundary: DataFrame) -> DataFrame:
    return boundary.filter("x % 7 = 0").select("boundary", "x", F.col("y_gt").alias("y"))


_LINE = """WITH k AS (SELECT boundary, x, median(y_gt) AS y FROM v_boundary WHERE x % 7 = 0 GROUP BY 1, 2),
o AS (SELECT q.boundary, q.x, k.y, CASE WHEN k.y IS NOT NULL THEN q.x END AS kx FROM (SELECT DISTINCT boundary, x FROM v_boundary) q LEFT JOIN k USING (boundary, x)),
w AS (SELECT boundary, x, last_value(kx IGNORE NULLS) OVER b AS x0, last_value(y IGNORE NULLS) OVER b AS y0, first_value(kx IGNORE NULLS) OVER a AS x1, first_value(y IGNORE NULLS) OVER a AS y1
 FROM o WINDOW b AS (PARTITION BY boundary ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY boundary ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
line AS (SELECT boundary, x, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (x - x0) / cast(x1 - x0 AS double) * (y1 - y0) END AS y FROM w)"""
add(
    "gt_interpolation",
    "v_boundary",
    lambda b: B.interpolated(_every_seventh(b), b.select("boundary", "x"), "boundary"),
    _LINE + " SELECT boundary, x, round(y, 6) AS y FROM line",
    "y",
)
add(
    "boundary_mae",
    "v_boundary",
    lambda b: B.mean_absolute_error(b.select("boundary", "x", "y"), _every_seventh(b), "boundary"),
    _LINE
    + """, m AS (SELECT boundary, x, median(y) AS m FROM v_boundary GROUP BY 1, 2)
 SELECT boundary, round(avg(abs(m - y)), 6) AS mae FROM m JOIN line USING (boundary, x) GROUP BY 1""",
    "mae",
)


def _mae_improvement(b: DataFrame) -> DataFrame:
    """How much nearer to the annotated line the boundary is after half of its offset is taken away."""
    moved = b.select("boundary", "x", "y", ((F.col("y") + F.col("y_gt")) / 2).alias("moved"))
    errors = B.mean_absolute_error(moved, _every_seventh(b), "boundary", {"y": "mae_coarse", "moved": "mae_refined"})
    return errors.withColumn("improvement", B.improvement_percent(F.col("mae_coarse"), F.col("mae_refined")))


add(
    "mae_improvement",
    "v_boundary",
    _mae_improvement,
    _LINE
    + """, m AS (SELECT boundary, x, median(y) AS m, median((y + y_gt) / 2) AS n FROM v_boundary GROUP BY 1, 2),
e AS (SELECT boundary, avg(abs(m - y)) AS c, avg(abs(n - y)) AS r FROM m JOIN line USING (boundary, x) GROUP BY 1)
 SELECT boundary, round(c, 6) AS mae_coarse, round(r, 6) AS mae_refined, round((c - r) / greatest(c, 1e-8) * 100, 6) AS improvement FROM e""",
    "mae_coarse mae_refined improvement",
)
add(
    "column_medians",
    "v_boundary",
    lambda b: B.column_medians(b, "boundary", F.floor(F.col("x") / 3).cast("int")),
    "SELECT boundary, cast(floor(x / 3) AS int) AS x, median(y) AS y FROM v_boundary GROUP BY 1, 2",
)
add(
    "distinct_columns",
    "v_boundary",
    lambda b: b.select("boundary", F.floor(F.col("x") / 2).cast("int").alias("x")).distinct(),
    "SELECT DISTINCT boundary, cast(floor(x / 2) AS int) AS x FROM v_boundary",
)

# ---------------------------------------------------------------- colours

_NEAR = "CASE " + " ".join(
    f"WHEN abs(b - {b}) <= 15 AND abs(g - {g}) <= 15 AND abs(r - {r}) <= 15 THEN '{n}'" for n, b, g, r in C.PALETTE
) + " END"
add(
    "palette_match",
    "v_colours",
    C.palette_layers,
    f"SELECT sample, layer, count(*) AS pixels FROM (SELECT sample, {_NEAR} AS layer FROM v_colours WHERE greatest(b, g, r) > 10) q WHERE layer IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 100",
)
_BUCKETS = """SELECT sample, cast(floor(b / 20) AS bigint) AS b_bucket, cast(floor(g / 20) AS bigint) AS g_bucket, cast(floor(r / 20) AS bigint) AS r_bucket,
 cast(trunc(avg(b)) AS int) AS b, cast(trunc(avg(g)) AS int) AS g, cast(trunc(avg(r)) AS int) AS r, avg(y) AS mean_y, count(*) AS pixels
 FROM v_colours WHERE greatest(b, g, r) > 10 GROUP BY 1, 2, 3, 4 HAVING greatest(trunc(avg(b)), trunc(avg(g)), trunc(avg(r))) >= 20"""
add("colour_buckets", "v_colours", C.buckets, f"SELECT * REPLACE (round(mean_y, 6) AS mean_y) FROM ({_BUCKETS}) q", "mean_y")
add(
    "colour_layers",
    "v_colours",
    lambda p: C.layers_by_position(C.buckets(p, 64)).select("sample", "layer", "place", "b", "g", "r", "mean_y", "pixels"),
    f"""SELECT sample, (['L1', 'L2/3', 'L4', 'L5/6'])[place] AS layer, cast(place AS int) AS place, b, g, r, round(mean_y, 6) AS mean_y, pixels
 FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY mean_y, b_bucket, g_bucket, r_bucket) AS place FROM ({_BUCKETS.replace("/ 20", "/ 64")}) b WHERE pixels > 100) q WHERE place <= 4""",
    "mean_y",
)


def _layer_colours(pixels: DataFrame) -> DataFrame:
    """Depth of a pixel to its layer's colour, inside the annotated region."""
    depth = F.col("y") / F.lit(float(SIZE))
    name = F.coalesce(*[F.when((depth >= s) & (depth < e), n) for n, s, e in D.DEFAULT_LAYERS])
    roi = pixels.filter("gt_layer is not null").select("sample", "x", "y")
    made = C.coloured(pixels.select("sample", "x", "y", name.alias("layer")).join(roi, ["sample", "x", "y"], "left_semi"))
    return made.groupBy("sample", "layer", "b", "g", "r").agg(F.count("*").alias("pixels"))


add(
    "layer_colours",
    "v_pixels",
    _layer_colours,
    """SELECT sample, layer, CASE WHEN layer IN ('L1', 'L5/6') THEN 255 ELSE 100 END AS b, CASE WHEN layer IN ('L2/3', 'L5/6') THEN 255 ELSE 100 END AS g,
 CASE WHEN layer = 'L4' THEN 255 ELSE 100 END AS r, count(*) AS pixels FROM (SELECT sample, CASE WHEN y < 7 THEN 'L1' WHEN y < 35 THEN 'L2/3' WHEN y < 50 THEN 'L4' ELSE 'L5/6' END AS layer
 FROM v_pixels WHERE gt_layer IS NOT NULL) q GROUP BY 1, 2, 3, 4, 5""",
)
_HIST = lambda g: g.groupBy("sample", "v").agg(F.count("*").alias("n"))
add(
    "gray_stretch",
    "v_gray",
    lambda g: C.stretched(_HIST(g)),
    """SELECT sample, v, n, cast(coalesce(round_even((v - lo) / cast(nullif(hi - lo, 0) AS double) * 255, 0), 0) AS int) AS stretched
 FROM (SELECT sample, v, count(*) AS n, min(v) OVER (PARTITION BY sample) AS lo, max(v) OVER (PARTITION BY sample) AS hi FROM v_gray GROUP BY 1, 2) q""",
)
_STOPS = ((0, 0), (64, 32), (128, 200), (255, 255))
add(
    "gray_lut",
    "v_gray",
    lambda g: g.groupBy("sample", C.gray_curve(F.col("v"), _STOPS).alias("gray")).agg(F.count("*").alias("n")),
    """SELECT sample, cast(round_even(CASE WHEN v <= 0 THEN 0e0 WHEN v <= 64 THEN v * 5e-1 WHEN v <= 128 THEN 32 + (v - 64) * 2.625e0 WHEN v <= 255 THEN 200 + (v - 128) * (55e0 / 127) ELSE 255e0 END, 0) AS int) AS gray,
 count(*) AS n FROM v_gray GROUP BY 1, 2""",
)
add(
    "gray_contrast",
    "v_gray",
    lambda g: g.groupBy("sample", C.contrast(F.col("v"), 1.5, -40.0).alias("gray")).agg(F.count("*").alias("n")),
    "SELECT sample, cast(least(255, round_even(abs(v * 1.5e0 - 40), 0)) AS int) AS gray, count(*) AS n FROM v_gray GROUP BY 1, 2",
)

# ---------------------------------------------------------------- curves and layers

add(
    "equal_bins",
    "v_cells",
    lambda c: D.equal_bins(c, 20),
    """SELECT sample, cast(least(19, floor(depth * 20)) AS int) AS bin, count(*) AS n, round(avg(density), 6) AS density
 FROM v_cells WHERE depth >= 0 AND depth <= 1 GROUP BY 1, 2""",
    "density",
)
add(
    "search_range",
    "v_cells",
    lambda c: D.search_range(D.curve(c)).select("sample", "bin", "density"),
    _CURVE + " SELECT sample, bin, round(density, 6) AS density FROM curve WHERE center >= 5e-2 AND center <= 8e-1",
    "density",
)
add(
    "default_layers_five",
    "v_cells",
    lambda c: D.layers_of(D.curve(c), D.FIVE_LAYERS),
    _CURVE
    + """ SELECT s.sample, l.layer, l.s AS start, l.e AS "end", round(coalesce(avg(c.density), 0), 6) AS mean_density FROM (SELECT DISTINCT sample FROM v_cells) s
 CROSS JOIN (VALUES ('L1', 0e0, 1e-1), ('L2', 1e-1, 3e-1), ('L3', 3e-1, 5e-1), ('L4', 5e-1, 7e-1), ('L5/6', 7e-1, 1e0)) AS l(layer, s, e)
 LEFT JOIN curve c ON c.sample = s.sample AND c.center >= l.s AND c.center <= l.e GROUP BY 1, 2, 3, 4""",
    "mean_density",
)
def _curve_arrays(points: DataFrame) -> DataFrame:
    """Span, place of the greatest value and sum of each curve as an array."""
    whole = points.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("bin", "density"))).alias("c"))
    d = F.transform("c", lambda p: p["density"])
    total = F.aggregate(d, F.lit(0.0), lambda a, v: a + v)
    return whole.select("sample", (F.array_max(d) - F.array_min(d)).alias("span"), (F.array_position(d, F.array_max(d)) - 1).cast("int").alias("top_bin"), total.alias("total"))


add(
    "curve_arrays",
    "v_cells",
    lambda c: _curve_arrays(D.curve(c)),
    _CURVE
    + """ SELECT sample, round(max(density) - min(density), 6) AS span, cast(arg_max(bin, density) AS int) AS top_bin, round(sum(density), 6) AS total
 FROM curve GROUP BY 1""",
    "span total",
)

#: Two tallest peaks between depths 0.05 and 0.8, at least three bins apart, and the turns of the curvature.
PEAK_BOUNDS_SQL = (
    _GRAD
    + """, bends AS (SELECT sample, bin, CASE WHEN lag(slope) OVER w IS NULL THEN (lead(slope) OVER w - slope) / 2e-2 WHEN lead(slope) OVER w IS NULL THEN (slope - lag(slope) OVER w) / 2e-2
 ELSE (lead(slope) OVER w - lag(slope) OVER w) / 4e-2 END AS bend FROM g WINDOW w AS (PARTITION BY sample ORDER BY bin)),
z AS (SELECT sample, (bin + 5e-1) * 2e-2 + abs(bend) / (abs(bend) + abs(after) + 1e-8) * 2e-2 AS d FROM (SELECT *, lead(bend) OVER (PARTITION BY sample ORDER BY bin) AS after FROM bends) q WHERE bend * after < 0),
s AS (SELECT sample, bin, smooth, max(smooth) OVER (PARTITION BY sample) - min(smooth) OVER (PARTITION BY sample) AS span FROM smooth WHERE (bin + 5e-1) * 2e-2 BETWEEN 5e-2 AND 8e-1),
t AS (SELECT *, lag(smooth) OVER w AS a, lead(smooth) OVER w AS b FROM s WINDOW w AS (PARTITION BY sample ORDER BY bin)),
p AS (SELECT sample, bin, smooth AS h, span, smooth - greatest(
 (SELECT min(s.smooth) FROM s WHERE s.sample = t.sample AND s.bin < t.bin AND NOT EXISTS (SELECT 1 FROM s h WHERE h.sample = t.sample AND h.smooth > t.smooth AND h.bin >= s.bin AND h.bin < t.bin)),
 (SELECT min(s.smooth) FROM s WHERE s.sample = t.sample AND s.bin > t.bin AND NOT EXISTS (SELECT 1 FROM s h WHERE h.sample = t.sample AND h.smooth > t.smooth AND h.bin <= s.bin AND h.bin > t.bin))) AS prominence
 FROM t WHERE smooth > a AND smooth > b),
apart AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.sample = p.sample AND o.h > p.h AND abs(o.bin - p.bin) < 3)),
strong AS (SELECT *, sum(CASE WHEN prominence >= span * 1e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample) AS good FROM apart),
two AS (SELECT sample, min(bin) AS lo, max(bin) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY h DESC, bin DESC) AS rn FROM strong WHERE good < 2 OR prominence >= span * 1e-1) q WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2),
pq AS (SELECT sample, (lo + 5e-1) * 2e-2 AS p, (hi + 5e-1) * 2e-2 AS q FROM two),
c2 AS (SELECT pq.*, (SELECT arg_min(d, abs(d - (p + q) / 2 * 7e-1)) FROM z WHERE z.sample = pq.sample AND d > p AND d < q) AS m FROM pq),
c AS (SELECT sample, coalesce((SELECT max(d) FROM z WHERE z.sample = c2.sample AND d < p), p * 5e-1) AS c1, coalesce(m, p + (q - p) * 33e-2) AS c2,
 CASE WHEN m IS NULL THEN p + (q - p) * 67e-2 ELSE coalesce((SELECT arg_min(d, abs(d - (p + q) / 2 * 13e-1)) FROM z WHERE z.sample = c2.sample AND d > m AND d < q), (m + q) / 2) END AS c3,
 coalesce((SELECT min(d) FROM z WHERE z.sample = c2.sample AND d > q), q + (1 - q) * 4e-1) AS c4 FROM c2),
r1 AS (SELECT *, CASE WHEN c1 <= 0 THEN 2e-2 ELSE c1 END AS r1 FROM c), r2 AS (SELECT *, CASE WHEN c2 <= r1 THEN r1 + 2e-2 ELSE c2 END AS r2 FROM r1),
r3 AS (SELECT *, CASE WHEN c3 <= r2 THEN r2 + 2e-2 ELSE c3 END AS r3 FROM r2), r4 AS (SELECT *, CASE WHEN c4 <= r3 THEN r3 + 2e-2 ELSE c4 END AS r4 FROM r3),
bounds AS (SELECT sample, 0e0 AS b0, least(1, r1) AS b1, least(1, r2) AS b2, least(1, r3) AS b3, least(1, r4) AS b4, 1e0 AS b5 FROM r4)"""
)
_LAYERS = PEAK_BOUNDS_SQL + """, layers AS (SELECT sample, 'L1' AS layer, b0 AS s, b1 AS e FROM bounds UNION ALL SELECT sample, 'L2/3', b1, b3 FROM bounds
 UNION ALL SELECT sample, 'L4', b3, b4 FROM bounds UNION ALL SELECT sample, 'L5/6', b4, b5 FROM bounds)"""


def _bounds(cells: DataFrame) -> DataFrame:
    """Bounds b0 to b5 of each sample from the peaks of its own smoothed curve."""
    curve = D.smoothed(D.curve(cells))
    bend = D.gradient(D.gradient(curve, "smooth", "slope"), "slope", "bend")
    return D.peak_bounds(curve, "smooth", D.crossings(bend, "bend"))


add(
    "peak_bounds",
    "v_cells",
    _bounds,
    PEAK_BOUNDS_SQL + " SELECT sample, " + ", ".join(f"round(b{i}, 6) AS b{i}" for i in range(6)) + " FROM bounds",
    "b0 b1 b2 b3 b4 b5",
)
add(
    "peak_layers",
    "v_cells",
    lambda c: D.mean_density(D.bounds_to_layers(_bounds(c)), D.curve(c)),
    _LAYERS
    + """ SELECT l.sample, l.layer, round(l.s, 6) AS start, round(l.e, 6) AS "end", round(coalesce(avg(c.density), 0), 6) AS mean_density
 FROM layers l LEFT JOIN curve c ON c.sample = l.sample AND c.center >= l.s AND c.center <= l.e GROUP BY l.sample, l.layer, l.s, l.e""",
    "start end mean_density",
)
add(
    "inner_boundaries",
    "v_cells",
    lambda c: B.inner_boundaries(D.bounds_to_layers(_bounds(c))),
    _LAYERS
    + """ SELECT sample, CASE layer WHEN 'L1' THEN 'L1_2' WHEN 'L2/3' THEN 'L3_4' ELSE 'L4_5' END AS boundary, round(e, 6) AS depth
 FROM layers WHERE layer <> 'L5/6' AND e > 0 AND e < 1""",
    "depth",
)


def _layer_analysis(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Stage: cells in the annotated region, their curve, its peaks, layers with mean density; default layers without two peaks.

    Cells of a pixel and a bin are summed before they meet the region, so no more rows meet it than pixels times bins.
    """
    roi = pixels.filter("gt_layer is not null").select("sample", "x", "y").distinct()
    keyed = cells.withColumns({"x": F.floor("cx").cast("int") % SIZE, "y": F.floor(F.col("cy") / 10).cast("int") % SIZE})
    summed = keyed.groupBy("sample", "x", "y", D.bin_of(F.col("depth")).alias("bin")).agg(F.sum("density").alias("total"), F.count("density").alias("n"))
    curve = kept(D.curve_of_sums(summed.join(roi, ["sample", "x", "y"], "left_semi")), "curve")
    found = D.mean_density(D.bounds_to_layers(_bounds_of_curve(curve)), curve)
    usual = D.layers_of(curve).join(found.select("sample").distinct(), "sample", "left_anti")
    return found.unionByName(usual)


def _bounds_of_curve(curve: DataFrame) -> DataFrame:
    smooth = D.smoothed(curve)
    bend = D.gradient(D.gradient(smooth, "smooth", "slope"), "slope", "bend")
    return D.peak_bounds(smooth, "smooth", D.crossings(bend, "bend"))


_ROI_CELLS = """(SELECT c.* FROM v_cells c WHERE EXISTS (SELECT 1 FROM v_pixels p WHERE p.gt_layer IS NOT NULL AND p.sample = c.sample
 AND p.x = cast(floor(c.cx) AS int) % 100 AND p.y = cast(floor(c.cy / 10) AS int) % 100))"""
add(
    "layer_analysis",
    "v_cells v_pixels",
    _layer_analysis,
    (_LAYERS + """, usual AS (SELECT s.sample, l.layer, l.s, l.e FROM (SELECT DISTINCT sample FROM curve) s
 CROSS JOIN (VALUES ('L1', 0e0, 7e-2), ('L2/3', 7e-2, 35e-2), ('L4', 35e-2, 5e-1), ('L5/6', 5e-1, 1e0)) AS l(layer, s, e) WHERE s.sample NOT IN (SELECT sample FROM bounds)),
every AS (SELECT * FROM layers UNION ALL SELECT * FROM usual)
 SELECT l.sample, l.layer, round(l.s, 6) AS start, round(l.e, 6) AS "end", round(coalesce(avg(c.density), 0), 6) AS mean_density
 FROM every l LEFT JOIN curve c ON c.sample = l.sample AND c.center >= l.s AND c.center <= l.e GROUP BY l.sample, l.layer, l.s, l.e""").replace("FROM v_cells", f"FROM {_ROI_CELLS} roi"),
    "start end mean_density",
)


def _boundary_extraction(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Stage: depth of each pixel against the inner boundaries; first pixel at or below each, with pia and white, in one table."""
    inner = B.inner_boundaries(D.bounds_to_layers(_bounds(cells)))
    deep = pixels.join(inner, "sample").filter(F.col("y") / F.lit(float(SIZE)) >= F.col("depth"))
    lines = deep.groupBy("sample", "boundary", "x").agg(F.min("y").alias("y"))
    ends = pixels.groupBy("sample", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    pia, white = (ends.select("sample", F.lit(n).alias("boundary"), "x", F.col(c).alias("y")) for n, c in (("pia", "top"), ("white", "bottom")))
    return G.inside(lines.unionByName(pia).unionByName(white), SIZE, SIZE)


add(
    "boundary_extraction",
    "v_cells v_pixels",
    _boundary_extraction,
    _LAYERS
    + """, inner_ AS (SELECT sample, CASE layer WHEN 'L1' THEN 'L1_2' WHEN 'L2/3' THEN 'L3_4' ELSE 'L4_5' END AS boundary, e AS depth FROM layers WHERE layer <> 'L5/6' AND e > 0 AND e < 1)
 SELECT p.sample, boundary, x, min(y) AS y FROM v_pixels p JOIN inner_ i ON i.sample = p.sample AND y / 1e2 >= depth GROUP BY 1, 2, 3
 UNION ALL SELECT sample, 'pia', x, min(y) FROM v_pixels GROUP BY 1, 3 UNION ALL SELECT sample, 'white', x, max(y) FROM v_pixels GROUP BY 1, 3""",
)
