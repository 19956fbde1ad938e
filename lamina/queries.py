"""Registered queries over the views, each with its SQL in the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import density as D
from lamina.operators import evaluation as E
from lamina.operators import polylines as P
from lamina.operators import raster as R
from lamina.operators import restoration as S
from lamina.registry import QUERIES, SQL
from lamina.registry import add as _add


_OVERLAP = """WITH l AS (SELECT sample, algo_layer AS layer, algo_layer, gt_layer FROM v_pixels WHERE algo_layer IS NOT NULL
  UNION ALL SELECT sample, gt_layer, algo_layer, gt_layer FROM v_pixels WHERE gt_layer IS NOT NULL AND gt_layer IS DISTINCT FROM algo_layer),
 n AS (SELECT sample, layer, count(*) FILTER (WHERE algo_layer = layer AND gt_layer = layer) AS tp, count(*) FILTER (WHERE algo_layer = layer) AS algo_px, count(*) FILTER (WHERE gt_layer = layer) AS gt_px FROM l GROUP BY 1, 2)"""
_add("overlap_metrics", "v_pixels", E.overlap, _OVERLAP + """ SELECT sample, layer, tp, algo_px, gt_px,
 round(coalesce(tp / nullif(algo_px + gt_px - tp, 0), 0), 6) AS iou, round(coalesce(2 * tp / nullif(algo_px + gt_px, 0), 0), 6) AS dice,
 round(coalesce(tp / nullif(algo_px, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(gt_px, 0), 0), 6) AS recall,
 CASE WHEN algo_px = 0 THEN 'algo_missing' WHEN gt_px = 0 THEN 'gt_missing' ELSE 'ok' END AS status FROM n""", "iou dice precision recall")  # fmt: skip
_add("over_under", "v_pixels", E.over_under, _OVERLAP + " SELECT sample, layer, algo_px - tp AS over_px, gt_px - tp AS under_px FROM n")
_THICK = """WITH a AS (SELECT sample, layer, avg(t) AS m FROM (SELECT sample, algo_layer AS layer, x, max(y) - min(y) + 1 AS t FROM v_pixels WHERE algo_layer IS NOT NULL GROUP BY 1, 2, 3) q GROUP BY 1, 2),
 g AS (SELECT sample, layer, avg(t) AS m FROM (SELECT sample, gt_layer AS layer, x, max(y) - min(y) + 1 AS t FROM v_pixels WHERE gt_layer IS NOT NULL GROUP BY 1, 2, 3) q GROUP BY 1, 2)"""
_add("thickness", "v_pixels", E.thickness, _THICK + """ SELECT a.sample, a.layer, round(a.m, 6) AS algo_mean_thickness_px, round(g.m, 6) AS gt_mean_thickness_px, round(abs(a.m - g.m), 6) AS thickness_error_px,
 round(CASE WHEN g.m > 0 THEN 100 * abs(a.m - g.m) / g.m ELSE 0 END, 6) AS thickness_error_percent, round(abs(a.m - g.m) * 0.1625, 6) AS thickness_error_um FROM a JOIN g USING (sample, layer)""",
 "algo_mean_thickness_px gt_mean_thickness_px thickness_error_px thickness_error_percent thickness_error_um")
_add("metrics_full_outer", "v_pixels", lambda p: E.overlap(p).select("sample", "layer", "iou").join(E.thickness(p).filter("thickness_error_percent > 1").select("sample", "layer", "thickness_error_px"), ["sample", "layer"], "full"),
 _OVERLAP + ", " + _THICK[5:] + """, t AS (SELECT sample, layer, abs(a.m - g.m) AS e FROM a JOIN g USING (sample, layer) WHERE g.m > 0 AND 100 * abs(a.m - g.m) / g.m > 1)
 SELECT sample, layer, round(coalesce(n.tp / nullif(n.algo_px + n.gt_px - n.tp, 0), 0), 6) AS iou, round(t.e, 6) AS thickness_error_px FROM n FULL JOIN t USING (sample, layer)""", "iou thickness_error_px")  # fmt: skip
_add("boundary_error", "v_boundary", E.boundary_error, "SELECT boundary, round(avg(abs(y - y_gt)), 6) AS error_px, count(*) AS columns, round(avg(abs(y - y_gt)) * 0.1625, 6) AS error_um FROM v_boundary GROUP BY 1", "error_px error_um")
_add("binary_pr", "v_pred", E.precision_recall, """WITH n AS (SELECT count(*) FILTER (WHERE pred AND gt) AS tp, count(*) FILTER (WHERE pred AND NOT gt) AS fp, count(*) FILTER (WHERE NOT pred AND gt) AS fn FROM v_pred)
 SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM n""", "precision recall")  # fmt: skip
_add("summary_stats", "v_metrics", lambda m: E.summary(m, "iou"), """SELECT CASE WHEN grouping(layer) = 1 THEN 'OVERALL' ELSE layer END AS layer, count(iou) AS n, round(avg(iou), 6) AS mean, round(stddev_samp(iou), 6) AS std, round(min(iou), 6) AS low,
 round(quantile_cont(iou, 0.25), 6) AS q25, round(median(iou), 6) AS median, round(quantile_cont(iou, 0.75), 6) AS q75, round(max(iou), 6) AS high,
 round(CASE WHEN grouping(layer) = 0 AND avg(iou) > 0 THEN stddev_samp(iou) / avg(iou) END, 6) AS cv FROM v_metrics GROUP BY GROUPING SETS ((layer), ())""", "mean std low q25 median q75 high cv")  # fmt: skip
_add("type_summary", "v_metrics", lambda m: E.type_summary(m, ["iou", "avg_boundary_error_px", "thickness_error_percent"]), """SELECT CASE WHEN grouping(layer) = 1 THEN 'OVERALL' ELSE layer END AS layer, "type", round(avg(iou), 6) AS iou, round(avg(avg_boundary_error_px), 6) AS avg_boundary_error_px,
 round(avg(thickness_error_percent), 6) AS thickness_error_percent FROM v_metrics GROUP BY GROUPING SETS ((layer, "type"), ("type"))""", "iou avg_boundary_error_px thickness_error_percent")  # fmt: skip
_WIDE = """WITH w AS (SELECT sample, layer, avg(CASE WHEN "type" = 'coarse' THEN {0} END) AS c, avg(CASE WHEN "type" = 'refined' THEN {0} END) AS r FROM v_metrics GROUP BY 1, 2) SELECT sample, layer, round({1}(r - c) / abs(c) * 100, 6) AS improvement FROM w WHERE c <> 0 AND r IS NOT NULL"""
_add("improvement_iou", "v_metrics", lambda m: E.improvement(m, "iou", False), _WIDE.format("iou", ""), "improvement")
_add("improvement_error", "v_metrics", lambda m: E.improvement(m, "avg_boundary_error_px", True), _WIDE.format("avg_boundary_error_px", "-"), "improvement")
_add("metric_pivot", "v_metrics", lambda m: E.by_layer(m, "iou"), "SELECT sample, " + ", ".join(f"round(avg(CASE WHEN layer = '{c}' THEN iou END), 6) AS {c.lower().replace('/', '_')}" for c in E.LAYERS) + " FROM v_metrics GROUP BY 1", "l1 l2_3 l4 l5_6")
_add("metric_hist", "v_metrics", lambda m: E.histogram(m, "avg_boundary_error_px"), """WITH e AS (SELECT min(avg_boundary_error_px) AS lo, max(avg_boundary_error_px) AS hi FROM v_metrics)
 SELECT cast(least(7, floor((avg_boundary_error_px - lo) / (hi - lo) * 8)) AS int) AS bin, count(*) AS n FROM v_metrics, e WHERE avg_boundary_error_px IS NOT NULL GROUP BY 1""")  # fmt: skip
_ROI = """WITH p AS (SELECT DISTINCT sample, x, y FROM v_pixels WHERE gt_layer = 'L4')
 SELECT sample, count(*) AS n, round(sum(depth), 4) AS depth FROM v_cells c WHERE ?EXISTS (SELECT 1 FROM p WHERE p.sample = c.sample AND p.x = cast(floor(c.cx) AS int) AND p.y = cast(floor(c.cy / 10) AS int)) GROUP BY 1"""
_add("roi_semi", "v_cells v_pixels", lambda c, p: _roi(c, p, "left_semi"), _ROI.replace("?", ""))
_add("roi_anti", "v_cells v_pixels", lambda c, p: _roi(c, p, "left_anti"), _ROI.replace("?", "NOT "))


def _roi(cells: DataFrame, pixels: DataFrame, kind: str) -> DataFrame:
    """Cells inside (or outside) the annotated L4, by the pixel their centre lies in."""
    inside = pixels.filter("gt_layer = 'L4'").select("sample", "x", "y")
    keyed = cells.withColumns({"x": F.floor("cx").cast("int"), "y": F.floor(F.col("cy") / 10).cast("int")})
    return keyed.join(inside, ["sample", "x", "y"], kind).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("depth"), 4).alias("depth"))


_add("depth_layer", "v_cells", D.depth_layer, """SELECT sample, CASE WHEN depth >= 0 AND depth < cast(0.07 as double) THEN 'L1' WHEN depth >= cast(0.07 as double) AND depth < cast(0.35 as double) THEN 'L2/3' WHEN depth >= cast(0.35 as double) AND depth < cast(0.5 as double) THEN 'L4'
 WHEN depth >= cast(0.5 as double) AND depth < 1 THEN 'L5/6' END AS layer, count(*) AS n, round(avg(depth), 6) AS mean_depth FROM v_cells GROUP BY 1, 2""", "mean_depth")  # fmt: skip
_CURVE = """WITH b AS (SELECT sample, density, least(49, CASE WHEN depth < r * cast(0.02 as double) THEN r - 1 WHEN depth >= (r + 1) * cast(0.02 as double) THEN r + 1 ELSE r END) AS bin FROM (SELECT sample, density, depth, floor(depth * 50) AS r FROM v_cells WHERE depth >= 0 AND depth <= 1) q),
 m AS (SELECT sample, cast(bin AS int) AS bin, avg(density) AS density, median(density) AS middle FROM b GROUP BY 1, 2),
 curve AS (SELECT s.sample, cast(k.k AS int) AS bin, (k.k + cast(0.5 as double)) * cast(0.02 as double) AS center, coalesce(m.density, 0) AS density, coalesce(m.middle, 0) AS middle FROM (SELECT DISTINCT sample FROM v_cells) s CROSS JOIN generate_series(0, 49) AS k(k) LEFT JOIN m ON m.sample = s.sample AND m.bin = k.k)"""
_SMOOTH = _CURVE + """, smooth AS (SELECT t.sample, t.bin, sum(s.density * w) / sum(w) AS smooth FROM (SELECT sample, bin, d.d AS d, exp(-cast(0.5 as double) * d.d * d.d / 4) AS w, CASE WHEN bin + d.d < 0 THEN -1 - bin - d.d WHEN bin + d.d > 49 THEN 99 - bin - d.d ELSE bin + d.d END AS src
 FROM curve CROSS JOIN generate_series(-8, 8) AS d(d)) t JOIN curve s ON s.sample = t.sample AND s.bin = t.src GROUP BY 1, 2)"""
_GRAD = _SMOOTH + """, g AS (SELECT sample, bin, CASE WHEN lag(smooth) OVER w IS NULL THEN (lead(smooth) OVER w - smooth) / cast(0.02 as double) WHEN lead(smooth) OVER w IS NULL THEN (smooth - lag(smooth) OVER w) / cast(0.02 as double)
 ELSE (lead(smooth) OVER w - lag(smooth) OVER w) / cast(0.04 as double) END AS slope FROM smooth WINDOW w AS (PARTITION BY sample ORDER BY bin))"""
_add("depth_curve", "v_cells", D.curve, _CURVE + " SELECT sample, bin, round(center, 6) AS center, round(density, 6) AS density FROM curve", "center density")
_add("curve_median", "v_cells", lambda c: D.curve(c, True), _CURVE + " SELECT sample, bin, round(center, 6) AS center, round(middle, 6) AS density FROM curve", "center density")
_add("curve_smooth", "v_cells", lambda c: D.smoothed(D.curve(c)), _SMOOTH + " SELECT sample, bin, round(smooth, 6) AS smooth FROM smooth", "smooth")
_add("curve_gradient", "v_cells", lambda c: D.gradient(D.smoothed(D.curve(c)), "smooth", "slope").select("sample", "bin", "slope"), _GRAD + " SELECT sample, bin, round(slope, 6) AS slope FROM g", "slope")
_add("curve_crossings", "v_cells", lambda c: D.crossings(D.gradient(D.smoothed(D.curve(c)), "smooth", "slope"), "slope"), _GRAD + """, c AS (SELECT sample, bin, slope, lead(slope) OVER (PARTITION BY sample ORDER BY bin) AS after FROM g)
 SELECT sample, bin, round((bin + cast(0.5 as double)) * cast(0.02 as double) + abs(slope) / (abs(slope) + abs(after) + 1e-8) * cast(0.02 as double), 6) AS depth FROM c WHERE slope * after < 0""", "depth")  # fmt: skip
_add("default_layers", "v_cells", lambda c: D.layers_of(D.curve(c)), _CURVE + """ SELECT s.sample, l.layer, l.s AS start, l.e AS "end", round(coalesce(avg(c.density), 0), 6) AS mean_density FROM (SELECT DISTINCT sample FROM v_cells) s
 CROSS JOIN (VALUES ('L1', cast(0 as double), cast(0.07 as double)), ('L2/3', cast(0.07 as double), cast(0.35 as double)), ('L4', cast(0.35 as double), cast(0.5 as double)), ('L5/6', cast(0.5 as double), cast(1 as double))) AS l(layer, s, e)
 LEFT JOIN curve c ON c.sample = s.sample AND c.center >= l.s AND c.center <= l.e GROUP BY 1, 2, 3, 4""", "mean_density")  # fmt: skip
_add("radius_count", "v_points2d", lambda p: D.within_radius(p, 0.05), "SELECT a.id, count(*) AS n FROM v_points2d a JOIN v_points2d b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= cast(0.05 as double) * cast(0.05 as double) GROUP BY 1")


def _legacy_depth(points: DataFrame) -> DataFrame:
    cells = points.filter("label >= 2")
    pia = D.nearest_distance(cells, points.filter("label = 0"), name="d_gm")
    white = D.nearest_distance(cells, points.filter("label = 1"), name="d_wm")
    return pia.join(white, "id").select("id", (F.col("d_gm") / (F.col("d_gm") + F.col("d_wm") + 1e-8)).alias("depth"))


_add("nearest_depth", "v_points2d", _legacy_depth, """SELECT id, round(g / (g + w + 1e-8), 6) AS depth FROM (SELECT c.id, min(CASE WHEN t.label = 0 THEN sqrt((c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y)) END) AS g,
 min(CASE WHEN t.label = 1 THEN sqrt((c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y)) END) AS w FROM v_points2d c CROSS JOIN v_points2d t WHERE c.label >= 2 AND t.label < 2 GROUP BY 1) q WHERE g IS NOT NULL AND w IS NOT NULL""", "depth")  # fmt: skip
_add("kde_density", "v_points2d", lambda p: D.kernel_density(p.withColumn("sample", F.col("label"))), """WITH s AS (SELECT label, count(*) AS n, var_samp(x) * power(count(*), -cast(1 as double) / 3) AS a, var_samp(y) * power(count(*), -cast(1 as double) / 3) AS b, covar_samp(x, y) * power(count(*), -cast(1 as double) / 3) AS c FROM v_points2d GROUP BY 1)
 SELECT p.id, round(CASE WHEN s.n < 2 THEN 1 ELSE sum(exp(-cast(0.5 as double) * (s.b * (p.x - q.x) * (p.x - q.x) - 2 * s.c * (p.x - q.x) * (p.y - q.y) + s.a * (p.y - q.y) * (p.y - q.y)) / (s.a * s.b - s.c * s.c))) / (s.n * 2 * pi() * sqrt(s.a * s.b - s.c * s.c)) * sqrt(s.n) END, 6) AS density
 FROM v_points2d p JOIN s ON s.label = p.label JOIN v_points2d q ON q.label = p.label GROUP BY p.id, s.n, s.a, s.b, s.c""", "density")  # fmt: skip
_W = "OVER (PARTITION BY contour_id ORDER BY seq)"
_STEP = f"coalesce(sqrt((x - lag(x) {_W}) * (x - lag(x) {_W}) + (y - lag(y) {_W}) * (y - lag(y) {_W})), 0)"
_add("arc_length", "v_vertices", lambda v: P.arc_length(v).select("contour_id", "seq", F.round("arc", 4).alias("arc")), f"SELECT contour_id, seq, round(sum(step) {_W}, 4) AS arc FROM (SELECT contour_id, seq, {_STEP} AS step FROM v_vertices) q")
_add("every_nth", "v_vertices", lambda v: P.every_nth(v, 3).select("contour_id", "seq", "y"), "SELECT contour_id, seq, y FROM v_vertices WHERE seq % 3 = 0")
_add("neighbours", "v_vertices", lambda v: P.neighbours(v, 2).select("contour_id", "seq", "y_left", "y_right"), f"SELECT contour_id, seq, coalesce(lag(y, 2) {_W}, first_value(y) {_W}) AS y_left, coalesce(lead(y, 2) {_W}, last_value(y) OVER (PARTITION BY contour_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS y_right FROM v_vertices")
_add("dedup_consecutive", "v_vertices", lambda v: P.without_repeats(v, ["event_type"]).select("contour_id", "seq", "event_type"), f"SELECT contour_id, seq, event_type FROM (SELECT *, lag(event_type) {_W} AS p FROM v_vertices) q WHERE seq = 0 OR event_type IS DISTINCT FROM p")
_add("runs_by_class", "v_vertices", lambda v: P.runs_by_class(v, "event_type", 2), f"""SELECT contour_id, event_type, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM (SELECT *, sum(s) {_W} AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) {_W} THEN 1 ELSE 0 END AS s FROM v_vertices) q) r GROUP BY contour_id, event_type, run HAVING count(*) >= 2""")
_add("split_by_gap", "v_vertices", lambda v: P.split_by_gap(v, 50.0), f"SELECT contour_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM (SELECT *, sum(s) {_W} AS run FROM (SELECT *, CASE WHEN {_STEP} > 50 THEN 1 ELSE 0 END AS s FROM v_vertices) q) r GROUP BY contour_id, run HAVING count(*) >= 2")
_add("dashes", "v_vertices", lambda v: P.dashes(v, 5, 3).select("contour_id", "seq"), "SELECT contour_id, seq FROM v_vertices WHERE seq % 8 < 5")
_add("densify", "v_vertices", P.densified, f"""WITH e AS (SELECT contour_id, seq, x, y, lead(x) {_W} AS x1, lead(y) {_W} AS y1 FROM v_vertices), n AS (SELECT *, CASE WHEN x1 IS NULL THEN 1 ELSE greatest(2, cast(ceil(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))) AS int)) END AS n FROM e)
 SELECT contour_id, seq, k.k AS k, cast(round_even(CASE WHEN x1 IS NULL THEN x ELSE x + (x1 - x) * k.k / n END, 0) AS bigint) AS px, cast(round_even(CASE WHEN x1 IS NULL THEN y ELSE y + (y1 - y) * k.k / n END, 0) AS bigint) AS py FROM n, generate_series(0, n - 1) AS k(k)""")  # fmt: skip
_add("chaikin", "v_vertices", P.chaikin, f"""WITH e AS (SELECT contour_id, seq, x, y, lead(x) {_W} AS x1, lead(y) {_W} AS y1 FROM v_vertices) SELECT contour_id, seq, 0 AS part, round(x, 6) AS px, round(y, 6) AS py FROM e WHERE seq = 0
 UNION ALL SELECT contour_id, seq, 1, round(x * cast(0.75 as double) + x1 * cast(0.25 as double), 6), round(y * cast(0.75 as double) + y1 * cast(0.25 as double), 6) FROM e WHERE x1 IS NOT NULL UNION ALL SELECT contour_id, seq, 2, round(x * cast(0.25 as double) + x1 * cast(0.75 as double), 6), round(y * cast(0.25 as double) + y1 * cast(0.75 as double), 6) FROM e WHERE x1 IS NOT NULL
 UNION ALL SELECT contour_id, seq, 3, round(x, 6), round(y, 6) FROM e WHERE x1 IS NULL""", "px py")  # fmt: skip
_NUMBERED = "WITH v AS (SELECT contour_id, seq, x, y, count(*) OVER (PARTITION BY contour_id) AS n FROM v_vertices)"
_add("median_filter", "v_vertices", lambda v: P.median_filtered(v).select("contour_id", "seq", "y"), _NUMBERED + """ SELECT a.contour_id, a.seq, CASE WHEN any_value(a.n) > 11 THEN median(b.y) ELSE any_value(a.y) END AS y
 FROM (SELECT *, CASE WHEN seq + o < 0 THEN -1 - seq - o WHEN seq + o >= n THEN greatest(0, 2 * n - 1 - seq - o) ELSE seq + o END AS src FROM v, generate_series(-5, 5) AS g(o)) a LEFT JOIN v b ON b.contour_id = a.contour_id AND b.seq = a.src GROUP BY 1, 2""")  # fmt: skip
_add("gauss_smooth", "v_vertices", lambda v: P.gauss_smoothed(v).select("contour_id", "seq", "x", "y"), _NUMBERED + """, s AS (SELECT a.contour_id, a.seq, any_value(a.n) AS n, any_value(a.x) AS x, any_value(a.y) AS y, sum(w * b.x) / sum(w) AS sx, sum(w * b.y) / sum(w) AS sy
 FROM (SELECT *, exp(-cast(o * o AS double) / 8) AS w, greatest(0, least(n - 1, seq + o)) AS src FROM v, generate_series(-6, 6) AS g(o)) a JOIN v b ON b.contour_id = a.contour_id AND b.seq = a.src GROUP BY 1, 2)
 SELECT contour_id, seq, round(CASE WHEN n < 3 OR seq = 0 OR seq = n - 1 THEN x ELSE sx END, 6) AS x, round(CASE WHEN n < 3 OR seq = 0 OR seq = n - 1 THEN y ELSE sy END, 6) AS y FROM s""", "x y")  # fmt: skip
_add("resample", "v_vertices", lambda v: S.resampled(v, 2.0).select("contour_id", F.col("k").cast("long").alias("k"), F.round("px", 4).alias("px"), F.round("py", 4).alias("py")), f"""WITH a AS (SELECT contour_id, seq, x, y, sum(step) {_W} AS arc FROM (SELECT contour_id, seq, x, y, {_STEP} AS step FROM v_vertices) q),
 t AS (SELECT contour_id, max(arc) AS total, greatest(cast(ceil(max(arc) / 2) AS bigint), count(*) - 1) AS parts FROM a GROUP BY 1), e AS (SELECT *, lead(x) {_W} AS x1, lead(y) {_W} AS y1, lead(arc) {_W} AS arc1 FROM a),
 s AS (SELECT contour_id, total, k.k AS k, total * k.k / nullif(parts, 0) AS d FROM t, generate_series(0, parts) AS k(k)), b AS (SELECT s.contour_id, k, d, e.*, row_number() OVER (PARTITION BY s.contour_id, k ORDER BY e.seq DESC) AS rn FROM s JOIN e ON e.contour_id = s.contour_id AND (e.arc <= d + 1e-9 OR d IS NULL))
 SELECT contour_id, k, round(CASE WHEN x1 IS NULL THEN x ELSE x + (x1 - x) * (d - arc) / (arc1 - arc) END, 4) AS px, round(CASE WHEN y1 IS NULL THEN y ELSE y + (y1 - y) * (d - arc) / (arc1 - arc) END, 4) AS py FROM b WHERE rn = 1""")  # fmt: skip
_add("curve_peaks", "v_cells", lambda c: D.peaks(D.smoothed(D.curve(c)), "smooth"), _SMOOTH + """, t AS (SELECT sample, bin, smooth, lag(smooth) OVER w AS a, lead(smooth) OVER w AS b FROM smooth WINDOW w AS (PARTITION BY sample ORDER BY bin))
 SELECT sample, bin, round(smooth, 6) AS height, round(smooth - greatest((SELECT min(s.smooth) FROM smooth s WHERE s.sample = t.sample AND s.bin < t.bin AND NOT EXISTS (SELECT 1 FROM smooth h WHERE h.sample = t.sample AND h.smooth > t.smooth AND h.bin >= s.bin AND h.bin < t.bin)),
 (SELECT min(s.smooth) FROM smooth s WHERE s.sample = t.sample AND s.bin > t.bin AND NOT EXISTS (SELECT 1 FROM smooth h WHERE h.sample = t.sample AND h.smooth > t.smooth AND h.bin <= s.bin AND h.bin > t.bin))), 6) AS prominence FROM t WHERE smooth > a AND smooth > b""", "height prominence")  # fmt: skip


_add("otsu", "v_gray", R.otsu, """WITH h AS (SELECT sample, v, count(*) AS n FROM v_gray GROUP BY 1, 2), c AS (SELECT sample, v, sum(n) OVER (PARTITION BY sample ORDER BY v) AS w0, sum(n * v) OVER (PARTITION BY sample ORDER BY v) AS s0, sum(n) OVER (PARTITION BY sample) AS w, sum(n * v) OVER (PARTITION BY sample) AS s FROM h),
 t AS (SELECT sample, v, cast(w0 AS double) * (w - w0) * power(cast(s0 AS double) / w0 - cast(s - s0 AS double) / (w - w0), 2) AS score FROM c WHERE w0 < w) SELECT sample, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, v) AS rn FROM t) q WHERE rn = 1""")  # fmt: skip
_MASK = lambda p: p.filter("gt_layer = 'L4'").select("sample", "x", "y")
_SQUARE = "SELECT sample, x + dx.d AS x, y + dy.d AS y, count(*) AS n FROM v_pixels, generate_series(-1, 1) AS dx(d), generate_series(-1, 1) AS dy(d) WHERE gt_layer = 'L4' GROUP BY 1, 2, 3"
_add("dilate", "v_pixels", lambda p: R.dilated(_MASK(p)), f"SELECT sample, cast(x AS int) AS x, cast(y AS int) AS y FROM ({_SQUARE}) q")
_add("erode", "v_pixels", lambda p: R.eroded(_MASK(p)), f"SELECT sample, cast(x AS int) AS x, cast(y AS int) AS y FROM ({_SQUARE}) q WHERE n = 9")
_add("tile_ownership", "v_cells", lambda c: R.tile_counts(c, 256, 32), "SELECT sample, cast(floor(cy / 192) AS bigint) AS tile_r, cast(floor(cx / 192) AS bigint) AS tile_c, count(*) AS n, cast(sum(area_px) AS bigint) AS area_px FROM v_cells GROUP BY 1, 2, 3")
_add("paste_overlay", "v_pixels", lambda p: R.pasted(p.select("sample", "x", "y", F.col("algo_layer").alias("layer")), p.filter("gt_layer is not null").select("sample", "x", "y", F.col("gt_layer").alias("layer")), 10, 5, "layer"), "SELECT a.sample, a.x, a.y, coalesce(b.gt_layer, a.algo_layer) AS layer FROM v_pixels a LEFT JOIN v_pixels b ON b.sample = a.sample AND b.x + 10 = a.x AND b.y + 5 = a.y AND b.gt_layer IS NOT NULL")


from lamina import queries_boundaries, queries_models, queries_rasters, queries_shapes, queries_tables  # noqa: E402, F401  they register theirs

__all__ = ["QUERIES", "SQL"]
