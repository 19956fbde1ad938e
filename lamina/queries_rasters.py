"""Queries on whole rasters: contours, distance transforms, harmonic depth, filters, masks; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import boundaries as B
from lamina.operators import contours as C
from lamina.operators import density as D
from lamina.operators import distances as T
from lamina.operators import filters as K
from lamina.operators import harmonic as H
from lamina.operators import masks as M
from lamina.operators import polylines as P
from lamina.operators import tiles as L
from lamina.operators.geometry import ellipse
from lamina.queries_boundaries import PEAK_BOUNDS_SQL
from lamina.queries_boundaries import _bounds as bounds_of_cells
from lamina.registry import add

#: Canvas of v_pixels and of v_raster; tiles small enough that each query has edges between tiles.
SIZE, WIDTH, HEIGHT, TILE = 100, 60, 44, 32

# ---------------------------------------------------------------- holes and contours


def _l4(pixels: DataFrame) -> DataFrame:
    return pixels.filter("algo_layer = 'L4' and (x * 7 + y * 3) % 11 > 2").select("sample", "x", "y")


_L4 = "SELECT sample, x, y FROM v_pixels WHERE algo_layer = 'L4' AND (x * 7 + y * 3) % 11 > 2"


def canvas_sql(samples: str, width: int, height: int) -> str:
    return f"SELECT s.sample, cast(cx.i AS int) AS x, cast(cy.i AS int) AS y FROM ({samples}) s, range({width}) AS cx(i), range({height}) AS cy(i)"


def holes_sql(name: str, mask: str, width: int, height: int) -> str:
    """CTEs that end in `name`: the mask with its holes, by a flood of the background from the canvas's edge."""
    return f"""{name}_b AS (SELECT * FROM ({canvas_sql(f"SELECT DISTINCT sample FROM {mask}", width, height)}) c ANTI JOIN {mask} m USING (sample, x, y)),
{name}_o AS (SELECT sample, x, y FROM {name}_b WHERE x IN (0, {width - 1}) OR y IN (0, {height - 1})
 UNION SELECT b.sample, b.x, b.y FROM {name}_o o JOIN {name}_b b ON b.sample = o.sample AND abs(b.x - o.x) + abs(b.y - o.y) = 1),
{name} AS (SELECT * FROM ({canvas_sql(f"SELECT DISTINCT sample FROM {mask}", width, height)}) c ANTI JOIN {name}_o o USING (sample, x, y))"""


def trace_sql(name: str, mask: str, width: int) -> str:
    """CTEs that end in `name`: the borders of a mask as (sample, loop, k, x, y), each followed side by side from its first one."""
    return f"""{name}_w(s, ox, oy, tx, ty) AS (VALUES (0, -1, 0, 0, 1), (1, 0, 1, 1, 0), (2, 1, 0, 0, -1), (3, 0, -1, -1, 0)),
{name}_e AS (SELECT m.sample, m.x, m.y, s, (m.y * {width} + m.x) * 4 + s AS id,
  CASE WHEN d.x IS NOT NULL THEN (d.y * {width} + d.x) * 4 + (s + 3) % 4 WHEN a.x IS NOT NULL THEN (a.y * {width} + a.x) * 4 + s ELSE (m.y * {width} + m.x) * 4 + (s + 1) % 4 END AS nxt
 FROM {mask} m CROSS JOIN {name}_w LEFT JOIN {mask} f ON f.sample = m.sample AND f.x = m.x + ox AND f.y = m.y + oy
 LEFT JOIN {mask} d ON d.sample = m.sample AND d.x = m.x + ox + tx AND d.y = m.y + oy + ty LEFT JOIN {mask} a ON a.sample = m.sample AND a.x = m.x + tx AND a.y = m.y + ty WHERE f.x IS NULL),
{name}_t AS (SELECT sample, id AS loop, id, nxt, 0 AS k FROM {name}_e WHERE s < 2
 UNION ALL SELECT t.sample, t.loop, e.id, e.nxt, t.k + 1 FROM {name}_t t JOIN {name}_e e ON e.sample = t.sample AND e.id = t.nxt WHERE t.nxt > t.loop),
{name}_l AS (SELECT sample, loop, max(k) + 1 AS n FROM {name}_t GROUP BY 1, 2 HAVING arg_max(nxt, k) = loop),
{name}_p AS (SELECT t.sample, t.loop, t.k, (t.id // 4) % {width} AS x, t.id // 4 // {width} AS y, lag(t.id // 4, 1, -1) OVER o AS before, last_value(t.id // 4) OVER (PARTITION BY t.sample, t.loop ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
  count(*) OVER (PARTITION BY t.sample, t.loop) AS n, t.id // 4 AS pixel FROM {name}_t t JOIN {name}_l l USING (sample, loop) WINDOW o AS (PARTITION BY t.sample, t.loop ORDER BY t.k)),
{name}_v AS (SELECT sample, loop, x, y, row_number() OVER (PARTITION BY sample, loop ORDER BY k) - 1 AS seq, pixel, final FROM {name}_p WHERE before <> pixel),
{name} AS (SELECT sample, cast(loop AS bigint) AS loop, loop % 4 = 0 AS outer_, seq, cast(x AS int) AS x, cast(y AS int) AS y FROM {name}_v v
 WHERE NOT (seq > 0 AND seq = (SELECT max(seq) FROM {name}_v u WHERE u.sample = v.sample AND u.loop = v.loop) AND pixel = (v.loop // 4)))"""


def longest_sql(name: str, loops: str) -> str:
    """CTEs that end in `name`: the loop of each sample with the greatest open length, with that length."""
    return f"""{name}_s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)), 0) AS step FROM {loops} WHERE outer_ WINDOW o AS (PARTITION BY sample, loop ORDER BY seq)),
{name}_n AS (SELECT sample, loop, round(sum(step), 6) AS length FROM {name}_s GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY length DESC, loop) AS rn FROM {name}_n) q WHERE rn = 1)"""


add("filled_holes", "v_pixels", lambda p: L.filled_holes(_l4(p), SIZE, SIZE, TILE), f"WITH RECURSIVE m AS ({_L4}), {holes_sql('f', 'm', SIZE, SIZE)} SELECT * FROM f")
add(
    "mask_contours",
    "v_pixels",
    lambda p: C.contours(_l4(p), SIZE, SIZE, TILE).select("sample", "loop", "outer", "seq", "x", "y"),
    f"WITH RECURSIVE m AS ({_L4}), {trace_sql('t', 'm', SIZE)} SELECT sample, loop, outer_ AS \"outer\", seq, x, y FROM t",
)

# ---------------------------------------------------------------- distances and depth


def _seeds(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels where the layers say pia and white matter begin."""
    pia = pixels.filter("algo_layer = 'L1' and gt_layer = 'L2/3'").select("sample", "x", "y")
    return pia, pixels.filter("algo_layer = 'L5/6' and gt_layer is null").select("sample", "x", "y")


_DEPTH = f"""seeds AS (SELECT sample, 0 AS kind, x, y FROM v_pixels WHERE algo_layer = 'L1' AND gt_layer = 'L2/3'
 UNION ALL SELECT sample, 1, x, y FROM v_pixels WHERE algo_layer = 'L5/6' AND gt_layer IS NULL),
far AS (SELECT c.sample, c.x, c.y, kind, sqrt(cast(min((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS double)) AS d
 FROM ({canvas_sql("SELECT DISTINCT sample FROM v_pixels", SIZE, SIZE)}) c JOIN seeds s ON s.sample = c.sample GROUP BY 1, 2, 3, 4),
depth AS (SELECT a.sample, a.x, a.y, a.d AS d_pia, b.d AS d_white, a.d / (a.d + b.d + 1e-8) AS depth FROM far a JOIN far b USING (sample, x, y) WHERE a.kind = 0 AND b.kind = 1)"""
add(
    "depth_raster",
    "v_pixels",
    lambda p: T.depth_raster(*_seeds(p), SIZE, SIZE),
    f"WITH {_DEPTH} SELECT sample, x, y, round(d_pia, 6) AS d_pia, round(d_white, 6) AS d_white, round(depth, 6) AS depth FROM depth",
    "d_pia d_white depth",
)


def _iso_contours(pixels: DataFrame) -> DataFrame:
    """Longest outer contour of what lies at or below the depth 0.35, by sample."""
    deep = T.depth_raster(*_seeds(pixels), SIZE, SIZE).filter("depth >= 0.35d")
    return C.longest(C.outer_contours(deep.select("sample", "x", "y"), SIZE, SIZE, TILE)).select("sample", "loop", "length", "seq", "x", "y")


add(
    "iso_contours",
    "v_pixels",
    _iso_contours,
    f"""WITH RECURSIVE {_DEPTH}, deep AS (SELECT sample, x, y FROM depth WHERE depth >= 35e-2), {holes_sql("f", "deep", SIZE, SIZE)}, {trace_sql("t", "f", SIZE)}, {longest_sql("b", "t")}
 SELECT t.sample, t.loop, b.length, seq, x, y FROM t JOIN b USING (sample, loop)""",
)


def _boundary_contours(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Stage: depth of every pixel from its distances to pia and white matter; for each inner bound of the layers, the longest contour of what lies deeper."""
    inner = B.inner_boundaries(D.bounds_to_layers(bounds_of_cells(cells)))
    deep = T.depth_raster(*_seeds(pixels), SIZE, SIZE).join(inner.withColumnRenamed("depth", "bound"), "sample").filter("depth >= bound")
    lines = C.longest(C.outer_contours(deep.select(F.concat_ws("/", "sample", "boundary").alias("sample"), "x", "y"), SIZE, SIZE, TILE))
    tag = F.split("sample", "/")
    return lines.select(tag[0].alias("sample"), tag[1].alias("boundary"), "seq", "x", "y", "length")


add(
    "boundary_contours",
    "v_cells v_pixels",
    _boundary_contours,
    PEAK_BOUNDS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", ends(sample, boundary, bound) AS (SELECT sample, 'L1_2', b1 FROM bounds UNION ALL SELECT sample, 'L3_4', b3 FROM bounds UNION ALL SELECT sample, 'L4_5', b4 FROM bounds), {_DEPTH},
 deep AS (SELECT depth.sample || '/' || boundary AS sample, x, y FROM depth JOIN ends ON ends.sample = depth.sample AND bound > 0 AND bound < 1 AND depth >= bound),
 {holes_sql("whole", "deep", SIZE, SIZE)}, {trace_sql("traced", "whole", SIZE)}, {longest_sql("best", "traced")}
 SELECT split_part(sample, '/', 1) AS sample, split_part(sample, '/', 2) AS boundary, seq, x, y, length FROM traced JOIN best USING (sample, loop)""",
)


def _harmonic_depth(boundary: DataFrame, cells: DataFrame) -> DataFrame:
    """Depth of each cell in the Laplace field between pia and white matter; where that has no value, from the distances to both."""
    ribbon = lambda name: boundary.filter(F.col("boundary") == name).select(F.lit("all").alias("sample"), F.col("x").cast("double").alias("x"), "y")
    pia, white = ribbon("pia"), ribbon("white")
    points = cells.select(F.lit("all").alias("sample"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    found = M.kept(H.sampled(points.distinct(), *H.harmonic_field(pia, white, points, tile=128, halo=24, tolerance=1e-8)).drop("sample"), "depths")
    left = found.filter("depth is null").select("x", "y")
    share = F.col("d_pia") / (F.col("d_pia") + F.col("d_white"))
    rest = D.nearest_distances(left, {"d_pia": pia, "d_white": white}).select("x", "y", F.round(share, 6).alias("depth"), F.lit(True).alias("by_distance"))
    return found.filter("depth is not null").select("x", "y", F.round("depth", 6).alias("depth"), F.lit(False).alias("by_distance")).unionByName(rest)


add("harmonic_depth", "v_boundary v_cells", _harmonic_depth, None)

# ---------------------------------------------------------------- filters of gray rasters

_CANVAS = f"c AS (SELECT c.sample, c.x, c.y, coalesce(r.v, 0) AS v FROM ({canvas_sql('SELECT DISTINCT sample FROM v_raster', WIDTH, HEIGHT)}) c LEFT JOIN v_raster r USING (sample, x, y))"
_MIRROR = lambda at, size: f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} >= {size} THEN {2 * (size - 1)} - ({at}) ELSE {at} END"


def blur_sql(size: int) -> str:
    """CTEs that end in s: the blurred canvas c."""
    taps = "(VALUES " + ", ".join(f"({i - size // 2}, {w!r}e0)" for i, w in enumerate(K.gaussian_kernel(size))) + ") AS k(d, w)"
    return f"""h AS (SELECT c.sample, c.x, c.y, sum(w * o.v) AS v FROM c CROSS JOIN {taps} JOIN c o ON o.sample = c.sample AND o.y = c.y AND o.x = {_MIRROR("c.x + d", WIDTH)} GROUP BY 1, 2, 3),
s AS (SELECT c.sample, c.x, c.y, cast(floor(sum(w * o.v) + 5e-1) AS int) AS v FROM h c CROSS JOIN {taps} JOIN h o ON o.sample = c.sample AND o.x = c.x AND o.y = {_MIRROR("c.y + d", HEIGHT)} GROUP BY 1, 2, 3)"""


add("gaussian_blur", "v_raster", lambda g: K.blurred(g, 11, WIDTH, HEIGHT, TILE), f"WITH {_CANVAS}, {blur_sql(11)} SELECT * FROM s")
add(
    "difference_image",
    "v_raster",
    lambda g: K.blurred(g, 5, WIDTH, HEIGHT, TILE).withColumnRenamed("v", "smooth").join(g.select("sample", "x", "y", "v"), ["sample", "x", "y"]).select("sample", "x", "y", F.abs(F.col("v") - F.col("smooth")).alias("difference"), F.when(F.col("v") > F.col("smooth"), 1).when(F.col("v") < F.col("smooth"), 2).otherwise(3).alias("code")),
    f"WITH {_CANVAS}, {blur_sql(5)} SELECT r.sample, r.x, r.y, cast(abs(r.v - s.v) AS int) AS difference, CASE WHEN r.v > s.v THEN 1 WHEN r.v < s.v THEN 2 ELSE 3 END AS code FROM v_raster r JOIN s USING (sample, x, y)",
)
_DISC = "(VALUES " + ", ".join(f"({dx}, {dy})" for dx, dy in ellipse(9)) + ") AS k(dx, dy)"
add(
    "top_hat",
    "v_raster",
    lambda g: K.enhanced(g, WIDTH, HEIGHT, 9, tile=TILE),
    f"""WITH {_CANVAS}, lo AS (SELECT c.sample, c.x, c.y, min(o.v) AS v FROM c CROSS JOIN {_DISC} JOIN c o ON o.sample = c.sample AND o.x = c.x + dx AND o.y = c.y + dy GROUP BY 1, 2, 3),
 hi AS (SELECT c.sample, c.x, c.y, max(o.v) AS v FROM lo c CROSS JOIN {_DISC} JOIN lo o ON o.sample = c.sample AND o.x = c.x + dx AND o.y = c.y + dy GROUP BY 1, 2, 3)
 SELECT c.sample, c.x, c.y, cast(least(255, round_even(abs(greatest(c.v - hi.v, 0) * 1.5e0 + 10), 0)) AS int) AS v FROM c JOIN hi USING (sample, x, y)""",
)
add(
    "paraboloid_background",
    "v_raster",
    lambda g: K.paraboloid_background(g, 51, WIDTH, HEIGHT, TILE),
    f"""WITH {_CANVAS}, h AS (SELECT c.sample, c.x, c.y, max(o.v - (o.x - c.x) * (o.x - c.x) / 102e0) AS v FROM c JOIN c o ON o.sample = c.sample AND o.y = c.y GROUP BY 1, 2, 3),
 b AS (SELECT c.sample, c.x, c.y, max(o.v - (o.y - c.y) * (o.y - c.y) / 102e0) AS v FROM h c JOIN h o ON o.sample = c.sample AND o.x = c.x GROUP BY 1, 2, 3)
 SELECT c.sample, c.x, c.y, cast(c.v AS int) AS v, round(b.v, 6) AS raised FROM c JOIN b USING (sample, x, y)""",
    "raised",
)
add(
    "less_background",
    "v_raster",
    lambda g: K.less_background(K.blurred(g, 5, WIDTH, HEIGHT, TILE).withColumnRenamed("v", "raised").join(g.select("sample", "x", "y", "v"), ["sample", "x", "y"])),
    f"""WITH {_CANVAS}, {blur_sql(5)}, l AS (SELECT r.sample, r.x, r.y, cast(r.v - least(r.v, s.v) AS double) AS v FROM v_raster r JOIN s USING (sample, x, y)),
 e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM l WINDOW w AS (PARTITION BY sample))
 SELECT sample, x, y, cast(least(255, round_even(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0 END * 1.5e0, 0)) AS int) AS v FROM e""",
)
_TW, _TH = (WIDTH + 8 - WIDTH % 8) // 8, (HEIGHT + 8 - HEIGHT % 8) // 8
_LIMIT = max(1, int(2.0 * _TW * _TH / 256))
add(
    "local_equalisation",
    "v_raster",
    lambda g: K.equalised(g, WIDTH, HEIGHT),
    f"""WITH wide AS (SELECT sample, x, y, v FROM v_raster UNION ALL SELECT sample, {2 * WIDTH - 2} - x, y, v FROM v_raster WHERE {2 * WIDTH - 2} - x BETWEEN {WIDTH} AND {8 * _TW - 1}),
 every AS (SELECT sample, x, y, v FROM wide UNION ALL SELECT sample, x, {2 * HEIGHT - 2} - y, v FROM wide WHERE {2 * HEIGHT - 2} - y BETWEEN {HEIGHT} AND {8 * _TH - 1}),
 n AS (SELECT sample, y // {_TH} AS r, x // {_TW} AS c, v, count(*) AS n FROM every GROUP BY 1, 2, 3, 4),
 h AS (SELECT t.sample, t.r, t.c, i.v, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT sample, r, c FROM n) t CROSS JOIN range(256) AS i(v) LEFT JOIN n ON n.sample = t.sample AND n.r = t.r AND n.c = t.c AND n.v = i.v),
 q AS (SELECT *, cast(sum(greatest(n - {_LIMIT}, 0)) OVER (PARTITION BY sample, r, c) AS bigint) AS cut FROM h),
 l AS (SELECT sample, r, c, v, least(255, round_even(sum(least(n, {_LIMIT}) + cut // 256 + CASE WHEN v % greatest(256 // greatest(cut % 256, 1), 1) = 0 AND v // greatest(256 // greatest(cut % 256, 1), 1) < cut % 256 THEN 1 ELSE 0 END)
   OVER (PARTITION BY sample, r, c ORDER BY v) * (255e0 / {_TW * _TH}), 0)) AS lut FROM q),
 p AS (SELECT *, floor(x / {_TW}e0 - 5e-1) AS qc, floor(y / {_TH}e0 - 5e-1) AS qr FROM v_raster),
 f AS (SELECT *, x / {_TW}e0 - 5e-1 - qc AS fx, y / {_TH}e0 - 5e-1 - qr AS fy FROM p)
 SELECT f.sample, f.x, f.y, cast(least(255, round_even(round((coalesce(a.lut, 0) * (1 - fx) + coalesce(b.lut, 0) * fx) * (1 - fy) + (coalesce(c.lut, 0) * (1 - fx) + coalesce(d.lut, 0) * fx) * fy, 9), 0)) AS int) AS v FROM f
 LEFT JOIN l a ON a.sample = f.sample AND a.v = f.v AND a.r = greatest(qr, 0) AND a.c = greatest(qc, 0) LEFT JOIN l b ON b.sample = f.sample AND b.v = f.v AND b.r = greatest(qr, 0) AND b.c = least(qc + 1, 7)
 LEFT JOIN l c ON c.sample = f.sample AND c.v = f.v AND c.r = least(qr + 1, 7) AND c.c = greatest(qc, 0) LEFT JOIN l d ON d.sample = f.sample AND d.v = f.v AND d.r = least(qr + 1, 7) AND d.c = least(qc + 1, 7)""",
)

# ---------------------------------------------------------------- polygons

_POLYGON = """WITH e AS (SELECT contour_id, x AS xa, y AS ya, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xb, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb
 FROM (SELECT contour_id, seq, x * 3 AS x, round(y, 0) AS y FROM v_vertices) v WINDOW w AS (PARTITION BY contour_id ORDER BY seq)),
r AS (SELECT *, unnest(range(cast(ceil(least(ya, yb)) AS bigint), cast(ceil(greatest(ya, yb)) AS bigint))) AS row_ FROM e),
m AS (SELECT contour_id, row_ AS y, xa + (row_ - ya) * (xb - xa) / (yb - ya) AS x FROM r),
p AS (SELECT contour_id, y, x, lead(x) OVER w AS x2, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY contour_id, y ORDER BY x)),
a AS (SELECT contour_id, y, x, x2 FROM p WHERE rn % 2 = 1 UNION ALL SELECT contour_id, cast(ya AS bigint), least(xa, xb), greatest(xa, xb) FROM e WHERE ya = yb)"""
add(
    "polygon_fill",
    "v_vertices",
    lambda v: P.polygon_rows(v.select("contour_id", "seq", (F.col("x") * 3).alias("x"), F.round("y", 0).alias("y"))),
    _POLYGON + " SELECT contour_id, y, cast(ceil(x) AS bigint) AS x_from, cast(floor(x2) AS bigint) AS x_to FROM a WHERE ceil(x) <= floor(x2)",
)

# ---------------------------------------------------------------- tissue, white and gray matter


def _morph_sql(name: str, source: str, steps: list[tuple[str, str, int, int]], width: int, height: int) -> str:
    """CTEs that end in `name`: the mask `source` after the steps of filters.morphed, then cut to the canvas."""
    plan = []
    for what, shape, size, times in steps:
        offsets = [(dx, dy) for dy, half in K.spans(shape, size).items() for dx in range(-half, half + 1)]
        grow, shrink = (1, offsets), (len(offsets), offsets)
        plan += {"open": [shrink] * times + [grow] * times, "close": [grow] * times + [shrink] * times, "dilate": [grow] * times}[what]
    out, now = [], source
    for i, (least, offsets) in enumerate(plan):
        values = ", ".join(f"({dx}, {dy})" for dx, dy in offsets)
        out.append(f"{name}_{i} AS (SELECT sample, x + dx AS x, y + dy AS y FROM {now}, (VALUES {values}) AS k(dx, dy) GROUP BY 1, 2, 3 HAVING count(*) >= {least})")
        now = f"{name}_{i}"
    return ", ".join([*out, f"{name} AS (SELECT * FROM {now} WHERE x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1})"])


def _largest_sql(name: str, mask: str, width: int) -> str:
    return f"""{name}_r AS (SELECT sample, x, y, y * {width} + x AS k FROM {mask} UNION SELECT m.sample, m.x, m.y, r.k FROM {name}_r r JOIN {mask} m ON m.sample = r.sample AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1),
{name}_c AS (SELECT sample, x, y, min(k) AS k FROM {name}_r GROUP BY 1, 2, 3),
{name} AS (SELECT sample, x, y FROM {name}_c JOIN (SELECT sample, k FROM (SELECT sample, k, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, k) AS rn FROM {name}_c GROUP BY 1, 2) q WHERE rn = 1) b USING (sample, k))"""


def _otsu_sql(name: str, pixels: str) -> str:
    return f"""{name}_h AS (SELECT sample, v, count(*) AS n FROM {pixels} GROUP BY 1, 2), {name}_s AS (SELECT sample, v, sum(n) OVER (PARTITION BY sample ORDER BY v) AS w0, sum(n * v) OVER (PARTITION BY sample ORDER BY v) AS s0,
 sum(n) OVER (PARTITION BY sample) AS w, sum(n * v) OVER (PARTITION BY sample) AS s FROM {name}_h),
{name} AS (SELECT sample, v AS t FROM (SELECT sample, v, row_number() OVER (PARTITION BY sample ORDER BY cast(w0 AS double) * (w - w0) * power(cast(s0 AS double) / w0 - cast(s - s0 AS double) / (w - w0), 2) DESC, v) AS rn FROM {name}_s WHERE w0 < w) q WHERE rn = 1)"""


def _matter(gray: DataFrame) -> DataFrame:
    """Stage: tissue, white and gray matter of each sample, one row for each pixel and mask."""
    tissue = M.kept(M.tissue(gray, WIDTH, HEIGHT, 5, 1.0, 2, 3, 2, TILE), "tissue")
    white = M.kept(M.white(gray, tissue, WIDTH, HEIGHT, 1.0, 3, 1, 5, TILE), "white")
    gray_mask = M.gray_matter(tissue, white, WIDTH, HEIGHT, 3, 1, TILE)
    named = [m.select("sample", F.lit(n).alias("mask"), "x", "y") for n, m in (("tissue", tissue), ("white", white), ("gray", gray_mask))]
    return named[0].unionByName(named[1]).unionByName(named[2])


add(
    "matter_masks",
    "v_raster",
    _matter,
    f"""WITH RECURSIVE {_CANVAS}, {blur_sql(5)}, {_otsu_sql("o", "s")},
t0 AS (SELECT sample, x, y FROM s JOIN o USING (sample) WHERE v <= t AND x BETWEEN 2 AND {WIDTH - 3} AND y BETWEEN 2 AND {HEIGHT - 3}),
{_morph_sql("t1", "t0", [("open", "rect", 3, 2), ("close", "rect", 3, 2)], WIDTH, HEIGHT)}, {_largest_sql("t2", "t1", WIDTH)}, {holes_sql("tissue", "t2", WIDTH, HEIGHT)},
ti AS (SELECT sample, x, y, v FROM tissue JOIN c USING (sample, x, y)), {_otsu_sql("p", "ti")}, w0 AS (SELECT sample, x, y FROM ti JOIN p USING (sample) WHERE v <= t),
{_morph_sql("w1", "w0", [("open", "ellipse", 3, 1), ("close", "ellipse", 3, 1)], WIDTH, HEIGHT)}, {_largest_sql("w2", "w1", WIDTH)}, {_morph_sql("w3", "w2", [("dilate", "ellipse", 5, 1)], WIDTH, HEIGHT)}, {holes_sql("white", "w3", WIDTH, HEIGHT)},
g0 AS (SELECT * FROM tissue ANTI JOIN white USING (sample, x, y)), {_morph_sql("g1", "g0", [("close", "ellipse", 3, 1), ("open", "ellipse", 3, 1)], WIDTH, HEIGHT)}, {_largest_sql("g2", "g1", WIDTH)}
SELECT sample, 'tissue' AS mask, x, y FROM tissue UNION ALL SELECT sample, 'white', x, y FROM white UNION ALL SELECT sample, 'gray', cast(x AS int), cast(y AS int) FROM g2""",
)
