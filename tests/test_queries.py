"""Every query of the layer engine against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

from lamina.operators import density, polylines, raster
from lamina.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "lineitem part events embeddings labels".split()


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(_key(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(_key(r[c]) for c in columns) for r in out.collect()) == want


def test_bin_edges(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.02, 1), (0.98, 49), (1.0, 49), (1.0001, None), (float("nan"), None)], "depth double, want int")
    assert all(r.got == r.want for r in rows.withColumn("got", density.bin_of(rows.depth)).collect())


def test_nearest_grows_its_cells(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "id int, x double, y double")
    targets = spark.createDataFrame([(0.5, 0.0), (3.0, 4.0)], "x double, y double")
    got = {r.id: r.distance for r in density.nearest_distance(points, targets, 1.0).collect()}
    assert got[1] == 0.5 and abs(got[2] - math.hypot(97, 4)) < 1e-9
    assert density.nearest_distance(points, targets.limit(0), 1.0).count() == 0


def test_opening_removes_specks(spark):
    square = [("a", x, y) for x in range(5) for y in range(5)]
    mask = spark.createDataFrame([*square, ("a", 20, 20)], "sample string, x int, y int")
    assert {(r.x, r.y) for r in raster.opened(mask).collect()} == {(x, y) for _, x, y in square}


def test_straight_line_densifies_without_repeats(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 5.0, 0.0)], "contour_id int, seq int, x double, y double")
    got = polylines.densified(line).orderBy("seq", "k").collect()
    assert [r.px for r in got] == [0, 1, 2, 3, 4, 5]


def _curve(spark, heights):
    return spark.createDataFrame([("s", i, float(h)) for i, h in enumerate(heights)], "sample string, bin int, v double")


def _bell(at, i):
    return math.exp(-(((i + 0.5) * 0.02 - at) ** 2) / 0.005)


def test_peaks_on_plateau_and_prominence(spark):
    got = {r.bin: (r.height, r.prominence) for r in density.peaks(_curve(spark, [3, 1, 2, 2, 2, 0, 5, 4, 4.5, 1, 9]), "v").collect()}
    assert got == {3: (2.0, 1.0), 6: (5.0, 5.0 - 1.0), 8: (4.5, 0.5)}


def test_two_peaks_and_their_bounds(spark):
    two = _curve(spark, [0.5 + 0.3 * _bell(0.25, i) + 0.4 * _bell(0.55, i) for i in range(50)])
    row = density.top_two_peaks(two, "v").first()
    assert abs((row.upper + 0.5) * 0.02 - 0.25) <= 0.02 and abs((row.lower + 0.5) * 0.02 - 0.55) <= 0.02
    none = spark.createDataFrame([], "sample string, depth double")
    p, q = (row.upper + 0.5) * 0.02, (row.lower + 0.5) * 0.02
    want = [0, p * 0.5, p + (q - p) * 0.33, p + (q - p) * 0.67, q + (1 - q) * 0.4, 1]
    assert all(abs(a - b) < 1e-9 for a, b in zip(density.peak_bounds(two, "v", none).first()[1:], want, strict=True))
    turns = spark.createDataFrame([("s", z) for z in (0.1, 0.2, 0.3, 0.42, 0.5, 0.62, 0.9)], "sample string, depth double")
    assert density.peak_bounds(two, "v", turns).first()[1:] == (0.0, 0.2, 0.3, 0.5, 0.62, 1.0)
    one = _curve(spark, [_bell(0.4, i) for i in range(50)])
    assert density.top_two_peaks(one, "v").count() == 0 and density.peak_bounds(one, "v", turns).count() == 0


def test_near_peaks_leave_the_higher(spark):
    heights = [0.0] * 50
    heights[10], heights[12], heights[30] = 5.0, 6.0, 4.0
    row = density.top_two_peaks(_curve(spark, heights), "v").first()
    assert (row.upper, row.lower) == (12, 30)


def test_short_lines_stay_as_they_are(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 4.0, 3.0), (2, 0, 1.0, 1.0), (2, 1, 9.0, 9.0), (3, 5, 2.0, 2.0)], "contour_id int, seq int, x double, y double")
    assert sorted(polylines.median_filtered(line).collect()) == sorted(line.collect())
    short = line.filter("contour_id > 1")
    assert sorted(map(tuple, polylines.gauss_smoothed(short).select(line.columns).collect())) == sorted(map(tuple, short.collect()))
    got = [(r.px, r.py) for r in polylines.resampled(line.filter("contour_id = 1"), 1.0).orderBy("k").collect()]
    assert len(got) == 6 and got[0] == (0, 0) and got[-1] == (4, 3) and all(abs(math.hypot(x, y) - i) < 1e-9 for i, (x, y) in enumerate(got))
    assert [(r.px, r.py) for r in polylines.resampled(line.filter("contour_id = 3"), 1.0).collect()] == [(2, 2)]


def test_samples_are_complete_from_three_tenths_on(spark, tmp_path):
    """the bound of complete_samples is the one it was made with, 0.3, in Spark and in SQL."""
    rows = [(s, n, "F" if n < 5 else "O", d) for s, d in ((1, 0.04), (2, 0.02)) for n in (1, 2, 3, 4, 5)]
    made = spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_linestatus string, l_discount double")
    made.selectExpr("*", "1d AS l_quantity", "0.01d AS l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert con.execute(SQL["complete_samples"]).fetchall() == [(1,)]
    assert [r.sample for r in QUERIES["complete_samples"](spark, str(tmp_path)).collect()] == [1]


@pytest.fixture(scope="module")
def split_metrics(tmp_path_factory):
    """Rows of line items in many row groups; half of the means lie next to 0.05 or 0.03 and fall on a side by the order of their sum."""
    folder = tmp_path_factory.mktemp("split")
    value = "CASE WHEN i % 3 = 0 THEN 0.05 WHEN i // 3 % 2 = 0 THEN {0} + j * 0.01 ELSE {0} - j * 0.01 END"
    rows = f"""SELECT i, 1 + i % 60 AS l_suppkey, 1 + hash(i) % 4 AS l_linenumber, CASE WHEN hash(i, 1) % 4 < 3 THEN 'F' ELSE 'O' END AS l_linestatus,
 ({value.format("0.05")}) * CASE WHEN i % 60 < 30 THEN 1 ELSE 0.6 END AS l_discount, 1e0 AS l_quantity, 1e-2 AS l_tax FROM (SELECT i, hash(i, 2) % 5 AS j FROM range(60000) r(i))"""
    con = duckdb.connect()
    con.execute("set threads=1")
    con.execute(f"COPY (SELECT * EXCLUDE (i, l_discount, l_suppkey, l_linenumber), l_discount::double AS l_discount, l_suppkey::bigint AS l_suppkey, l_linenumber::int AS l_linenumber FROM ({rows}) ORDER BY i) TO '{folder}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    return folder, con


def _equal_in_order(spark, split_metrics, name):
    folder, con = split_metrics
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        out = QUERIES[name](spark, str(folder))
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(map(str, out.select(names).collect())) == sorted(map(str, spark.createDataFrame(found.fetchall(), out.select(names).schema).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_means_on_a_bound_complete_samples(spark, split_metrics):
    _equal_in_order(spark, split_metrics, "complete_samples")


def test_means_on_a_bound_missing_layers(spark, split_metrics):
    _equal_in_order(spark, split_metrics, "missing_layers")


def test_means_on_a_bound_parameter_files(spark, split_metrics):
    _equal_in_order(spark, split_metrics, "parameter_files")
