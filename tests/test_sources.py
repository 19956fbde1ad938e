"""Files written and read again, and scan descriptions with parts missing."""

import json

import pytest
from pyspark.sql import functions as F

from lamina.sources import files
from lamina.views import view


def test_points_by_any_name(spark, tmp_path):
    for i, head in enumerate(["id,Centroid_X,Centroid_Y", "X,Y,x2", "y,x"]):
        (tmp_path / f"{i}.csv").write_text(f"{head}\n1,2,3\nbad,,4\n")
    got = [[(r.x, r.y) for r in files.read_points(spark, str(tmp_path / f"{i}.csv")).collect()] for i in range(3)]
    assert got == [[(2, 3), (None, 4)], [(1, 2), (None, None)], [(2, 1), (None, None)]]
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_points(spark, str(tmp_path / "none.csv"))


def test_boundaries_round_trip(spark, tmp_path):
    rows = view(spark, "/root/testdata/sf0.001", "v_boundary").select(F.lit("s1").alias("sample"), "boundary", F.col("x").cast("double").alias("x"), (F.col("y") + 0.26).alias("y"))
    files.write_boundaries(rows, str(tmp_path / "out"), 1)
    back = files.read_boundaries(spark, str(tmp_path / "out"))
    want = rows.select("boundary", "x", F.round("y", 1).alias("y"))
    assert back.count() == rows.count() and back.select("boundary", "x", "y").exceptAll(want).count() == 0


def test_scans_with_and_without_area(spark, tmp_path):
    area = {"min_x": 10.0, "max_x": 50.0, "min_y": 20.0, "max_y": 60.0}
    scans = {
        "a": {"scan_info": {"pixel_scale": 2.0, "camera_resolution": [100, 50], "scan_area": area}, "positions": [{"x": 5, "y": 6}]},
        "b": {"scan_info": {"pixel_scale": 1.0}, "positions": [{"x": 9, "y": 3}, {"x": 4, "y": 8}]},
        "c": {"positions": []},
    }
    for name, scan in scans.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(scan, indent=1))
    read = files.read_scans(spark, str(tmp_path))
    extent = {r.file[-6]: r[1:] for r in files.scan_extent(read, 30, 20).collect()}
    assert extent == {"a": (2.0, -90.0, -30.0, -30.0, 10.0), "b": (1.0, -11.0, -7.0, 19.0, 13.0), "c": (None,) * 5}
    start = {r.file[-6]: (r.start_x, r.start_y) for r in files.scan_start(read).collect()}
    assert start == {"a": (5 - 1376.0, 6 - 1024.0), "b": (9 - 688.0, 3 - 512.0), "c": (None, None)}


def test_offset_and_parameters(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"Obj4X": {"x_um": 59.8}}))
    assert files.read_offset(spark, str(tmp_path / "o.json")).first()[1:] == (59.8, 0.0)
    files.write_parameters(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "p"))
    assert json.loads(spark.read.text(str(tmp_path / "p")).first().value) == {"a": 1, "b": None}


def test_a_file_for_each_row_by_many_tasks(spark, tmp_path):
    """files of one row are not all written by one task."""
    files.write_each(spark.range(100).coalesce(1).selectExpr("cast(id AS string) AS value"), str(tmp_path / "each"))
    made = [p.name for p in (tmp_path / "each").glob("part-*")]
    assert len(made) == 100 and len({n.split("-")[1] for n in made}) > 4
    assert sorted(int(r.value) for r in spark.read.text(str(tmp_path / "each")).collect()) == list(range(100))
