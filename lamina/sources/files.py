"""Point, boundary and scan files in, boundary and metric files out. Paths may hold many files of many samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted names of the coordinates, best first.
X_NAMES = ("x", "centroid_x")
Y_NAMES = ("y", "centroid_y")
#: Micrometres of a pixel where a scan does not say.
PIXEL_SCALE = 1.625
#: Pixels of the camera where a scan does not say: width, height.
CAMERA = (1376, 1024)
_PLACE = "struct<x:double,y:double>"
_SCAN = f"scan_info struct<pixel_scale:double,camera_resolution:array<double>,scan_area:struct<min_x:double,max_x:double,min_y:double,max_y:double>>, positions array<{_PLACE}>"


def _named(df: DataFrame, names: tuple[str, ...]) -> Column:
    have = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)
    for name in names:
        if name in have:
            return F.col(f"`{have[name]}`")
    raise ValueError(f"no column {' or '.join(names)} in {df.columns}")


def xy(df: DataFrame, *keep: str | Column) -> DataFrame:
    """The coordinates as doubles x and y, whatever they are called, after the columns to keep; text that is no number becomes null."""
    return df.select(*keep, _named(df, X_NAMES).try_cast("double").alias("x"), _named(df, Y_NAMES).try_cast("double").alias("y"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """file, x and y of point files with a header. All files of a path have the same columns."""
    found = spark.read.option("header", True).csv(path)
    return xy(found.withColumn("file", F.col("_metadata.file_path")), "file")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """file, boundary, x and y of files that tag their points with the boundary's name."""
    found = spark.read.option("header", True).csv(path)
    return xy(found.withColumn("file", F.col("_metadata.file_path")), "file", "boundary")


def read_scans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, scan_info and positions of scan descriptions, one row a file, or one row a line."""
    return spark.read.schema(_SCAN).option("multiLine", not lines).json(path).select(F.col("_metadata.file_path").alias("file"), "*")


def scan_start(scans: DataFrame) -> DataFrame:
    """Corner at which a scan starts: its first position less half a camera image; null without positions."""
    scale = F.coalesce("scan_info.pixel_scale", F.lit(PIXEL_SCALE))
    first = F.get("positions", F.lit(0))
    return scans.select("file", (first["x"] - CAMERA[0] * scale / 2).alias("start_x"), (first["y"] - CAMERA[1] * scale / 2).alias("start_y"))


def scan_extent(scans: DataFrame, width: int, height: int) -> DataFrame:
    """Physical corners of an image of so many pixels.

    Where a scan names no area, its positions span it; null if it has neither, or no scale. Where it
    names no camera, the image's own size stands for the camera's.
    """
    scale = F.col("scan_info.pixel_scale")
    low = lambda a: F.coalesce(f"scan_info.scan_area.min_{a}", F.array_min(F.transform("positions", lambda p: p[a])))
    side = lambda i, size: F.coalesce(F.get("scan_info.camera_resolution", F.lit(i)), F.lit(float(size)))
    cornered = scans.select("file", scale.alias("scale"), (low("x") - side(0, width) * scale / 2).alias("min_x"), (low("y") - side(1, height) * scale / 2).alias("min_y"))
    return cornered.select("*", (F.col("min_x") + width * F.col("scale")).alias("max_x"), (F.col("min_y") + height * F.col("scale")).alias("max_y"))


def write_each(rows: DataFrame, path: str) -> None:
    """Each row (value) as a text file of its own, by as many tasks as the cluster runs at once; tasks commit their files themselves."""
    many = rows.sparkSession.sparkContext.defaultParallelism * 4
    rows.repartition(many).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def read_offset(spark: SparkSession, path: str) -> DataFrame:
    """file, x_um and y_um of the files that give a lens offset; 0 where a part is missing."""
    found = spark.read.schema("Obj4X struct<x_um:double,y_um:double>").option("multiLine", True).json(path)
    part = lambda a: F.coalesce(f"Obj4X.{a}_um", F.lit(0.0)).alias(f"{a}_um")
    return found.select(F.col("_metadata.file_path").alias("file"), part("x"), part("y"))


def read_cells(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """cell_id, x, y, area_px and the columns to keep; cells without a number get one, without an area 0.

    Numbers given here are unique, not without gaps: counting them all would take one task.
    """
    found = spark.read.option("header", True).csv(path)
    have = {c.lower(): f"`{c}`" for c in found.columns}
    number = F.col(have["cell_id"]).cast("long") if "cell_id" in have else F.monotonically_increasing_id() + 1
    area = F.col(have["area_px"]).cast("int") if "area_px" in have else F.lit(0)
    return xy(found.withColumns({"_number": number, "_area": area}), F.col("_number").alias("cell_id"), F.col("_area").alias("area_px"), *keep)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header in the given types."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """sample, layer, start and end of tables of layers."""
    return read_table(spark, path, "sample string, layer string, start double, end double")


def first_two(df: DataFrame) -> DataFrame:
    """x and y by place: the first two columns, for files without names that tell."""
    return df.select(F.col(f"`{df.columns[0]}`").try_cast("double").alias("x"), F.col(f"`{df.columns[1]}`").try_cast("double").alias("y"))


def best_paths(listed: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """stem and path: for each stem the file whose extension comes first in order, in any case; others are left out."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    rank = F.array_position(F.array(*map(F.lit, extensions)), kind)
    return listed.withColumn("rank", rank).filter("rank > 0").groupBy("stem").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def write_table(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header."""
    rows.write.option("header", True).mode("errorifexists").csv(path)


def write_points(points: DataFrame, path: str) -> None:
    """x and y as CSV with a header; no points make a file of the header alone."""
    points = points.select("x", "y")
    (points.coalesce(1) if points.isEmpty() else points).write.option("header", True).mode("errorifexists").csv(path)


def write_boundaries(boundaries: DataFrame, path: str, places: int | None = None) -> None:
    """sample, boundary, x and y as CSV with a header, a folder a sample; rounded if `places` is given. An empty table writes no folder."""
    at = lambda c: F.col(c) if places is None else F.round(c, places).alias(c)
    rows = boundaries.select("sample", "boundary", at("x"), at("y")).repartition("sample", "boundary").sortWithinPartitions("sample", "boundary", "x")
    rows.write.partitionBy("sample").option("header", True).mode("errorifexists").csv(path)


def write_parameters(parameters: DataFrame, path: str) -> None:
    """Each row as one JSON text, nulls left in."""
    parameters.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
