"""Views that give the shapes of the engine's inputs on the provided tables; the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "v_pixels": """
SELECT sample, x, y,
  CASE WHEN da < cast(0.07 as double) THEN 'L1' WHEN da < cast(0.35 as double) THEN 'L2/3'
       WHEN da < cast(0.5 as double) THEN 'L4' ELSE 'L5/6' END AS algo_layer,
  CASE WHEN dg < 0 OR dg >= 1 THEN NULL WHEN dg < cast(0.07 as double) THEN 'L1'
       WHEN dg < cast(0.35 as double) THEN 'L2/3' WHEN dg < cast(0.5 as double) THEN 'L4' ELSE 'L5/6' END AS gt_layer
FROM (SELECT l_returnflag AS sample, cast(l_partkey % 100 AS int) AS x, cast(l_orderkey % 100 AS int) AS y,
        cast(l_orderkey % 100 AS double) / 100 AS da,
        cast(l_orderkey % 100 + 3 * (sum(l_linenumber) % 7 - 3) AS double) / 100 AS dg
      FROM {lineitem} GROUP BY l_returnflag, l_partkey % 100, l_orderkey % 100) t""",
    "v_cells": """
SELECT l_returnflag AS sample, cast(l_partkey AS double) AS cx,
  l_quantity * 20 + cast(l_suppkey % 20 AS double) AS cy, 20 + l_linenumber AS area_px,
  (l_quantity - 1) / 49 AS depth,
  cast(0.5 as double) + cast(0.3 as double) * exp(-power((l_quantity - 1) / 49 - cast(0.25 as double), 2) / cast(0.005 as double))
    + cast(0.4 as double) * exp(-power((l_quantity - 1) / 49 - cast(0.55 as double), 2) / cast(0.008 as double))
    + l_discount / 10 AS density FROM {lineitem}""",
    "v_boundary": """
SELECT b.boundary, cast(p.p_partkey AS int) AS x, cast(b.base + p.p_size AS double) AS y,
  cast(b.base + p.p_size AS double) + cast(p.p_partkey % 7 AS double) AS y_gt
FROM {part} p CROSS JOIN (VALUES ('pia',0),('L1_2',70),('L3_4',350),('L4_5',500),('white',1000)) AS b(boundary, base)""",
    "v_vertices": """
SELECT user_id AS contour_id,
  cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bigint) AS seq,
  cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS double) AS x,
  value AS y, event_type FROM {events}""",
    "v_metrics": """
SELECT l_suppkey AS sample,
  CASE l_linenumber WHEN 1 THEN 'L1' WHEN 2 THEN 'L2/3' WHEN 3 THEN 'L4' ELSE 'L5/6' END AS layer,
  CASE l_linestatus WHEN 'F' THEN 'coarse' ELSE 'refined' END AS type,
  avg(l_discount) * 10 AS iou, avg(l_quantity) AS avg_boundary_error_px, avg(l_tax) * 100 AS thickness_error_percent
FROM {lineitem} GROUP BY 1, 2, 3""",
    "v_gray": "SELECT l_returnflag AS sample, cast(floor(l_extendedprice / 412) AS int) AS v FROM {lineitem}",
    "v_points2d": "SELECT vec_id AS id, label, cast(embedding[{zero}] AS double) AS x, cast(embedding[{one}] AS double) AS y FROM {embeddings}",
    "v_pred": "SELECT doc_id, quality = 1 AS pred, toxic = 1 AS gt FROM {labels}",
}
SQL["v_colours"] = f"""
SELECT sample, x, y, greatest(0, least(255, base_b + noise)) AS b, greatest(0, least(255, base_g - noise)) AS g, greatest(0, least(255, base_r + noise)) AS r
FROM (SELECT sample, x, y, CASE WHEN x * y % 17 = 0 THEN 5 WHEN algo_layer IN ('L1', 'L5/6') THEN 255 ELSE 100 END AS base_b,
    CASE WHEN x * y % 17 = 0 THEN 5 WHEN algo_layer IN ('L2/3', 'L5/6') THEN 255 ELSE 100 END AS base_g,
    CASE WHEN x * y % 17 = 0 THEN 5 WHEN algo_layer = 'L4' THEN 255 ELSE 100 END AS base_r,
    CASE WHEN x * y % 17 = 0 THEN 0 ELSE (x * 7 + y * 13) % 41 - 20 END AS noise
  FROM ({SQL["v_pixels"]}) p) q"""
SQL["v_labels"] = f"""
SELECT sample, x, y, cast(floor(y / 10) * 10 + floor(x / 10) AS int) AS label FROM ({SQL["v_pixels"]}) p WHERE gt_layer = 'L4' OR gt_layer = 'L1'"""
SQL["v_raster"] = """
SELECT sample, x, y, cast(CASE WHEN away < cast(0.3 as double) THEN 20 WHEN away < 1 THEN 90 ELSE 200 END + noise AS int) AS v
FROM (SELECT l_returnflag AS sample, cast(l_partkey % 60 AS int) AS x, cast(l_orderkey % 44 AS int) AS y,
    cast((l_partkey % 60 - 29) * (l_partkey % 60 - 29) AS double) / 400 + cast((l_orderkey % 44 - 21) * (l_orderkey % 44 - 21) AS double) / 196 AS away,
    sum(l_linenumber) % 23 AS noise
  FROM {lineitem} GROUP BY l_returnflag, l_partkey % 60, l_orderkey % 44) t"""
#: The rows of v_metrics with means added up in the order of the file. Means that lie on a bound (0.5, say) fall on
#: one side or the other by the order of their sum, so queries that compare them with a bound use this one; the
#: other engine adds in this order too (with one thread).
_IN_ORDER = """
SELECT sample, layer, type, iou / n_iou * 10 AS iou, away / n_away AS avg_boundary_error_px, thick / n_thick * 100 AS thickness_error_percent
FROM (SELECT sample, layer, type, lead(1) OVER w IS NULL AS whole,
    sum(l_discount) OVER s AS iou, sum(l_quantity) OVER s AS away, sum(l_tax) OVER s AS thick,
    count(l_discount) OVER s AS n_iou, count(l_quantity) OVER s AS n_away, count(l_tax) OVER s AS n_thick
  FROM (SELECT l_suppkey AS sample, CASE l_linenumber WHEN 1 THEN 'L1' WHEN 2 THEN 'L2/3' WHEN 3 THEN 'L4' ELSE 'L5/6' END AS layer,
      CASE l_linestatus WHEN 'F' THEN 'coarse' ELSE 'refined' END AS type, l_discount, l_quantity, l_tax, file, place FROM {lineitem}) t
  WINDOW w AS (PARTITION BY sample, layer, type ORDER BY file, place),
    s AS (PARTITION BY sample, layer, type ORDER BY file, place ROWS UNBOUNDED PRECEDING)) q
WHERE whole"""
_TABLES = ("lineitem", "part", "events", "embeddings", "labels")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables of a folder; arrays count from 0."""
    if name == "v_metrics_in_order":
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        return spark.sql(_IN_ORDER, lineitem=rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
    used = [t for t in _TABLES if f"{{{t}}}" in SQL[name]]
    text = SQL[name].replace("{zero}", "0").replace("{one}", "1")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(query: str) -> str:
    """A query in the other engine's SQL, with the views it names before it; arrays count from 1."""
    places = {t: t for t in _TABLES} | {"zero": "1", "one": "2"}
    named = [f"{n} AS ({text.format(**places)})" for n, text in SQL.items() if n in query]
    text = query.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return head + ", ".join(named) + ", " + text[len(head) :]
    return "WITH " + ", ".join(named) + " " + query
