"""Queries that fit models: Gaussian-process layers and the refinement of boundaries. SQL cannot fit them; tests use plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import boundaries as B
from lamina.operators import density as D
from lamina.operators import features as X
from lamina.operators import gaussian_process as G
from lamina.operators import refinement as R
from lamina.operators.staging import kept
from lamina.registry import add


def _gp_layers(cells: DataFrame) -> DataFrame:
    return G.gp_layers(kept(D.curve(cells), "curve"))


add("gp_layers", "v_cells", _gp_layers, None, "start end mean_density uncertainty")


def _refined(boundary: DataFrame, points: DataFrame) -> DataFrame:
    """Mean error of the inner boundaries before and after a model, trained on their even columns, has moved them."""
    keyed = boundary.withColumn("id", F.concat_ws(":", "boundary", F.col("x").cast("string")))
    cells = points.filter("label >= 2").select((F.col("x") * 1000 + 1000).alias("x"), (F.col("y") * 1000 + 400).alias("y"))
    rows = kept(X.boundary_features(keyed, cells, 2000.0, 1000.0, 100.0, 40.0), "features")
    model = R.train(rows.filter("x % 2 = 0"), "residual", 0.02, rounds=30, patience=12)
    moved = R.refined(rows.select("boundary", "x", "y", "y_gt", "features"), model)
    truth = rows.select("boundary", "x", F.col("y_gt").alias("y"))
    errors = B.mean_absolute_error(moved, truth, "boundary", {"y": "mae_before", "refined": "mae_after"})
    return errors.withColumn("improvement", B.improvement_percent(F.col("mae_before"), F.col("mae_after")))


add("refined_boundaries", "v_boundary v_points2d", _refined, None, "mae_before mae_after improvement")
