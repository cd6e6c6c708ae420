"""Search over the neighbour-graph parameters."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave import model
from hourweave.operators.blocks import in_time, own_rows, with_halo
from hourweave.operators.neighbors import neighbor_edges_grid
from hourweave.operators.spatial import neighbor_arrays, neighbor_means
from hourweave.session import written

_BASE = ("pm25", "no2", "o3", "pm25_roll6", "split")


def default_grid() -> list[tuple[float, float]]:
    return list(product(model.LAMBDA_GRID, model.CUTOFF_GRID))


def spatial_by_setting(features: DataFrame, stations: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """The neighbour columns for every (lam, cutoff), recomputed in one job."""
    edges = neighbor_edges_grid(stations, grid)
    base = features.select("station_id", "timestamp", *_BASE)
    means = neighbor_means(base, edges, settings=grid)
    elevation = edges.join(
        features.select(F.col("station_id").alias("neighbor_id")).distinct(), "neighbor_id", "left_semi"
    ).groupBy("lam", "cutoff", "station_id").agg(
        F.sum(F.col("weight") * F.col("elev_gap")).alias("spatial_elev_diff")
    )
    return means.join(elevation, ["lam", "cutoff", "station_id"], "left")


def spatial_param_search(
    features: DataFrame,
    stations: DataFrame,
    grid: list[tuple[float, float]] | None = None,
    horizons: tuple = model.HORIZONS,
) -> DataFrame:
    """Settings ranked by validation MAE, best first.

    The score is the error, averaged over the horizons, of a straight line from
    the lagged neighbour mean to pm25, fitted on train rows from grouped sums.
    Targets are attached before the rows fan out, once for all settings.
    """
    grid = list(dict.fromkeys(grid or default_grid()))
    order = in_time()
    ahead = with_halo(features.select("station_id", "timestamp", *_BASE), after=max(horizons))
    # columns of fixed width, see neighbor_means
    ys = [f"_y{h}" for h in horizons]
    targets = own_rows(ahead.withColumns({f"_y{h}": F.lead("pm25", h).over(order) for h in horizons})).withColumns(
        {f"_{s}": F.col("split") == s for s in ("train", "val")}
    )
    edges = neighbor_edges_grid(stations, grid)
    spatial = neighbor_arrays(targets.drop("split"), edges, settings=grid)
    wanted = spatial.where(F.col("_train") | F.col("_val")).select("_train", "_val", *ys, F.col("spatial_pm25_lag1").alias("xs"))
    # the lines need all train rows before the first error: written, so that the rows are made once
    points = (
        written(wanted, "search_rows")
        .select("_train", "_val", *ys, F.posexplode("xs").alias("setting", "x"))
        .where(F.col("x").isNotNull())
        .select("_train", "_val", "setting", "x", F.posexplode(F.array(*ys)).alias("nr", "y"))
        .where(F.col("y").isNotNull())
    )

    keys = ["setting", "nr"]
    lines = (
        points.where("_train")
        .groupBy(*keys)
        .agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    )
    errors = (
        points.where("_val")
        .join(lines, keys)
        .groupBy(*keys)
        .agg(F.avg(F.abs(F.col("intercept") + F.col("slope") * F.col("x") - F.col("y"))).alias("mae"))
    )
    named = F.array(*[F.struct(F.lit(float(lam)).alias("lam"), F.lit(float(cutoff)).alias("cutoff")) for lam, cutoff in grid])
    means = errors.groupBy("setting").agg(F.avg("mae").alias("val_mae"))
    scored = means.select(F.get(named, F.col("setting")).alias("_s"), "val_mae").select("_s.lam", "_s.cutoff", "val_mae")
    best = W.orderBy("val_mae", "lam", "cutoff")  # one row per setting
    return scored.withColumn("rank", F.row_number().over(best)).orderBy("rank")
