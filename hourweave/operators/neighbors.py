"""The kernel-weighted neighbour graph of the stations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import composite_distance, epanechnikov


def station_pairs(stations: DataFrame, reach_km: float) -> DataFrame:
    """Ordered pairs of distinct stations that may lie within ``reach_km``.

    An equi-join on grid cells instead of a product: a station sits in one
    cell, and its partner is listed in every cell its reach touches, so each
    close pair meets exactly once. The elevation term only adds distance, so
    ground reach is enough.
    """
    reach = reach_km / model.EARTH_RADIUS_KM
    cell = math.degrees(reach)
    around = max(1, math.ceil(360.0 / cell))
    lat, lon = F.col("lat"), F.col("lon")

    def row_of(latitude: Column) -> Column:
        return F.floor(latitude / cell)

    def column_of(longitude: Column) -> Column:
        return F.pmod(F.floor((longitude + 180.0) / cell), F.lit(around))

    near_pole = F.abs(lat) + cell >= 90.0
    half_width = F.when(near_pole, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.lit(math.sin(reach)) / F.cos(F.radians(lat)), F.lit(1.0))))
    )
    rows = F.sequence(row_of(lat - cell), row_of(lat + cell))
    steps = F.when(near_pole, F.sequence(F.lit(0), F.lit(around - 1).cast("bigint"))).otherwise(
        F.sequence(
            F.floor((lon + 180.0 - half_width) / cell), F.floor((lon + 180.0 + half_width) / cell)
        )
    )
    columns = F.array_distinct(F.transform(steps, lambda s: F.pmod(s, F.lit(around))))

    elevation = F.coalesce(F.col("elevation_m"), F.lit(0.0))
    left = stations.select(
        "station_id",
        lat.alias("lat_a"),
        lon.alias("lon_a"),
        elevation.alias("elev_a"),
        row_of(lat).alias("cell_row"),
        column_of(lon).alias("cell_col"),
    )
    right = stations.select(
        F.col("station_id").alias("neighbor_id"),
        lat.alias("lat_b"),
        lon.alias("lon_b"),
        elevation.alias("elev_b"),
        F.explode(rows).alias("cell_row"),
        columns.alias("_cols"),
    ).withColumn("cell_col", F.explode("_cols")).drop("_cols")
    return (
        left.join(right, ["cell_row", "cell_col"])
        .where(F.col("station_id") != F.col("neighbor_id"))
        .drop("cell_row", "cell_col")
    )


def _distance(lam: Column) -> Column:
    c = F.col
    return composite_distance(c("lat_a"), c("lon_a"), c("elev_a"), c("lat_b"), c("lon_b"), c("elev_b"), lam)


def neighbor_edges_grid(stations: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """Edges for every (lam, cutoff) of ``grid`` from one pass over the pairs."""
    settings = F.array(
        *[
            F.struct(F.lit(float(lam)).alias("lam"), F.lit(float(cutoff)).alias("cutoff"))
            for lam, cutoff in grid
        ]
    )
    reach = max(cutoff for _, cutoff in grid)
    pairs = station_pairs(stations, reach).withColumn("setting", F.explode(settings))
    distance = _distance(F.col("setting.lam"))
    kernel = pairs.select(
        F.col("setting.lam").alias("lam"),
        F.col("setting.cutoff").alias("cutoff"),
        "station_id",
        "neighbor_id",
        F.abs(F.col("elev_a") - F.col("elev_b")).alias("elev_gap"),
        epanechnikov(distance, F.col("setting.cutoff")).alias("kernel"),
    ).where(F.col("kernel") > 0)
    total = F.sum("kernel").over(W.partitionBy("lam", "cutoff", "station_id"))
    return kernel.withColumn("weight", F.col("kernel") / total).drop("kernel")


def neighbor_edges(
    stations: DataFrame,
    lam: float = model.ELEVATION_LAMBDA,
    cutoff: float = model.DISTANCE_CUTOFF_KM,
) -> DataFrame:
    """(station_id, neighbor_id, weight, elev_gap); weights of a station sum to 1.

    Stations without neighbours have no edge; join back to the stations to see them.
    """
    return neighbor_edges_grid(stations, [(lam, cutoff)]).select(
        "station_id", "neighbor_id", "weight", "elev_gap"
    )


def neighbor_counts(stations: DataFrame, edges: DataFrame) -> DataFrame:
    degree = edges.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    return stations.select("station_id").join(degree, "station_id", "left").select(
        "station_id", F.coalesce("n", F.lit(0)).alias("n_neighbors")
    )


def neighbor_summary(stations: DataFrame, edges: DataFrame) -> DataFrame:
    n = F.col("n_neighbors")
    return neighbor_counts(stations, edges).agg(
        F.count(F.lit(1)).alias("n_stations"),
        F.min(n).alias("min_neighbors"),
        F.max(n).alias("max_neighbors"),
        F.avg(n).alias("mean_neighbors"),
        F.count_if(n == 0).alias("n_isolated"),
    )


def top_neighbors(edges: DataFrame, k: int = 5) -> DataFrame:
    best = W.partitionBy("station_id").orderBy(F.col("weight").desc(), "neighbor_id")
    return edges.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
