"""Neighbour features: every row is sent along the edges to the stations that
listen to it, and each station-hour averages what arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourweave.functions.columns import weighted_mean
from hourweave.operators.blocks import in_time, own_rows, with_halo

_SOURCES = ("pm25", "no2", "o3", "pm25_roll6")
_LAGGED = {
    "spatial_pm25_lag1": ("pm25", 1),
    "spatial_pm25_lag3": ("pm25", 3),
    "spatial_pm25_roll6": ("pm25_roll6", 0),
    "spatial_no2_lag1": ("no2", 1),
    "spatial_o3_lag1": ("o3", 1),
}
#: Types that Spark's hash aggregation can hold.
_FIXED_WIDTH = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.BooleanType, T.TimestampType, T.DateType)


def with_elevation_gap(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """Attach the absolute elevation step to edges read from an index file."""
    if "elev_gap" in edges.columns:
        return edges
    height = F.coalesce(F.col("elevation_m"), F.lit(0.0))
    here = stations.select("station_id", height.alias("_here"))
    there = stations.select(F.col("station_id").alias("neighbor_id"), height.alias("_there"))
    return (
        edges.join(here, "station_id", "left")
        .join(there, "neighbor_id", "left")
        .withColumn(
            "elev_gap", F.abs(F.coalesce("_here", F.lit(0.0)) - F.coalesce("_there", F.lit(0.0)))
        )
        .drop("_here", "_there")
    )


def _weights(edges: DataFrame, settings: list | None) -> DataFrame:
    """(station_id, to, w0, w1, ..): per edge one weight per setting, null where the setting lacks it."""
    ends = [F.col("neighbor_id").alias("station_id"), F.col("station_id").alias("to")]
    if not settings:
        return edges.select(*ends, F.col("weight").alias("w0"))
    weight = F.col("weight")
    chosen = [
        F.max(F.when((F.col("lam") == float(lam)) & (F.col("cutoff") == float(cutoff)), weight)).alias(f"w{i}")
        for i, (lam, cutoff) in enumerate(settings)
    ]
    return edges.groupBy("neighbor_id", "station_id").agg(*chosen).select(*ends, *[f"w{i}" for i in range(len(settings))])


def _sends(features: DataFrame, heard: DataFrame) -> DataFrame:
    """Each row once per listening station with the edge's weights, and once for its own station (``is_own``).

    One join: senders also list themselves, and stations without listeners come
    out of the left join unmatched. No hint, so Spark broadcasts the edges
    only while they are small and can split a station that holds many rows.
    """
    senders = heard.select("station_id").distinct()
    own = senders.select("station_id", F.col("station_id").alias("to"), F.lit(True).alias("is_own"))
    both = heard.withColumn("is_own", F.lit(False)).unionByName(own, allowMissingColumns=True)
    routed = features.join(both, "station_id", "left")
    routed = routed.withColumn("is_own", F.coalesce("is_own", F.lit(True)))
    return routed.withColumn("station_id", F.coalesce("to", "station_id")).drop("to")


def _own_columns(features: DataFrame, keep: list[str]) -> dict[str, Column]:
    """What an own copy carries, by name: ``keep`` and a mark under the empty name, or all in a struct that is the mark."""
    if keep and all(isinstance(features.schema[c].dataType, _FIXED_WIDTH) for c in keep):
        return {"": F.lit(True)} | {c: F.col(c) for c in keep}
    return {"": F.struct(*keep)}


def neighbor_arrays(features: DataFrame, edges: DataFrame, settings: list | None = None) -> DataFrame:
    """Own rows plus the lagged neighbour means, each an array with one place per setting (null where nothing is known).

    One pass: a row becomes its own copy and one contribution per listening
    station. The columns of the own copy are null in contributions. Where all of them are of a fixed width
    they stay columns, so that hours meet by hashing; a struct of others would have Spark sort all contributions. Lags are taken on the receiving station's grid. One row per station and hour is expected. With
    ``settings`` the edges carry (lam, cutoff): a row is still sent once per edge that any
    setting has, with all weights of the edge, and the settings part after the sums.
    """
    keep = [c for c in features.columns if c not in ("station_id", "timestamp")]
    rows = with_halo(features, before=max(k for _, k in _LAGGED.values()))
    weights = [f"w{i}" for i in range(len(settings or [None]))]
    routed = _sends(rows, _weights(edges, settings))
    # a contribution without any value changes no mean
    routed = routed.where(F.col("is_own") | F.coalesce(*_SOURCES).isNotNull())
    own = _own_columns(features, keep)
    packed = routed.select(
        "station_id",
        "block",
        "timestamp",
        *[F.when(F.col("is_own"), c).alias(f"_own_{n}") for n, c in own.items()],
        *weights,
        *[F.when(~F.col("is_own"), F.col(s)).alias(f"_{s}") for s in _SOURCES],
    )
    merged = (
        packed.repartition("station_id", "block")
        .groupBy("station_id", "block", "timestamp")
        .agg(
            *[F.first(f"_own_{n}", ignorenulls=True).alias(f"_own_{n}") for n in own],
            *[weighted_mean(F.col(f"_{s}"), F.col(w)).alias(f"_{s}_{w}") for s in _SOURCES for w in weights],
        )
        .where(F.col("_own_").isNotNull())
        .select(
            "station_id", "block", "timestamp", *[f"_own_{n}" for n in own],
            *[F.array(*[f"_{s}_{w}" for w in weights]).alias(f"_{s}") for s in _SOURCES],
        )
    )
    order = in_time()
    lagged = {
        name: (F.lag(f"_{source}", k).over(order) if k else F.col(f"_{source}"))
        for name, (source, k) in _LAGGED.items()
    }
    out = own_rows(merged.withColumns(lagged))
    back = [F.col("_own_.*")] if len(own) == 1 else [F.col(f"_own_{n}").alias(n) for n in keep]
    return out.select("station_id", "timestamp", *back, *_LAGGED)


def neighbor_means(features: DataFrame, edges: DataFrame, settings: list | None = None) -> DataFrame:
    """Own rows plus the lagged neighbour means; with ``settings`` once for each (lam, cutoff), see ``neighbor_arrays``."""
    means = neighbor_arrays(features, edges, settings)
    if not settings:
        return means.select(*[F.get(c, F.lit(0)).alias(c) if c in _LAGGED else c for c in means.columns])
    each = [
        F.struct(
            F.lit(float(lam)).alias("lam"), F.lit(float(cutoff)).alias("cutoff"),
            *[F.get(c, F.lit(i)).alias(c) for c in _LAGGED],
        )
        for i, (lam, cutoff) in enumerate(settings)
    ]
    own = [c for c in means.columns if c not in _LAGGED]
    return means.select(*own, F.explode(F.array(*each)).alias("_s")).select("_s.lam", "_s.cutoff", *own, *[f"_s.{c}" for c in _LAGGED])


def elevation_difference(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Weighted elevation step to neighbours that have data; weights are not rescaled."""
    return (
        edges.join(active.select(F.col("station_id").alias("neighbor_id")), "neighbor_id", "left_semi")
        .groupBy("station_id")
        .agg(F.sum(F.col("weight") * F.col("elev_gap")).alias("spatial_elev_diff"))
    )


def add_spatial(
    features: DataFrame, edges: DataFrame, stations: DataFrame, active: DataFrame | None = None
) -> DataFrame:
    """The six neighbour columns. ``active`` lists the stations with data, if known."""
    if active is None:
        active = features.select("station_id").distinct()
    edges = with_elevation_gap(edges, stations)
    return neighbor_means(features, edges).join(
        elevation_difference(edges, active), "station_id", "left"
    )
