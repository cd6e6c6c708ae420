"""Landed provider records to readings and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import by_parameter, in_box, monitor_type, qualifier_flag


def first_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The ``values`` of the first row per key in ``order``.

    An aggregation, not a ranked window: partial results are combined before
    the exchange, so a key with very many copies sends one row per task.
    """
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def last_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def site_id():
    return F.concat_ws("-", "state_code", "county_code", "site_number")


def clean_samples(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Exploded sample rows to readings.

    Hourly rows of known stations with a measurement; where several
    instruments report the same hour, the lowest POC wins, of equal ones the first to be landed.
    """
    names = {code: p for p, code in model.PARAMETER_CODES.items()}
    parameter = by_parameter(names, F.col("parameter_code"))
    rows = samples.where(
        (F.col("sample_duration") == "1 HOUR") & F.col("sample_measurement").isNotNull()
    ).select(
        site_id().alias("station_id"),
        parameter.alias("parameter"),
        F.to_timestamp(F.concat_ws(" ", "date_gmt", "time_gmt"), "yyyy-MM-dd HH:mm").alias("timestamp"),
        F.col("sample_measurement").cast("double").alias("value"),
        by_parameter(model.UNITS, parameter).alias("unit"),
        qualifier_flag(F.col("qualifier")).alias("quality_flag"),
        F.coalesce(F.nullif(F.col("poc"), F.lit(0)), F.lit(99)).alias("poc"),
        "landed_at",
    )
    known = rows.where(F.col("parameter").isNotNull()).join(
        stations.select("station_id"), "station_id", "left_semi"
    )
    best = first_by(known, list(model.READING_KEY), ["poc", "landed_at"], ["value", "unit", "quality_flag"])
    return best.select(*[f.name for f in model.READING_SCHEMA.fields])


def build_stations(monitors: DataFrame, box: tuple = model.STATION_BOX) -> DataFrame:
    """Exploded monitor rows to one row per site: attributes of the open instrument inside
    the box that was landed first, FEM if any such instrument is continuous."""
    name = F.coalesce(F.nullif(F.col("local_site_name"), F.lit("")), F.col("address"), F.lit(""))
    closed = F.coalesce(F.col("close_date"), F.lit("")) != ""
    rows = monitors.where(
        F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
        & in_box(F.col("latitude"), F.col("longitude"), box)
        & ~closed
    ).select(
        site_id().alias("station_id"),
        F.struct(
            name.alias("name"),
            F.col("latitude").alias("lat"),
            F.col("longitude").alias("lon"),
            F.col("elevation").cast("double").alias("elevation_m"),
            "county_code",
            "state_code",
        ).alias("site"),
        "landed_at",
        (monitor_type(F.col("collection_frequency")) == "FEM").alias("fem"),
    )
    merged = rows.groupBy("station_id").agg(F.min_by("site", "landed_at").alias("site"), F.bool_or("fem").alias("fem"))
    return merged.select(
        "station_id", "site.*", F.when(F.col("fem"), "FEM").otherwise("FRM").alias("monitor_type")
    )
