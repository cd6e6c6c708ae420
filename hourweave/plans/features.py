"""Readings to the feature table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import add_calendar, assign_split
from hourweave.operators.grid import apply_validation, blocked_grid, null_invalid
from hourweave.operators.impute import MEDIAN_MAX, impute
from hourweave.operators.rolling import add_rolling_lags
from hourweave.operators.spatial import add_spatial


def clean_values(readings: DataFrame) -> DataFrame:
    return null_invalid(apply_validation(readings))


def imputed_grid(readings: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Validated, gridded and gap-filled wide table."""
    return impute(blocked_grid(clean_values(readings), halo=MEDIAN_MAX, settled=settled))


def to_feature_schema(df: DataFrame) -> DataFrame:
    """The fixed column list; absent columns become null."""
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in model.FEATURE_SCHEMA.fields
        ]
    )


def build_features(
    readings: DataFrame,
    stations: DataFrame,
    edges: DataFrame,
    train_end: date = model.TRAIN_END,
    val_end: date = model.VAL_END,
    settled: DataFrame | None = None,
    active: DataFrame | None = None,
) -> DataFrame:
    """Validate, grid, impute, roll, relate to neighbours, label. One lazy plan.

    ``settled`` holds final imputed hours that are taken as they are, and
    ``active`` the stations with data where ``readings`` is only a part of it.
    """
    if active is None:
        active = readings.select("station_id").distinct()
    base = add_rolling_lags(imputed_grid(readings, settled))
    full = add_spatial(base, edges, stations, active)
    labelled = add_calendar(full).withColumn(
        "split", assign_split(F.col("timestamp"), train_end, val_end)
    )
    return to_feature_schema(labelled)
