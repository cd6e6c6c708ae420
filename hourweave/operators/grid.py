"""Validation, long-to-wide pivot and the complete hourly grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import finite, range_flag
from hourweave.operators.blocks import BLOCK_HOURS, block_of, block_start, own_rows, with_halo


def apply_validation(readings: DataFrame) -> DataFrame:
    """Raise ``quality_flag`` to the range flag; an existing flag never drops."""
    value = finite(F.col("value"))
    return readings.withColumns(
        {
            "value": value,
            "quality_flag": F.greatest(
                F.coalesce(F.col("quality_flag"), F.lit(0)), range_flag(value, F.col("parameter"))
            ),
        }
    )


def null_invalid(readings: DataFrame) -> DataFrame:
    """Rows flagged invalid stay, their value becomes missing."""
    return readings.withColumn("value", F.when(F.col("quality_flag") < 2, F.col("value")))


def _spread(readings: DataFrame) -> list[Column]:
    return [F.when(F.col("parameter") == p, F.col("value")).alias(p) for p in model.PARAMETERS]


def wide_readings(readings: DataFrame) -> DataFrame:
    """One row per observed station-hour, one column per known parameter.

    Expects one row per (station, parameter, timestamp): see ``duplicate_keys``.
    """
    return (
        readings.select("station_id", "timestamp", *_spread(readings))
        .groupBy("station_id", "timestamp")
        .agg(*[F.max(p).alias(p) for p in model.PARAMETERS])
    )


def station_spans(readings: DataFrame) -> DataFrame:
    """First and last hour of each station over all parameters."""
    return readings.groupBy("station_id").agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


def _empty_hours(spans: DataFrame, halo: int) -> DataFrame:
    """Every hour of every (station, block), halo included.

    The exchange carries one row per station and block and spreads the hours,
    which only come into being after it, over all tasks.
    """
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = spans.withColumn(
        "block", F.explode(F.sequence(block_of(F.col("first_ts")), block_of(F.col("last_ts"))))
    ).repartition(tasks, "station_id", "block")
    hour = F.expr("interval 1 hour")
    start = block_start(F.col("block"))
    low = F.greatest(F.col("first_ts"), start - hour * halo)
    high = F.least(F.col("last_ts"), start + hour * (BLOCK_HOURS + halo - 1))
    return blocks.select("station_id", "block", F.explode(F.sequence(low, high, hour)).alias("timestamp"))


def blocked_grid(readings: DataFrame, halo: int, settled: DataFrame | None = None) -> DataFrame:
    """Wide hourly grid per (station, block) with ``halo`` extra hours on both sides.

    Empty hours and readings meet in one exchange on (station, block): the
    aggregation pivots and fills the grid, and the windows that follow reuse
    the partitioning. ``settled`` (station_id, timestamp, one column per
    parameter) adds already final hours as ``settled_*`` columns; the grid then
    also covers them.
    """
    params = list(model.PARAMETERS)
    known = readings
    spans_of = readings.select("station_id", "timestamp")
    if settled is not None:
        spans_of = spans_of.unionByName(settled.select("station_id", "timestamp"))
    hours = _empty_hours(station_spans(spans_of), halo)
    observed = with_halo(known.select("station_id", "timestamp", *_spread(known)), halo, halo)
    rows = hours.unionByName(observed, allowMissingColumns=True)
    merged = [F.max(p).alias(p) for p in params]
    if settled is not None:
        final = with_halo(
            settled.select(
                "station_id", "timestamp", F.struct(*params).alias("settled")
            ),
            halo,
            halo,
        )
        rows = rows.unionByName(final, allowMissingColumns=True)
        merged.append(F.max("settled").alias("settled"))
    return (
        rows.repartition("station_id", "block")
        .groupBy("station_id", "block", "timestamp")
        .agg(*merged)
    )


def hourly_grid(readings: DataFrame) -> DataFrame:
    """Each station from its first to its last hour, without holes."""
    return own_rows(blocked_grid(readings, halo=0)).select("station_id", "timestamp", *model.PARAMETERS)
