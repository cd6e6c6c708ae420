"""Scaling, training windows and rolling forecast instances."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import moment
from hourweave.operators.blocks import block_of, hour_number, in_time, own_rows, with_halo
from hourweave.operators.ordered import dense_index


# --- scaler ----------------------------------------------------------------

def fit_scaler(df: DataFrame, columns: list[str] | tuple = model.MODEL_INPUTS) -> DataFrame:
    """(feature, mean, std): nulls skipped, population std, a zero std becomes 1."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(x).alias("mean"),
                # merged partial deviations of a constant need not cancel to exactly 0
                F.when(F.min(x) == F.max(x), 1.0).otherwise(F.stddev_pop(x)).alias("std"),
            )
        )
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str] | tuple = model.MODEL_INPUTS) -> DataFrame:
    """(x - mean) / std, then null to 0. The scaler enters as one scalar row."""
    row = scaler.agg(
        F.struct(
            *[
                F.max(F.when(F.col("feature") == c, F.struct("mean", "std"))).alias(c)
                for c in columns
            ]
        )
    ).scalar()
    held = df.withColumn("_scaler", row)
    scaled = {
        c: F.coalesce(
            (F.col(c).cast("double") - F.col("_scaler")[c]["mean"]) / F.col("_scaler")[c]["std"], F.lit(0.0)
        )
        for c in columns
    }
    return held.withColumns(scaled).drop("_scaler")


# --- split scans -----------------------------------------------------------

def with_boundary(df: DataFrame, split: str, previous: str, end: Column, hours: int = model.BOUNDARY_HOURS) -> DataFrame:
    """Rows of ``split`` plus those of ``previous`` from ``hours`` before midnight of its last day."""
    since = end.cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return df.where(
        (F.col("split") == split) | ((F.col("split") == previous) & (F.col("timestamp") >= since))
    )


# --- sequence windows ------------------------------------------------------

def training_windows(
    df: DataFrame,
    scaler: DataFrame,
    seq_len: int = model.SEQUENCE_HOURS,
    horizons: tuple = model.HORIZONS,
    columns: tuple = model.MODEL_INPUTS,
) -> DataFrame:
    """For each hour with ``seq_len`` rows before and ``max(horizons)`` after it:
    the scaled inputs of those rows before, and pm25 (unscaled) at each horizon.
    Windows with a missing target are dropped. Expects gridded series.
    """
    longest = max(horizons)
    base = df.select("station_id", "timestamp", F.col("pm25").alias("_target"), *columns)
    scaled = apply_scaler(base, scaler, columns)
    order = in_time()
    rows = with_halo(
        scaled.select("station_id", "timestamp", "_target", F.array(*columns).alias("_x")),
        before=seq_len,
        after=longest,
    ).withColumns(
        {
            "x": F.collect_list("_x").over(order.rowsBetween(-seq_len, -1)),
            "_more": F.lead("timestamp", longest).over(order),
        }
        | {f"y{h}": F.lead("_target", h).over(order) for h in horizons}
    )
    full = (F.size("x") == seq_len) & F.col("_more").isNotNull()
    targets = [f"y{h}" for h in horizons]
    kept = own_rows(rows.where(full)).na.drop(subset=targets)
    return kept.select("station_id", "timestamp", "x", *targets)


# --- rolling instances -----------------------------------------------------

_INSTANCE_ARRAYS = ("pm25",) + model.CALENDAR


def rolling_instances(
    df: DataFrame,
    start: datetime,
    end: datetime,
    context: int = model.CONTEXT_HOURS,
    horizon: int = model.HORIZONS[-1],
    stride: int = 24,
) -> DataFrame:
    """Forecast instances per (station, window_start) on a filled hourly table.

    Hours are first packed into slots of gcd(stride, context, horizon) hours;
    each slot is handed to the few windows that cover it, and windows short of
    context or future are dropped. No range join, and the exchange moves
    packed arrays rather than every hour (context + horizon) / stride times.
    """
    slot = math.gcd(stride, context, horizon)
    first = moment(start)
    at = hour_number(F.col("timestamp")) - hour_number(first)
    last_start = hour_number(moment(end)) - hour_number(first) + 1 - horizon
    packed = (
        df.where(F.col("timestamp") >= moment(start - timedelta(hours=context)))
        .where(F.col("timestamp") < moment(end + timedelta(hours=1)))
        .select(
            "station_id",
            F.floor(at / slot).alias("slot"),
            F.struct(
                at.alias("at"),
                F.col("pm25").cast("double").alias("pm25"),
                *[F.col(c).cast("double").alias(c) for c in model.CALENDAR],
            ).alias("row"),
        )
        .groupBy("station_id", "slot")
        .agg(F.collect_list("row").alias("rows"))
    )
    # windows whose [start - context, start + horizon) holds this slot
    offset = F.col("slot") * slot
    low = F.greatest(F.ceil((offset + slot - horizon) / stride), F.lit(0))
    high = F.least(F.floor((offset + context) / stride), F.floor(last_start / stride))
    spread = packed.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    rows = F.array_sort(F.flatten(F.collect_list("rows")))
    windows = spread.groupBy("station_id", "k").agg(rows.alias("rows"))
    begin = F.col("k") * stride
    past = F.filter("rows", lambda r: r["at"] < begin)
    future = F.filter("rows", lambda r: r["at"] >= begin)
    complete = windows.withColumns({"past": past, "future": future}).where(
        (F.size("past") == context) & (F.size("future") == horizon)
    )
    index = dense_index(df, "station_id")
    seconds = F.unix_seconds(first) + begin * 3600
    return complete.join(index, "station_id").select(
        "station_id",
        F.col("ix").alias("station_ix"),
        F.timestamp_seconds(seconds).alias("window_start"),
        F.timestamp_seconds(seconds - context * 3600).alias("start"),
        F.col("past.pm25").alias("target"),
        *[F.col(f"rows.{c}").alias(c) for c in model.CALENDAR],
        F.col("future.pm25").alias("actuals"),
    )


def series_dataset(df: DataFrame, until: datetime | None = None) -> DataFrame:
    """One row per (station, time block): start, target array, calendar arrays.

    A station's series is the concatenation of its parts in ``part`` order; a
    single array per station would grow without bound.
    """
    rows = df if until is None else df.where(F.col("timestamp") <= moment(until))
    packed = rows.select(
        "station_id",
        block_of(F.col("timestamp")).alias("part"),
        F.struct("timestamp", F.col("pm25").cast("double").alias("pm25"), *[F.col(c).cast("double").alias(c) for c in model.CALENDAR]).alias("row"),
    )
    series = packed.groupBy("station_id", "part").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    index = dense_index(df, "station_id")
    return series.join(index, "station_id").select(
        "station_id",
        F.col("ix").alias("station_ix"),
        "part",
        F.col("rows.timestamp")[0].alias("start"),
        F.col("rows.pm25").alias("target"),
        *[F.col(f"rows.{c}").alias(c) for c in model.CALENDAR],
    )
