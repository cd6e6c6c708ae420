"""Replay of stored readings as keyed messages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hourweave import model
from hourweave.sources.messages import to_message
from hourweave.sources.tables import date_range


def replay_messages(readings: DataFrame) -> DataFrame:
    """Messages with each station's rows in one task, in (timestamp, parameter) order."""
    names = [f.name for f in model.READING_SCHEMA.fields]
    ordered = readings.select(*names).repartition("station_id").sortWithinPartitions("timestamp", "station_id", "parameter")
    return to_message(ordered)


def replay(
    readings: DataFrame,
    sink: Callable[[DataFrame], None],
    date_from: str | None = None,
    date_to: str | None = None,
    slice_days: int = 30,
) -> int:
    """Send the readings of a date range slice by slice, oldest first.

    Slices keep the order per station across jobs and bound what a task sends
    for one station, however much history it has. Returns the number of messages sent, counted on
    their way by the jobs that the sink runs (at least one action per slice).
    """
    chosen = date_range(readings, date_from, date_to)
    day = F.to_date("timestamp")
    span = chosen.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    if span["a"] is None:
        return 0
    sent = 0
    for i in range((span["b"] - span["a"]).days // slice_days + 1):
        low = span["a"] + timedelta(days=i * slice_days)
        high = low + timedelta(days=slice_days)
        ts = F.col("timestamp")
        within = (ts >= F.lit(low).cast("timestamp")) & (ts < F.lit(high).cast("timestamp"))
        counted = Observation()
        sink(replay_messages(chosen.where(within)).observe(counted, F.count(F.lit(1)).alias("n")))
        sent += counted.get["n"]
    return sent
