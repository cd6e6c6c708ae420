"""Forward / backward fill of whole series, and runs of missing hours.

A fill may reach back any distance, so blocks alone do not do. Each block first
reports its last and first known values; these few rows per station are
carried forwards and backwards, and every block starts from what it is handed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave import model
from hourweave.operators.blocks import back_in_time, block_of, hour_number, in_time


def carried(df: DataFrame, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """Add ``ahead_of_*`` (last known value up to the row) and ``after_*`` (next known)."""
    series = ["station_id", *(extra or [])]
    base = df.withColumn("block", block_of(F.col("timestamp"))).repartition(*series, "block")
    known = {c: F.when(F.col(c).isNotNull(), F.col("timestamp")) for c in columns}
    ends = base.groupBy(*series, "block").agg(
        *[F.max_by(c, known[c]).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, known[c]).alias(f"_first_{c}") for c in columns],
    )
    earlier = W.partitionBy(*series).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*series).orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    handed = ends.select(
        *series,
        "block",
        *[F.last(f"_last_{c}", True).over(earlier).alias(f"_from_{c}") for c in columns],
        *[F.last(f"_first_{c}", True).over(later).alias(f"_to_{c}") for c in columns],
    )
    past = in_time(*(extra or [])).rowsBetween(W.unboundedPreceding, 0)
    ahead = back_in_time(*(extra or [])).rowsBetween(W.unboundedPreceding, 0)
    inside = base.withColumns({f"_p_{c}": F.last(c, True).over(past) for c in columns}).withColumns(
        {f"_q_{c}": F.last(c, True).over(ahead) for c in columns}
    )
    joined = inside.join(handed, [*series, "block"])
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_p_{c}", f"_from_{c}").alias(f"before_{c}") for c in columns],
        *[F.coalesce(f"_q_{c}", f"_to_{c}").alias(f"after_{c}") for c in columns],
    )


def fill_series(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per station: last value forward, then first value backward, then 0."""
    out = carried(df, columns)
    filled = {c: F.coalesce(f"before_{c}", f"after_{c}", F.lit(0.0)) for c in columns}
    return out.withColumns(filled).select(*df.columns)


def add_time_index(df: DataFrame) -> DataFrame:
    """``time_idx``: whole hours since the first hour of the whole table."""
    start = df.agg(F.min(hour_number(F.col("timestamp")))).scalar()
    return df.withColumn("time_idx", hour_number(F.col("timestamp")) - start)


def fill_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Model-ready table: booleans as numbers, no nulls, ``time_idx`` added."""
    columns = columns or [c for c in model.MODEL_INPUTS if c in df.columns]
    numeric = df.withColumns(
        {c: F.col(c).cast("double") for c in columns if dict(df.dtypes)[c] == "boolean"}
    )
    return add_time_index(fill_series(numeric, [c for c in columns if c not in model.CALENDAR]))


def gap_runs(grid: DataFrame) -> DataFrame:
    """Every run of missing hours per station and parameter, with its length and
    whether a value exists on either side."""
    long = grid.select(
        "station_id",
        "timestamp",
        F.inline(
            F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value")) for p in model.PARAMETERS])
        ),
    )
    hour = hour_number(F.col("timestamp"))
    marked = carried(long.withColumn("seen", F.when(F.col("value").isNotNull(), hour)), ["seen"], ["parameter"])
    return (
        marked.where(F.col("value").isNull())
        .groupBy("station_id", "parameter", "before_seen", "after_seen")
        .agg(
            F.min("timestamp").alias("run_start"),
            F.max("timestamp").alias("run_end"),
            F.count(F.lit(1)).alias("run_hours"),
        )
        .select(
            "station_id",
            "parameter",
            "run_start",
            "run_end",
            "run_hours",
            F.col("before_seen").isNotNull().alias("has_left"),
            F.col("after_seen").isNotNull().alias("has_right"),
        )
    )
