"""Time blocks: the unit of work for everything ordered in time.

A window per station would put the whole history of one station into one task.
Frames here are bounded, so each series is cut into blocks of ``BLOCK_HOURS``
and every block also receives the few rows before and after it that its
frames reach (the halo). Halo rows are dropped once the window is computed, so
results equal the uncut windows while a station of any length is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_HOURS = 2160
_BLOCK_SECONDS = BLOCK_HOURS * 3600


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_seconds(ts) / 3600)


def block_of(ts: Column, shift_hours: int = 0) -> Column:
    return F.floor((F.unix_seconds(ts) + shift_hours * 3600) / _BLOCK_SECONDS)


def block_start(block: Column) -> Column:
    return F.timestamp_seconds(block * _BLOCK_SECONDS)


def with_halo(df: DataFrame, before: int = 0, after: int = 0, ts: str = "timestamp") -> DataFrame:
    """Add ``block``; rows in a neighbouring block's halo are repeated there.

    ``before`` / ``after`` are the hours a frame reaches back / ahead.
    """
    if max(before, after) >= BLOCK_HOURS:
        raise ValueError(f"a halo must be shorter than a block ({BLOCK_HOURS} h)")
    stamp = F.col(ts)
    member_of = [block_of(stamp)]
    if before:
        member_of.append(block_of(stamp, before))
    if after:
        member_of.append(block_of(stamp, -after))
    if len(member_of) == 1:
        return df.withColumn("block", member_of[0])
    return df.withColumn("block", F.explode(F.array_distinct(F.array(*member_of))))


def own_rows(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Drop halo rows."""
    return df.where(F.col("block") == block_of(F.col(ts))).drop("block")


def in_time(*extra: str, ts: str = "timestamp") -> W:
    return W.partitionBy("station_id", "block", *extra).orderBy(ts)


def back_in_time(*extra: str, ts: str = "timestamp") -> W:
    """Reverse order: a running frame here looks ahead at running-frame cost."""
    return W.partitionBy("station_id", "block", *extra).orderBy(F.col(ts).desc())
