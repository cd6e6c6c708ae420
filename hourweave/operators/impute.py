"""Tiered gap filling on the hourly grid.

Runs of 1-3 missing hours with both flanks are interpolated; runs of 4-24 hours
take the median of same-hour values of the last 7 days (at least 4 of them) or
else of the last 14 days; longer runs stay missing. Filled hours count as
values for later medians.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import let, median_of
from hourweave.operators.blocks import back_in_time, block_of, hour_number, in_time

LINEAR_MAX = 3
MEDIAN_MAX = 24
SHORT_DAYS = 7
LONG_DAYS = 14
MIN_SAMPLES = 4
_FOLD_DAYS = 32


def linear_and_pending(
    grid: DataFrame, linear_max: int = LINEAR_MAX, median_max: int = MEDIAN_MAX, halo: int = MEDIAN_MAX
) -> DataFrame:
    """First tier, plus ``pending``: a bit per parameter that awaits the median tier.

    ``grid`` comes from ``blocked_grid`` with ``halo`` hours, at least ``median_max``
    of them. A run that reaches beyond the halo measures longer than
    ``median_max``, which is all that matters about it.
    """
    if max(linear_max, median_max) > halo:
        raise ValueError(f"gaps of up to {max(linear_max, median_max)} hours need a grid with as long a halo, not {halo} hours")
    params = model.PARAMETERS
    hour = hour_number(F.col("timestamp"))
    past = in_time().rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = back_in_time().rowsBetween(W.unboundedPreceding, W.currentRow)

    def known(side: str, order) -> dict[str, Column]:
        """Hour and value of the nearest known reading per parameter, and the outermost hour."""
        found = {f"_{side}_end": F.first("_h").over(order)}
        for p in params:
            found[f"_{side}h_{p}"] = F.last(F.when(F.col(p).isNotNull(), F.col("_h")), True).over(order)
            found[f"_{side}v_{p}"] = F.last(p, True).over(order)
        return found

    marked = grid.withColumn("_h", hour).withColumns(known("l", past)).withColumns(known("r", ahead))
    marked = marked.where(F.col("block") == block_of(F.col("timestamp")))

    values, pending = [], F.lit(0)
    for bit, p in enumerate(params):
        left_h, left_v = F.col(f"_lh_{p}"), F.col(f"_lv_{p}")
        right_h, right_v = F.col(f"_rh_{p}"), F.col(f"_rv_{p}")
        gap = F.coalesce(right_h, F.col("_r_end") + 1) - F.coalesce(left_h, F.col("_l_end") - 1) - 1
        missing = F.col(p).isNull()
        line = left_v + (right_v - left_v) * (F.col("_h") - left_h) / (gap + 1)
        value = F.when(missing & (gap <= linear_max), line).otherwise(F.col(p))
        waits = missing & gap.between(linear_max + 1, median_max)
        if "settled" in grid.columns:
            final = F.col("settled").isNotNull()
            value = F.when(final, F.col("settled")[p]).otherwise(value)
            waits = waits & ~final
        values.append(value.alias(p))
        pending = pending.bitwiseOR(F.when(waits, 1 << bit).otherwise(0))
    return marked.select("station_id", "timestamp", *values, pending.alias("pending"))


def _middle(ordered: Column, most_nulls: int) -> Column:
    """Median of a sorted ``SHORT_DAYS`` array that starts with at most ``most_nulls`` nulls."""

    def between(nulls: int) -> Column:
        low, high = (SHORT_DAYS - 1 + nulls) // 2, (SHORT_DAYS + nulls) // 2
        return (F.get(ordered, F.lit(low)) + F.get(ordered, F.lit(high))) / 2

    out = F.when(F.get(ordered, F.lit(0)).isNotNull(), between(0))
    for nulls in range(1, most_nulls):
        out = out.when(F.get(ordered, F.lit(nulls)).isNotNull(), between(nulls))
    return out.otherwise(between(most_nulls))


def _fold(days: Column, nr: Column) -> Column:
    """Walk the days of one (station, hour-of-day) in order, filling parameter ``nr``.

    The accumulator holds the last 14 days and the current stretch of days;
    finished stretches are set aside, so the work stays linear in the days.
    """

    def fill(so_far: Column) -> Column:
        # sorted with nulls first, enough values are there when this place holds one
        enough = SHORT_DAYS - MIN_SAMPLES

        def pick(short: Column) -> Column:
            return F.when(F.get(short, F.lit(enough)).isNotNull(), _middle(short, enough)).otherwise(
                median_of(F.slice(so_far, -LONG_DAYS, LONG_DAYS))
            )

        return let(F.sort_array(F.slice(so_far, -SHORT_DAYS, SHORT_DAYS)), pick)

    bits = F.array(*[F.lit(1 << bit) for bit in range(len(model.PARAMETERS))])

    def value(day: Column) -> Column:
        return F.get(day["v"], nr)

    def waits(day: Column) -> Column:
        return day["pending"].bitwiseAND(F.get(bits, nr)) != 0

    def add_day(so_far: Column, day: Column) -> Column:
        return F.array_append(so_far, F.when(waits(day), fill(so_far)).otherwise(value(day)))

    nothing = F.array_repeat(F.lit(None).cast("double"), LONG_DAYS)

    def add_stretch(done: Column, part: Column) -> Column:
        before = F.when(F.size(done) == 0, nothing).otherwise(
            F.slice(F.element_at(done, -1), -LONG_DAYS, LONG_DAYS)
        )
        stretch = F.slice(days, part * _FOLD_DAYS + 1, _FOLD_DAYS)
        return F.array_append(done, let(stretch, lambda s: add_days(before, s)))

    def add_days(before: Column, stretch: Column) -> Column:
        as_is = F.concat(before, F.transform(stretch, value))
        return F.when(F.exists(stretch, waits), F.aggregate(stretch, before, add_day)).otherwise(as_is)

    stretches = F.sequence(F.lit(0), F.floor((F.size(days) - 1) / _FOLD_DAYS).cast("int"))
    folded = F.aggregate(stretches, F.array().cast("array<array<double>>"), add_stretch)
    filled = F.flatten(
        F.transform(folded, lambda s: F.slice(s, LONG_DAYS + 1, F.greatest(F.size(s) - LONG_DAYS, F.lit(0))))
    )
    return F.when(F.exists(days, waits), filled).otherwise(F.transform(days, value))


def fill_pending(df: DataFrame) -> DataFrame:
    """Second tier. Same-hour values lie 24 h apart and a run of at most 24 hours
    never holds two of them, so each (station, hour of day) is a chain over days
    on its own. A group holds one element per day of record, whatever the load.
    """
    params = model.PARAMETERS
    days = F.sort_array(F.collect_list(F.struct("timestamp", F.array(*params).alias("v"), "pending")))
    grouped = (
        df.withColumn("_hod", F.hour("timestamp")).groupBy("station_id", "_hod").agg(days.alias("days"))
    )
    numbers = F.sequence(F.lit(0), F.lit(len(params) - 1))
    filled = grouped.select(
        "station_id", "days", F.transform(numbers, lambda nr: _fold(F.col("days"), nr)).alias("by_param")
    ).select(
        "station_id",
        F.arrays_zip(
            F.col("days.timestamp").alias("timestamp"),
            *[F.col("by_param")[nr].alias(p) for nr, p in enumerate(params)],
        ).alias("z"),
    )
    # the outer form keeps Spark from testing size(z) > 0 first, which would fold twice
    return filled.select("station_id", F.inline_outer("z"))


def impute(
    blocked: DataFrame, linear_max: int = LINEAR_MAX, median_max: int = MEDIAN_MAX, halo: int = MEDIAN_MAX
) -> DataFrame:
    return fill_pending(linear_and_pending(blocked, linear_max, median_max, halo))
