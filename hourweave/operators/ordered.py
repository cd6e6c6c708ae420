"""Exact order statistics of a few very large groups.

Ranking inside one window per key would send a quarter of all rows to one
task when there are four keys. Here equal values are first collapsed to one row
with a count (before the exchange, so a value shared by most rows costs
nothing). Splitters per key, approximate quantiles of its distinct values, cut them into ordered buckets of
nearly equal numbers of values, however narrow the band they lie in. Bucket totals then give each bucket its
exact offset, and only rows inside a bucket are ranked, so the result does not depend on the splitters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave.session import written

#: Distinct values a bucket of the largest key should hold, and the most buckets of a key.
BUCKET_VALUES = 2_000
MOST_BUCKETS = 1024


def _splitters(collapsed: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """(keys, _cuts): of each key the sorted values that end its buckets."""
    levels = [i / buckets for i in range(1, buckets)]
    marks = F.percentile_approx(value, levels, 4 * buckets)
    return collapsed.groupBy(*keys).agg(F.array_distinct(marks).cast("array<double>").alias("_cuts"))


def _bucket(cuts: Column, value: Column) -> Column:
    """How many cuts lie below the value, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MOST_BUCKETS.bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(cuts, at + step - 1) < value, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def _collapsed(df: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """Distinct (keys, value) with summed weights and ``_bucket``; written, since it is read more than once."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(w).alias(w) for w in weights])
    rows = written(rows, "ordered_values")
    # one number comes to the driver: how many distinct values the largest key has
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    buckets = min(-(-largest // BUCKET_VALUES), MOST_BUCKETS)
    if buckets <= 1:
        return rows.withColumn("_bucket", F.lit(0))
    # one row per key, written so that every use of the buckets has the same cuts
    cuts = written(_splitters(rows, keys, value, buckets), "ordered_cuts")
    held = rows.join(cuts, keys)
    return held.withColumn("_bucket", _bucket(F.col("_cuts"), F.col(value).cast("double"))).drop("_cuts")


def _bucket_offsets(collapsed: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    totals = collapsed.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(w) for w in weights])
    cols = {}
    for w in weights:
        cols[f"_before_{w}"] = F.coalesce(F.sum(w).over(order), F.lit(0))
        cols[f"total_{w}"] = F.sum(w).over(whole)
        cols[f"_in_{w}"] = F.col(w)
    return totals.withColumns(cols).drop(*weights)


def running_totals(df: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """Per distinct (keys, value): ``weights`` summed, ``upto_*`` (running, inclusive)
    and ``total_*``."""
    collapsed = _collapsed(df, keys, value, weights)
    offsets = _bucket_offsets(collapsed, keys, weights)
    order = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    joined = collapsed.join(offsets, [*keys, "_bucket"])
    out = joined.withColumns(
        {f"upto_{w}": F.col(f"_before_{w}") + F.sum(w).over(order) for w in weights}
    )
    return out.drop("_bucket", *[f"_before_{w}" for w in weights], *[f"_in_{w}" for w in weights])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, levels) -> DataFrame:
    """(keys, level_nr, n, level, quantile), linearly interpolated.

    ``levels`` is a function of the row count column returning a list of level
    columns, so a level may depend on the data.
    """
    counted = df.select(*keys, value, F.lit(1).cast("bigint").alias("_n"))
    collapsed = _collapsed(counted, keys, value, ["_n"])
    offsets = _bucket_offsets(collapsed, keys, ["_n"])
    n = F.col("total__n")
    place = (n - 1) * F.col("level")
    wanted = (
        offsets.select("*", F.posexplode(F.array(*levels(n))).alias("level_nr", "level"))
        .withColumn("_lo", F.floor(place) + 1)
        .withColumn("_hi", F.ceil(place) + 1)
        .where(
            (F.col("_before__n") < F.col("_hi"))
            & (F.col("_before__n") + F.col("_in__n") >= F.col("_lo"))
        )
    )
    order = W.partitionBy(*keys, "level_nr", "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = collapsed.join(wanted, [*keys, "_bucket"]).withColumn(
        "_upto", F.col("_before__n") + F.sum("_n").over(order)
    )

    def at(rank: str) -> Column:
        here = (F.col("_upto") - F.col("_n") < F.col(rank)) & (F.col("_upto") >= F.col(rank))
        return F.max(F.when(here, F.col(value)))

    picked = ranked.groupBy(*keys, "level_nr", F.col("total__n").alias("n"), "level").agg(
        at("_lo").alias("_below"), at("_hi").alias("_above")
    )
    fraction = (F.col("n") - 1) * F.col("level") - F.floor((F.col("n") - 1) * F.col("level"))
    return picked.withColumn(
        "quantile", F.col("_below") + (F.col("_above") - F.col("_below")) * fraction
    ).drop("_below", "_above")


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their 0-based position in sorted order (``ix``).

    Values are dealt to tasks by range, numbered inside their task and shifted by the sizes of the tasks
    before; only these sizes meet in one task. The dealing is written, so that sizes and numbers agree.
    """
    ranged = df.select(column).distinct().repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    dealt = written(ranged, "dense_index")
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_p").orderBy(column)
    return dealt.join(offsets, "_p").select(
        column, (F.col("_off") + F.row_number().over(inside) - 1).alias("ix")
    )
