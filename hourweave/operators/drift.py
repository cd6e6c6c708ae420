"""Drift of features and predictions over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave.operators.blocks import hour_number
from hourweave.operators.ordered import exact_quantiles, running_totals

DRIFT_FEATURES = ("pm25", "pm25_roll6", "pm25_lag24", "spatial_pm25_lag1", "no2", "o3")
BINS = 10
FLOOR = 1e-4


def add_batch(df: DataFrame, ts: str, batches: int = 4) -> DataFrame:
    """Number 1..batches by equal stretches of time between the first and last row."""
    hour = hour_number(F.col(ts))
    span = df.agg(F.struct(F.min(hour).alias("lo"), F.max(hour).alias("hi"))).scalar()
    held = df.withColumn("_span", span)
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    return held.withColumn(
        "batch", (F.floor((hour - lo) * batches / (hi - lo + 1)) + 1).cast("int")
    ).drop("_span")


def melted(df: DataFrame, features: tuple, *keep: Column | str) -> DataFrame:
    """Long form. Values are rounded to 9 places: weighted means that are equal but
    for the order of summation must fall on the same side of a bin edge."""
    return df.select(
        *keep,
        F.inline(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col(f), 9).alias("value")) for f in features])
        ),
    ).where(F.col("value").isNotNull())


def psi(
    train: DataFrame, test: DataFrame, features: tuple = DRIFT_FEATURES, batches: int = 4
) -> DataFrame:
    """Population stability index per feature and test batch, on train deciles."""
    reference = melted(train, features)
    cuts = exact_quantiles(
        reference, ["feature"], "value", lambda n: [F.lit(i / BINS) for i in range(1, BINS)]
    )
    edges = cuts.groupBy("feature").agg(F.array_sort(F.collect_list("quantile")).alias("edges"))
    per_feature = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges")))).scalar()

    def binned(df: DataFrame) -> DataFrame:
        # the edges travel as one small scalar: at most BINS - 1 numbers per feature
        held = df.withColumn("_edges", per_feature)
        below = F.filter(F.col("_edges")[F.col("feature")], lambda e: e < F.col("value"))
        return held.withColumn("bin", F.size(below)).drop("_edges")

    def shares(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        counts = df.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
        per_key = counts.groupBy(*keys).agg(
            F.sum("n").alias("all"),
            F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"),
        )
        bins = F.sequence(F.lit(0), F.lit(BINS - 1))
        return per_key.select(
            *keys,
            F.transform(
                bins, lambda b: F.greatest(F.coalesce(F.col("m")[b], F.lit(0)) / F.col("all"), F.lit(FLOOR))
            ).alias(name),
        )

    base = shares(binned(reference), ["feature"], "q")
    batched = melted(add_batch(test, "timestamp", batches), features, "batch")
    current = shares(binned(batched), ["feature", "batch"], "p")
    terms = F.zip_with("p", "q", lambda p, q: (p - q) * F.ln(p / q))
    return current.join(base, "feature").select(
        "feature", "batch", F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x).alias("psi")
    )


def ks_statistic(df: DataFrame, value: str, batches: int = 4) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of batches 2.. to batch 1 (``batch`` column)."""
    against = F.array(*[F.lit(b) for b in range(2, batches + 1)])
    tagged = df.select("batch", value).withColumn(
        "versus", F.explode(F.when(F.col("batch") == 1, against).otherwise(F.array("batch")))
    )
    counted = tagged.select(
        "versus",
        value,
        (F.col("batch") == 1).cast("bigint").alias("first"),
        (F.col("batch") != 1).cast("bigint").alias("other"),
    )
    totals = running_totals(counted, ["versus"], value, ["first", "other"])
    gap = F.abs(
        F.col("upto_first") / F.nullif(F.col("total_first"), F.lit(0))
        - F.col("upto_other") / F.nullif(F.col("total_other"), F.lit(0))
    )
    return totals.groupBy("versus").agg(
        F.max(gap).alias("ks"),
        F.max("total_first").alias("n_first"),
        F.max("total_other").alias("n_other"),
    )


def brier_drift(per_batch: DataFrame, baseline: DataFrame, worse: float = 0.10) -> DataFrame:
    """Flag batches whose Brier score exceeds the baseline's by more than ``worse``."""
    base = baseline.agg(
        F.struct(
            F.max("advisory_brier").alias("advisory"), F.max("warning_brier").alias("warning")
        )
    ).scalar()
    held = per_batch.withColumn("_base", base)

    def drifted(tier: str) -> Column:
        return F.col(f"{tier}_brier") > F.col("_base")[tier] * (1 + worse)

    return held.select(
        "batch",
        "n",
        "advisory_brier",
        "warning_brier",
        F.coalesce(drifted("advisory"), F.lit(False)).alias("advisory_drift"),
        F.coalesce(drifted("warning"), F.lit(False)).alias("warning_drift"),
    )
