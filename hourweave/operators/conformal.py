"""Split-conformal widening of prediction intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourweave.operators.forecasts import KEY, sample_scores, score_metrics
from hourweave.operators.ordered import exact_quantiles


def conformal_margins(scores: DataFrame, alpha: float = 0.10) -> DataFrame:
    """(horizon, n, q_level, upper, lower, coverage_before, coverage_after).

    Margins are the ceil((n + 1)(1 - alpha)) / n quantiles of the overshoot
    above p95 and below p05. A level that depends on the row count rules the
    built-in percentile out; see ``ordered.exact_quantiles``.
    """
    shots = scores.select(
        "horizon",
        F.inline(
            F.array(
                F.struct(F.lit("upper").alias("side"), F.greatest(F.col("actual") - F.col("p95"), F.lit(0.0)).alias("shot")),
                F.struct(F.lit("lower").alias("side"), F.greatest(F.col("p05") - F.col("actual"), F.lit(0.0)).alias("shot")),
            )
        ),
    )

    def level(n):
        return [F.least(F.ceil((n + 1) * (1 - alpha)) / n, F.lit(1.0))]

    quantiles = exact_quantiles(shots, ["horizon", "side"], "shot", level)
    margins = quantiles.groupBy("horizon").agg(
        F.max("n").alias("n"),
        F.max("level").alias("q_level"),
        F.max(F.when(F.col("side") == "upper", F.col("quantile"))).alias("upper"),
        F.max(F.when(F.col("side") == "lower", F.col("quantile"))).alias("lower"),
    )
    before = F.col("actual").between(F.col("p05"), F.col("p95"))
    after = F.col("actual").between(F.col("p05") - F.col("lower"), F.col("p95") + F.col("upper"))
    coverage = (
        scores.join(margins.select("horizon", "upper", "lower"), "horizon")
        .groupBy("horizon")
        .agg(
            (F.avg(before.cast("double")) * 100).alias("coverage_before"),
            (F.avg(after.cast("double")) * 100).alias("coverage_after"),
        )
    )
    return margins.join(coverage, "horizon")


def calibrate_conformal(samples: DataFrame, actuals: DataFrame, alpha: float = 0.10) -> DataFrame:
    return conformal_margins(sample_scores(samples, actuals), alpha)


def widen(scores: DataFrame, margins: DataFrame) -> DataFrame:
    joined = scores.join(margins.select("horizon", "upper", "lower"), "horizon")
    return joined.withColumns(
        {"p05": F.col("p05") - F.col("lower"), "p95": F.col("p95") + F.col("upper")}
    ).drop("upper", "lower")


def apply_conformal(samples: DataFrame, actuals: DataFrame, margins: DataFrame) -> DataFrame:
    """Metrics after widening, with the margins of each horizon; p50 and CRPS stay."""
    metrics = score_metrics(widen(sample_scores(samples, actuals), margins))
    named = margins.select(
        F.col("horizon").cast("string").alias("horizon"),
        F.col("upper").alias("conformal_margin_upper"),
        F.col("lower").alias("conformal_margin_lower"),
    )
    return metrics.join(named, "horizon", "left")


__all__ = ["KEY", "apply_conformal", "calibrate_conformal", "conformal_margins", "widen"]
