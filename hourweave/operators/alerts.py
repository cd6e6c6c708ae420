"""Threshold breaches, station risk, status and alert quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave import model
from hourweave.operators.forecasts import KEY

MIN_SIGMA = 1e-6
ACTIVE_AT = 0.5


def _share_above(value: Column, threshold: float) -> Column:
    return F.avg((value > threshold).cast("double"))


def breach_probability(
    samples: DataFrame,
    advisory: float = model.ADVISORY_THRESHOLD,
    warning: float = model.WARNING_THRESHOLD,
) -> DataFrame:
    """P(value > threshold) per tier and the spread of the samples."""
    value = F.col("value")
    return samples.groupBy(*KEY).agg(
        _share_above(value, advisory).alias("p_advisory"),
        _share_above(value, warning).alias("p_warning"),
        F.stddev_pop(value).alias("sigma"),
    )


def _precision_weighted(probability: Column, sigma: Column) -> Column:
    weight = 1 / F.greatest(sigma, F.lit(MIN_SIGMA))
    return F.sum(weight * probability) / F.sum(weight)


def risk_score(breaches: DataFrame) -> DataFrame:
    """Breach probabilities over the horizons, weighted by 1 / sigma."""
    return breaches.groupBy("station_id", "window_start").agg(
        _precision_weighted(F.col("p_advisory"), F.col("sigma")).alias("advisory_score"),
        _precision_weighted(F.col("p_warning"), F.col("sigma")).alias("warning_score"),
    )


def status_of(advisory_score: Column, warning_score: Column, active_at: float = ACTIVE_AT) -> Column:
    return (
        F.when(warning_score >= active_at, "WARNING")
        .when(advisory_score >= active_at, "ADVISORY")
        .otherwise("CLEAR")
    )


def station_status(scores: DataFrame, active_at: float = ACTIVE_AT) -> DataFrame:
    return scores.withColumn(
        "status", status_of(F.col("advisory_score"), F.col("warning_score"), active_at)
    )


def _outcomes(breaches: DataFrame, actuals: DataFrame) -> DataFrame:
    return breaches.join(actuals.where(F.col("actual").isNotNull()), list(KEY))


def _brier(probability: Column, actual: Column, threshold: float) -> Column:
    return F.avg(F.pow(probability - (actual > threshold).cast("double"), 2))


def brier(
    breaches: DataFrame,
    actuals: DataFrame,
    by: list[Column] | None = None,
    advisory: float = model.ADVISORY_THRESHOLD,
    warning: float = model.WARNING_THRESHOLD,
) -> DataFrame:
    """Brier score of both tiers, by horizon unless ``by`` says otherwise."""
    return _outcomes(breaches, actuals).groupBy(*(by or [F.col("horizon")])).agg(
        F.count(F.lit(1)).alias("n"),
        _brier(F.col("p_advisory"), F.col("actual"), advisory).alias("advisory_brier"),
        _brier(F.col("p_warning"), F.col("actual"), warning).alias("warning_brier"),
    )


def alert_quality(
    breaches: DataFrame,
    actuals: DataFrame,
    active_at: float = ACTIVE_AT,
    advisory: float = model.ADVISORY_THRESHOLD,
) -> DataFrame:
    """Precision and recall of advisory alerts per horizon."""
    alert = F.col("p_advisory") >= active_at
    event = F.col("actual") > advisory
    counts = _outcomes(breaches, actuals).groupBy("horizon").agg(
        F.count_if(alert).alias("n_alerts"),
        F.count_if(event).alias("n_events"),
        F.count_if(alert & event).alias("n_hits"),
    )
    hits = F.col("n_hits").cast("double")
    return counts.withColumns(
        {
            "precision": hits / F.nullif(F.col("n_alerts"), F.lit(0)),
            "recall": hits / F.nullif(F.col("n_events"), F.lit(0)),
        }
    )


def threshold_sensitivity(
    samples: DataFrame,
    settings: list[tuple[float, float, float]],
    base: tuple[float, float, float] = (model.ADVISORY_THRESHOLD, model.WARNING_THRESHOLD, ACTIVE_AT),
) -> DataFrame:
    """How many (station, window) statuses differ from ``base`` under each
    (advisory, warning, active_at). One scan: a probability column per distinct threshold."""
    everything = [base, *settings]
    thresholds = sorted({t for a, w, _ in everything for t in (a, w)})
    column = {t: f"p{i}" for i, t in enumerate(thresholds)}
    value = F.col("value")
    shares = samples.groupBy(*KEY).agg(
        F.stddev_pop(value).alias("sigma"),
        *[_share_above(value, t).alias(column[t]) for t in thresholds],
    )
    scores = shares.groupBy("station_id", "window_start").agg(
        *[_precision_weighted(F.col(column[t]), F.col("sigma")).alias(column[t]) for t in thresholds]
    )

    def status(setting) -> Column:
        a, w, active_at = setting
        return status_of(F.col(column[a]), F.col(column[w]), active_at)

    counted = scores.agg(
        F.array(
            *[
                F.struct(
                    F.lit(float(s[0])).alias("advisory"),
                    F.lit(float(s[1])).alias("warning"),
                    F.lit(float(s[2])).alias("active_at"),
                    F.count(F.lit(1)).alias("n_statuses"),
                    F.count_if(status(s) != status(base)).alias("n_changed"),
                )
                for s in settings
            ]
        ).alias("rows")
    )
    return counted.select(F.inline("rows"))
