"""Forecast tables: seasonal ensemble, scores, metrics.

samples:  (station_id, window_start, horizon, sample_id, value)
actuals:  (station_id, window_start, horizon, actual)
A horizon h is the h-th hour of a window: window_start + (h - 1) hours.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import moment, quantile_of
from hourweave.operators.blocks import hour_number

KEY = ("station_id", "window_start", "horizon")


def _start_hours(start: datetime, end: datetime, stride: int) -> tuple[Column, Column]:
    """Offset of the first start and the largest start number whose window fits."""
    first = hour_number(moment(start))
    last = hour_number(moment(end))
    return first, F.floor((last + 1 - model.HORIZONS[-1] - first) / stride)


def _within(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows from ``start`` to the hour of ``end``, as bounds on the column itself that a scan can use."""
    return df.where((F.col("timestamp") >= moment(start)) & (F.col("timestamp") < moment(end + timedelta(hours=1))))


def _horizon_array(horizons) -> Column:
    return F.array(*[F.lit(int(h)) for h in horizons])


def window_actuals(
    df: DataFrame, start: datetime, end: datetime, stride: int = 24, horizons: tuple = model.HORIZONS
) -> DataFrame:
    """Each hour is the outcome of at most one window per horizon: no join needed."""
    first, last_nr = _start_hours(start, end, stride)
    rows = _within(df, start, end).select(
        "station_id",
        hour_number(F.col("timestamp")).alias("_h"),
        F.col("pm25").alias("actual"),
        F.explode(_horizon_array(horizons)).alias("horizon"),
    )
    offset = F.col("_h") - (F.col("horizon") - 1) - first
    return rows.where(
        (F.pmod(offset, F.lit(stride)) == 0) & (offset >= 0) & (offset <= last_nr * stride)
    ).select(
        "station_id",
        F.timestamp_seconds((first + offset) * 3600).alias("window_start"),
        "horizon",
        "actual",
    )


def seasonal_ensemble(
    df: DataFrame,
    start: datetime,
    end: datetime,
    stride: int = 24,
    members: int = 14,
    horizons: tuple = model.HORIZONS,
) -> DataFrame:
    """The last ``members`` same-hour values before each window as its samples.

    On a filled hourly table the k-th latest same-hour value lies a fixed
    number of days before the target hour, so each hour names the windows it
    serves and no join or ranking is needed.
    """
    first, last_nr = _start_hours(start, end, stride)
    # the k-th latest same hour lies at most k days before its window starts
    rows = _within(df, start - timedelta(days=members), end).select(
        "station_id",
        hour_number(F.col("timestamp")).alias("_h"),
        F.col("pm25").alias("value"),
        F.explode(_horizon_array(horizons)).alias("horizon"),
    )
    # hours that cannot meet any start go before the samples fan out
    grain = math.gcd(24, stride)
    rows = rows.where(F.pmod(F.col("_h") - (F.col("horizon") - 1) - first, F.lit(grain)) == 0)
    rows = rows.withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(members))))
    days_back = F.floor((F.col("horizon") - 1) / 24) + F.col("sample_id")
    offset = F.col("_h") - (F.col("horizon") - 1) + days_back * 24 - first
    return rows.where(
        (F.pmod(offset, F.lit(stride)) == 0) & (offset >= 0) & (offset <= last_nr * stride)
    ).select(
        "station_id",
        F.timestamp_seconds((first + offset) * 3600).alias("window_start"),
        "horizon",
        "sample_id",
        "value",
    )


# --- per-forecast scores ---------------------------------------------------

def sample_quantiles(samples: DataFrame) -> DataFrame:
    """p05 / p50 / p95 per forecast. A group is one forecast's draws (some hundreds)."""
    xs = F.sort_array(F.collect_list("value"))
    return (
        samples.groupBy(*KEY)
        .agg(xs.alias("xs"))
        .select(
            *KEY,
            quantile_of(F.col("xs"), 0.05).alias("p05"),
            quantile_of(F.col("xs"), 0.50).alias("p50"),
            quantile_of(F.col("xs"), 0.95).alias("p95"),
            "xs",
        )
    )


def _mean_gap(xs: Column, actual: Column) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.abs(x - actual))
    return total / F.size(xs)


def _spread(xs: Column) -> Column:
    """Half the mean absolute difference of two draws, from the sorted draws."""
    n = F.size(xs)
    ranked = F.transform(xs, lambda x, i: x * (2 * (i + 1) - n - 1))
    total = F.aggregate(ranked, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 1, total / (n * (n - 1))).otherwise(0.0)


def sample_scores(samples: DataFrame, actuals: DataFrame) -> DataFrame:
    """Quantiles and the exact energy CRPS of every forecast with a known outcome."""
    joined = sample_quantiles(samples).join(actuals.where(F.col("actual").isNotNull()), list(KEY))
    return joined.select(
        *KEY,
        "p05",
        "p50",
        "p95",
        "actual",
        (_mean_gap(F.col("xs"), F.col("actual")) - _spread(F.col("xs"))).alias("crps"),
    )


def crps(samples: DataFrame, actuals: DataFrame) -> DataFrame:
    return sample_scores(samples, actuals).select(*KEY, "crps")


# --- metrics ---------------------------------------------------------------

def _metrics(scores: DataFrame, measures: dict[str, Column], finish: list[Column]) -> DataFrame:
    """Sums per horizon, then the overall row from these few rows.

    ``parts`` counts the horizons of a row and ``crps_means`` adds their means.
    """
    per = scores.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in measures.items()]
    )
    crps_mean = F.col("crps") / F.col("n") if "crps" in measures else F.lit(None).cast("double")
    per = per.withColumns({"parts": F.lit(1).cast("bigint"), "crps_means": crps_mean})
    sums = ["n", *measures, "parts", "crps_means"]
    overall = per.agg(*[F.sum(c).alias(c) for c in sums]).withColumn("horizon", F.lit("overall"))
    rows = per.withColumn("horizon", F.col("horizon").cast("string")).unionByName(overall)
    return rows.select("horizon", "n", *finish)


def _point(predicted: Column, actual: Column) -> dict[str, Column]:
    return {"ae": F.abs(predicted - actual), "se": F.pow(predicted - actual, 2)}


def _band(low: Column, high: Column, actual: Column) -> dict[str, Column]:
    return {"hit": actual.between(low, high).cast("double"), "width": high - low}


def _mean(name: str) -> Column:
    return F.col(name) / F.col("n")


def _point_out() -> list[Column]:
    return [_mean("ae").alias("mae"), F.sqrt(_mean("se")).alias("rmse")]


def _band_out() -> list[Column]:
    return [(_mean("hit") * 100).alias("pi_coverage_pct"), _mean("width").alias("mean_width")]


def evaluate_point(forecasts: DataFrame, actuals: DataFrame, eps: float = 1.0) -> DataFrame:
    """MAE, RMSE, MAPE per horizon and overall; forecasts carry ``predicted``."""
    scores = forecasts.join(actuals.where(F.col("actual").isNotNull()), list(KEY))
    measures = _point(F.col("predicted"), F.col("actual"))
    measures["ape"] = F.abs(F.col("predicted") - F.col("actual")) / F.greatest(
        F.abs(F.col("actual")), F.lit(eps)
    )
    return _metrics(scores, measures, [*_point_out(), (_mean("ape") * 100).alias("mape")])


def interval_metrics(scores: DataFrame) -> DataFrame:
    """Point metrics of p50, coverage and width of [p05, p95]; no samples needed."""
    measures = _point(F.col("p50"), F.col("actual")) | _band(F.col("p05"), F.col("p95"), F.col("actual"))
    return _metrics(scores, measures, [*_point_out(), *_band_out()])


def evaluate_quantiles(quantiles: DataFrame, actuals: DataFrame) -> DataFrame:
    return interval_metrics(quantiles.join(actuals.where(F.col("actual").isNotNull()), list(KEY)))


def score_metrics(scores: DataFrame) -> DataFrame:
    """Adds CRPS; its overall value is the mean of the horizons' means."""
    measures = (
        _point(F.col("p50"), F.col("actual"))
        | _band(F.col("p05"), F.col("p95"), F.col("actual"))
        | {"crps": F.col("crps")}
    )
    out = [*_point_out(), *_band_out(), (F.col("crps_means") / F.col("parts")).alias("crps")]
    return _metrics(scores, measures, out)


def evaluate_samples(samples: DataFrame, actuals: DataFrame) -> DataFrame:
    return score_metrics(sample_scores(samples, actuals))
