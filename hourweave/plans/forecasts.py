"""Forecast windows, evaluation and calibration over a feature table."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame

from hourweave.operators.conformal import apply_conformal, calibrate_conformal
from hourweave.operators.fill import fill_features
from hourweave.operators.forecasts import seasonal_ensemble, window_actuals


def split_bounds(train_end: date, val_end: date, last: datetime) -> dict[str, tuple[datetime, datetime]]:
    """First and last hour of the validation and test periods (whole days)."""
    midnight = time(0)
    val = datetime.combine(train_end + timedelta(days=1), midnight)
    test = datetime.combine(val_end + timedelta(days=1), midnight)
    return {"val": (val, test - timedelta(hours=1)), "test": (test, last)}


def filled_target(features: DataFrame) -> DataFrame:
    """The filled pm25 series forecasts are made from and scored against."""
    return fill_features(features.select("station_id", "timestamp", "pm25"), ["pm25"])


def ensemble_tables(
    filled: DataFrame, start: datetime, end: datetime, members: int = 14, stride: int = 24
) -> tuple[DataFrame, DataFrame]:
    """(samples, actuals) of the windows between start and end."""
    return (
        seasonal_ensemble(filled, start, end, stride, members),
        window_actuals(filled, start, end, stride),
    )


def calibrate_and_apply(
    filled: DataFrame,
    bounds: dict[str, tuple[datetime, datetime]],
    alpha: float = 0.10,
    members: int = 14,
) -> tuple[DataFrame, DataFrame]:
    """Margins from the validation windows and metrics on the test windows."""
    margins = calibrate_conformal(*ensemble_tables(filled, *bounds["val"], members), alpha)
    test_samples, test_actuals = ensemble_tables(filled, *bounds["test"], members)
    return margins, apply_conformal(test_samples, test_actuals, margins)


