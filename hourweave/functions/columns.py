"""Column expressions: validation, calendar, geometry, metrics."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave import model


# --- missing values --------------------------------------------------------

def finite(value: Column) -> Column:
    """NaN and infinities count as missing."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


# --- validation ------------------------------------------------------------

def outside(value: Column, bounds: tuple[float, float]) -> Column:
    low, high = bounds
    return (value < F.lit(low)) | (value > F.lit(high))


def range_flag(value: Column, parameter: Column) -> Column:
    """0 in range, 1 suspect, 2 invalid; unknown parameters and nulls give 0."""
    flag = F.lit(0)
    for name in reversed(model.PARAMETERS):
        tier = (
            F.when(outside(value, model.INVALID_BOUNDS[name]), 2)
            .when(outside(value, model.SUSPECT_BOUNDS[name]), 1)
            .otherwise(0)
        )
        flag = F.when(parameter == name, tier).otherwise(flag)
    return flag


def qualifier_flag(qualifier: Column) -> Column:
    return F.when(F.trim(F.coalesce(qualifier, F.lit(""))) == "", 0).otherwise(1)


def monitor_type(frequency: Column) -> Column:
    continuous = F.upper(F.coalesce(frequency, F.lit(""))).contains("CONTINUOUS")
    return F.when(continuous, "FEM").otherwise("FRM")


def by_parameter(values: dict, parameter: Column) -> Column:
    """Look a small constant up by parameter; null for unknown parameters."""
    out = None
    for name, value in values.items():
        branch = F.lit(value)
        out = F.when(parameter == name, branch) if out is None else out.when(parameter == name, branch)
    return out


# --- calendar --------------------------------------------------------------

def moment(when: datetime | date) -> Column:
    """A UTC instant. Written as text, because a naive ``datetime`` literal would be
    read in the zone of the driver machine."""
    if isinstance(when, datetime) and when.tzinfo is not None:
        when = when.astimezone(timezone.utc)
    text = when.strftime("%Y-%m-%d %H:%M:%S") if isinstance(when, datetime) else f"{when} 00:00:00"
    return F.lit(text).cast("timestamp")


def calendar(ts: Column) -> dict[str, Column]:
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": F.weekday(ts) >= 5,
    }


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(calendar(F.col(ts)))


def assign_split(ts: Column, train_end: date = model.TRAIN_END, val_end: date = model.VAL_END) -> Column:
    day = F.to_date(ts)
    return (
        F.when(day <= F.lit(train_end), "train")
        .when(day <= F.lit(val_end), "val")
        .otherwise("test")
    )


def in_box(lat: Column, lon: Column, box: tuple = model.STATION_BOX) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


# --- geometry --------------------------------------------------------------

def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * model.EARTH_RADIUS_KM)


def composite_distance(lat1, lon1, elev1, lat2, lon2, elev2, lam) -> Column:
    """Kilometres, with the squared elevation step (m) scaled by ``lam``."""
    ground = great_circle_km(lat1, lon1, lat2, lon2)
    return F.sqrt(F.pow(ground, 2) + lam * F.pow(elev1 - elev2, 2))


def epanechnikov(distance: Column, cutoff: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.pow(distance / cutoff, 2))


# --- aggregates ------------------------------------------------------------

def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over non-null values; null when no weight is left."""
    used = F.sum(F.when(value.isNotNull(), weight))
    return F.sum(weight * value) / F.nullif(used, F.lit(0.0))


def mape(predicted: Column, actual: Column, eps: float = 1.0) -> Column:
    return F.avg(F.abs(predicted - actual) / F.greatest(F.abs(actual), F.lit(eps))) * 100


# --- sorted arrays ---------------------------------------------------------

def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda."""
    return F.transform(F.array(value), body)[0]


def median_of(values: Column) -> Column:
    """Median of an array; nulls skipped, null for an empty array."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        below = F.get(s, F.floor((n - 1) / 2).cast("int"))
        above = F.get(s, F.floor(n / 2).cast("int"))
        return (below + above) / 2

    return let(F.sort_array(F.array_compact(values)), middle)


def quantile_of(ordered: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array without nulls."""
    place = (F.size(ordered) - 1) * F.lit(q)
    below = F.floor(place).cast("int")
    lower = F.get(ordered, below)
    upper = F.coalesce(F.get(ordered, below + 1), lower)
    return lower + (upper - lower) * (place - below)
