"""Quality checks on readings. Each returns its violations; ``check_summary`` counts them.

Checks that only need counts share one pass (``null_counts``); grouped checks
aggregate before the exchange.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import by_parameter, outside
from hourweave.operators.ordered import exact_quantiles
from hourweave.session import written

SERIES = ("station_id", "parameter")


def _count() -> Column:
    return F.count(F.lit(1))


def day_cube(readings: DataFrame) -> DataFrame:
    """(station_id, parameter, day, n, n_valid, earliest, latest): what the checks of series, days and months are made of.

    ``completeness``, ``low_coverage``, ``crowded_days``, ``monthly_counts`` and the checks built on them take it in place of
    readings. It has a row per series and day, so a suite of checks need not read the readings once each.
    """
    return readings.groupBy(*SERIES, F.to_date("timestamp").alias("day")).agg(
        *[c.alias(name) for name, c in _figures(readings).items()]
    )


def _figures(rows: DataFrame) -> dict[str, Column]:
    """Aggregates over readings, or over the rows of their ``day_cube``."""
    if "earliest" in rows.columns:
        return {"n": F.sum("n"), "n_valid": F.sum("n_valid"), "earliest": F.min("earliest"), "latest": F.max("latest")}
    return {
        "n": _count(),
        "n_valid": F.count_if(F.col("value").isNotNull() & (F.col("quality_flag") == 0)),
        "earliest": F.min("timestamp"),
        "latest": F.max("timestamp"),
    }


def _day(rows: DataFrame) -> Column:
    return F.col("day") if "earliest" in rows.columns else F.to_date("timestamp")


# --- keys ------------------------------------------------------------------

def duplicate_keys(readings: DataFrame) -> DataFrame:
    return readings.groupBy(*model.READING_KEY).agg(_count().alias("n")).where(F.col("n") > 1)


def key_counts(readings: DataFrame) -> DataFrame:
    """Rows and distinct keys, from one pre-aggregated pass over the keys."""
    per_key = readings.groupBy(*model.READING_KEY).agg(_count().alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), _count().alias("n_keys")).withColumn(
        "n_extra", F.col("n_rows") - F.col("n_keys")
    )


def below_row_count(readings: DataFrame, minimum: int) -> DataFrame:
    return readings.agg(_count().alias("n_rows")).where(F.col("n_rows") < minimum)


# --- schema ----------------------------------------------------------------

def null_counts(readings: DataFrame) -> DataFrame:
    return readings.agg(
        *[
            F.count_if(F.col(c).isNull()).alias(f"null_{c}")
            for c in ("station_id", "parameter", "timestamp", "value", "unit")
        ]
    )


def unexpected_values(readings: DataFrame) -> DataFrame:
    """Parameters and flags outside the allowed sets."""
    found = readings.select(
        F.inline(
            F.array(
                F.struct(F.lit("parameter").alias("field"), F.col("parameter").alias("found")),
                F.struct(F.lit("quality_flag").alias("field"), F.col("quality_flag").cast("string").alias("found")),
            )
        )
    ).distinct()
    allowed = F.when(F.col("field") == "parameter", F.col("found").isin(*model.PARAMETERS)).otherwise(
        F.col("found").isin(*[str(f) for f in model.QUALITY_FLAGS])
    )
    return found.where(~F.coalesce(allowed, F.lit(False)))


def off_hour_timestamps(readings: DataFrame) -> DataFrame:
    return readings.where((F.minute("timestamp") != 0) | (F.second("timestamp") != 0))


def timestamp_range(readings: DataFrame, first: date, last: date) -> DataFrame:
    """Earliest and latest timestamp, with a day of slack on both sides."""
    low, high = first - timedelta(days=1), last + timedelta(days=1)
    return readings.agg(F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest")).withColumn(
        "in_range",
        (F.col("earliest") >= F.lit(low).cast("timestamp")) & (F.col("latest") <= F.lit(high).cast("timestamp")),
    )


# --- stations --------------------------------------------------------------

def stations_without_readings(readings: DataFrame, stations: DataFrame) -> DataFrame:
    return stations.select("station_id").join(readings.select("station_id").distinct(), "station_id", "left_anti")


def stations_per_parameter(readings: DataFrame) -> DataFrame:
    pairs = readings.select(*SERIES).distinct()
    return pairs.groupBy("parameter").agg(_count().alias("n_stations"))


def too_few_stations(readings: DataFrame, minimum: int, parameter: str = "pm25") -> DataFrame:
    """The station count of one parameter, when below ``minimum``."""
    n = readings.where(F.col("parameter") == parameter).select("station_id").distinct().agg(_count().alias("n_stations"))
    return n.where(F.col("n_stations") < minimum)


def completeness(readings: DataFrame) -> DataFrame:
    f = _figures(readings)
    return readings.groupBy(*SERIES).agg(
        f["n"].alias("n_readings"),
        f["earliest"].alias("earliest"),
        f["latest"].alias("latest"),
        f["n_valid"].alias("n_valid"),
        F.round(100.0 * f["n_valid"] / f["n"], 1).alias("pct_valid"),
    )


def completeness_flagged(
    readings: DataFrame, parameter: str = "pm25", threshold: float = model.COMPLETENESS_PCT
) -> DataFrame:
    """Every station of one parameter with ``passing``; the threshold itself passes."""
    return completeness(readings.where(F.col("parameter") == parameter)).withColumn(
        "passing", F.col("pct_valid") >= threshold
    )


def incomplete_stations(
    readings: DataFrame, parameter: str = "pm25", threshold: float = model.COMPLETENESS_PCT
) -> DataFrame:
    return completeness_flagged(readings, parameter, threshold).where(~F.col("passing"))


# --- frequency -------------------------------------------------------------

def low_coverage(
    readings: DataFrame, minimum: float = 0.80, min_hours: int = 24, exclude: tuple = ()
) -> DataFrame:
    """Series with too few readings for the hours between their first and last."""
    f = _figures(readings)
    hours = F.timestamp_diff("HOUR", f["earliest"], f["latest"]) + 1
    series = readings.where(~F.col("station_id").isin(*exclude)) if exclude else readings
    return (
        series.groupBy(*SERIES)
        .agg(f["n"].alias("n_readings"), hours.alias("possible_hours"))
        .where(F.col("possible_hours") >= min_hours)
        .withColumn("coverage", F.col("n_readings") / F.col("possible_hours"))
        .where(F.col("coverage") < minimum)
    )


def crowded_days(readings: DataFrame, limit: int = 24) -> DataFrame:
    return (
        readings.groupBy(*SERIES, _day(readings).alias("day"))
        .agg(_figures(readings)["n"].alias("n"))
        .where(F.col("n") > limit)
    )


def monthly_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy(*SERIES, F.trunc(_day(readings), "month").alias("month_start")).agg(
        _figures(readings)["n"].alias("n_readings")
    )


def _month_name(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def low_months(readings: DataFrame, minimum: float = 0.10, exclude: tuple = ()) -> DataFrame:
    """Months strictly inside a series' span with too few of their hours."""
    series = W.partitionBy(*SERIES)
    counts = monthly_counts(readings.where(~F.col("station_id").isin(*exclude)) if exclude else readings)
    spans = counts.withColumns(
        {"first": F.min("month_start").over(series), "last": F.max("month_start").over(series)}
    )
    hours = F.dayofmonth(F.last_day("month_start")) * 24
    return (
        spans.where((F.col("month_start") > F.col("first")) & (F.col("month_start") < F.col("last")))
        .select(
            *SERIES,
            _month_name(F.col("month_start")).alias("ym"),
            "n_readings",
            hours.alias("possible_hours"),
            (F.col("n_readings") / hours).alias("coverage"),
        )
        .where(F.col("coverage") < minimum)
    )


def silent_months(readings: DataFrame) -> DataFrame:
    """Months without any reading between two months that have some.

    The months of each span are laid out first; a grouping alone has no row for
    an empty month. Isolated ones are found by looking one month back and ahead.
    """
    counts = monthly_counts(readings)
    spans = counts.groupBy(*SERIES).agg(F.min("month_start").alias("a"), F.max("month_start").alias("b"))
    months = spans.select(
        *SERIES, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month_start")
    )
    laid_out = months.withColumn("n_readings", F.lit(0).cast("bigint")).unionByName(counts)
    grid = laid_out.groupBy(*SERIES, "month_start").agg(F.max("n_readings").alias("n"))
    order = W.partitionBy(*SERIES).orderBy("month_start")
    flanked = grid.withColumns({"prev_n": F.lag("n").over(order), "next_n": F.lead("n").over(order)})
    return flanked.where((F.col("n") == 0) & (F.col("prev_n") > 0) & (F.col("next_n") > 0)).select(
        *SERIES, _month_name(F.col("month_start")).alias("ym")
    )


# --- values ----------------------------------------------------------------

def _implausible() -> Column:
    bad = F.lit(False)
    for p, bounds in model.PLAUSIBLE_BOUNDS.items():
        bad = bad | ((F.col("parameter") == p) & outside(F.col("value"), bounds))
    return bad


def implausible_values(readings: DataFrame) -> DataFrame:
    return readings.where(_implausible())


def implausible_counts(readings: DataFrame) -> DataFrame:
    return implausible_values(readings).groupBy("parameter").agg(_count().alias("n"))


def high_percentile(readings: DataFrame, parameter: str = "pm25", q: float = 0.999, limit: float = 500.0) -> DataFrame:
    """The exact percentile of one parameter and whether it stays below ``limit``."""
    values = readings.where(F.col("parameter") == parameter)
    found = exact_quantiles(values, ["parameter"], "value", lambda n: [F.lit(q)])
    return found.select(
        "parameter", "n", F.col("quantile").alias("percentile"), (F.col("quantile") < limit).alias("below_limit")
    )


def parameter_maximum(readings: DataFrame, parameter: str = "o3", limit: float = 0.5) -> DataFrame:
    return (
        readings.where(F.col("parameter") == parameter)
        .agg(F.max("value").alias("max_value"))
        .withColumn("below_limit", F.col("max_value") < limit)
    )


def wrong_units(readings: DataFrame) -> DataFrame:
    expected = by_parameter(model.UNITS, F.col("parameter"))
    return readings.where(F.col("unit") != expected)


# --- counts over stages ----------------------------------------------------

def flag_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("parameter", "quality_flag").agg(_count().alias("n"))


def stage_counts(readings: DataFrame) -> DataFrame:
    """Readings, distinct station-hours and gridded station-hours."""
    hours = readings.groupBy("station_id", "timestamp").agg(_count().alias("n"))
    spans = hours.groupBy("station_id").agg(
        F.sum("n").alias("n"),
        _count().alias("hours"),
        (F.timestamp_diff("HOUR", F.min("timestamp"), F.max("timestamp")) + 1).alias("grid"),
    )
    return spans.agg(
        F.sum("n").alias("n_readings"),
        F.sum("hours").alias("n_station_hours"),
        F.sum("grid").alias("n_grid_hours"),
    )


def extent(readings: DataFrame) -> DataFrame:
    per_station = readings.groupBy("station_id").agg(
        F.min("timestamp").alias("a"), F.max("timestamp").alias("b")
    )
    return per_station.agg(
        F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), _count().alias("n_stations")
    )


# --- summary ---------------------------------------------------------------

def check_summary(
    readings: DataFrame,
    stations: DataFrame,
    first: date,
    last: date,
    min_rows: int,
    min_stations: int,
    exclude: tuple = (),
) -> DataFrame:
    """(check, n_violations) for the whole suite; an empty suite of zeros is a pass.

    Readings are read four times, for single rows, keys, the percentile and a ``day_cube``; the cube is written, and all
    checks of stations, series, days and months are rolled up from it.
    """
    days = written(day_cube(readings), "day_cube")

    def counted(name: str, violations: DataFrame) -> DataFrame:
        return violations.agg(_count().alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")

    def one_pass() -> DataFrame:
        low, high = first - timedelta(days=1), last + timedelta(days=1)
        ts = F.col("timestamp")
        tests = {
            "null_station": F.count_if(F.col("station_id").isNull()),
            "null_parameter": F.count_if(F.col("parameter").isNull()),
            "null_timestamp": F.count_if(ts.isNull()),
            "null_value": F.count_if(F.col("value").isNull()),
            "null_unit": F.count_if(F.col("unit").isNull()),
            "unexpected_parameter": F.count_if(~F.col("parameter").isin(*model.PARAMETERS)),
            "unexpected_flag": F.count_if(~F.col("quality_flag").isin(*model.QUALITY_FLAGS)),
            "off_hour": F.count_if((F.minute(ts) != 0) | (F.second(ts) != 0)),
            "out_of_range_ts": F.count_if(
                (ts < F.lit(low).cast("timestamp")) | (ts > F.lit(high).cast("timestamp"))
            ),
            "implausible_value": F.count_if(_implausible()),
            "wrong_unit": F.count_if(F.col("unit") != by_parameter(model.UNITS, F.col("parameter"))),
            "o3_at_limit": F.count_if((F.col("parameter") == "o3") & (F.col("value") >= 0.5)),
            "too_few_rows": F.when(_count() < min_rows, 1).otherwise(0).cast("bigint"),
        }
        rows = F.array(
            *[F.struct(F.lit(k).alias("check"), v.alias("n_violations")) for k, v in tests.items()]
        )
        return readings.agg(rows.alias("rows")).select(F.inline("rows"))

    parts = [
        one_pass(),
        counted("duplicate_key", duplicate_keys(readings)),
        counted("station_missing", stations_without_readings(days, stations)),
        counted("too_few_stations", too_few_stations(days, min_stations)),
        counted("incomplete", incomplete_stations(days)),
        counted("low_coverage", low_coverage(days, exclude=exclude)),
        counted("crowded_day", crowded_days(days)),
        counted("low_month", low_months(days, exclude=exclude)),
        counted("silent_month", silent_months(days)),
        counted("high_percentile", high_percentile(readings).where(~F.col("below_limit"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
