"""Schemas and fixed values of the sensor-network data model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

# --- fixed values: parameters, units and validation bounds -----------------
PARAMETERS = ("pm25", "no2", "o3", "pm10", "co")

PARAMETER_CODES = {
    "pm25": "88101",
    "no2": "42602",
    "o3": "44201",
    "pm10": "81102",
    "co": "42101",
}

UNITS = {
    "pm25": "µg/m³",
    "no2": "ppb",
    "o3": "ppm",
    "pm10": "µg/m³",
    "co": "ppm",
}

# outside -> flag 1
SUSPECT_BOUNDS = {
    "pm25": (0.0, 500.0),
    "no2": (0.0, 500.0),
    "o3": (0.0, 0.5),
    "pm10": (0.0, 3000.0),
    "co": (0.0, 20.0),
}

# outside -> flag 2
INVALID_BOUNDS = {
    "pm25": (-15.0, 5000.0),
    "no2": (-10.0, 5000.0),
    "o3": (-0.05, 10.0),
    "pm10": (-20.0, 50000.0),
    "co": (-1.0, 500.0),
}

# outside -> quality-check violation
PLAUSIBLE_BOUNDS = {
    "pm25": (-10.0, 1000.0),
    "pm10": (-10.0, 5000.0),
    "no2": (-5.0, 500.0),
    "o3": (-0.01, 0.5),
    "co": (-0.5, 50.0),
}

QUALITY_FLAGS = (0, 1, 2)

# lat_min, lat_max, lon_min, lon_max
STATION_BOX = (33.5, 34.8, -118.9, -117.0)

EARTH_RADIUS_KM = 6371.0088
ELEVATION_LAMBDA = 0.001
DISTANCE_CUTOFF_KM = 40.0
LAMBDA_GRID = (0.0001, 0.0005, 0.001)
CUTOFF_GRID = (30.0, 40.0, 50.0)

TRAIN_END = date(2025, 9, 30)
VAL_END = date(2025, 12, 31)

COMPLETENESS_PCT = 80.0
HORIZONS = (3, 12, 24, 72)
SEQUENCE_HOURS = 24
CONTEXT_HOURS = 168
BOUNDARY_HOURS = 96

ADVISORY_THRESHOLD = 35.4
WARNING_THRESHOLD = 55.4
# --- end of fixed values ---------------------------------------------------

CALENDAR = ("hour_of_day", "day_of_week", "month", "is_weekend")
ROLLS = (3, 6, 24)
LAGS = (1, 3, 24)
ROLLING = tuple(f"pm25_roll{n}" for n in ROLLS) + tuple(f"pm25_lag{n}" for n in LAGS)
SPATIAL = (
    "spatial_pm25_lag1",
    "spatial_pm25_lag3",
    "spatial_pm25_roll6",
    "spatial_no2_lag1",
    "spatial_o3_lag1",
    "spatial_elev_diff",
)
MODEL_INPUTS = PARAMETERS + CALENDAR + ROLLING + SPATIAL
FEATURE_COLUMNS = ("station_id", "timestamp") + MODEL_INPUTS + ("split",)

READING_KEY = ("station_id", "parameter", "timestamp")
FEATURE_KEY = ("station_id", "timestamp")


def _field(name: str, kind: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


READING_SCHEMA = T.StructType(
    [
        _field("station_id", T.StringType(), False),
        _field("parameter", T.StringType(), False),
        _field("value", T.DoubleType()),
        _field("unit", T.StringType(), False),
        _field("timestamp", T.TimestampType(), False),
        _field("quality_flag", T.IntegerType(), False),
    ]
)

STATION_SCHEMA = T.StructType(
    [
        _field("station_id", T.StringType(), False),
        _field("name", T.StringType()),
        _field("lat", T.DoubleType(), False),
        _field("lon", T.DoubleType(), False),
        _field("elevation_m", T.DoubleType()),
        _field("county_code", T.StringType()),
        _field("state_code", T.StringType()),
        _field("monitor_type", T.StringType()),
    ]
)

EDGE_SCHEMA = T.StructType(
    [
        _field("station_id", T.StringType(), False),
        _field("neighbor_id", T.StringType(), False),
        _field("weight", T.DoubleType(), False),
    ]
)

_FEATURE_TYPES = {
    "station_id": T.StringType(),
    "timestamp": T.TimestampType(),
    "hour_of_day": T.IntegerType(),
    "day_of_week": T.IntegerType(),
    "month": T.IntegerType(),
    "is_weekend": T.BooleanType(),
    "split": T.StringType(),
}
_FEATURE_REQUIRED = set(_FEATURE_TYPES)

FEATURE_SCHEMA = T.StructType(
    [
        _field(c, _FEATURE_TYPES.get(c, T.DoubleType()), c not in _FEATURE_REQUIRED)
        for c in FEATURE_COLUMNS
    ]
)


def message_schema(table: T.StructType) -> T.StructType:
    """The wire form of a table: the same fields, timestamps as ISO-8601 text."""
    return T.StructType(
        [
            _field(
                f.name,
                T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType,
                f.nullable,
            )
            for f in table.fields
        ]
    )


RAW_MESSAGE_SCHEMA = message_schema(READING_SCHEMA)
FEATURE_MESSAGE_SCHEMA = message_schema(FEATURE_SCHEMA)

# Landed provider records. ``Data`` holds the rows of one response.
SAMPLE_RECORD = T.StructType(
    [
        _field("state_code", T.StringType()),
        _field("county_code", T.StringType()),
        _field("site_number", T.StringType()),
        _field("parameter_code", T.StringType()),
        _field("poc", T.IntegerType()),
        _field("date_gmt", T.StringType()),
        _field("time_gmt", T.StringType()),
        _field("sample_measurement", T.DoubleType()),
        _field("sample_duration", T.StringType()),
        _field("qualifier", T.StringType()),
    ]
)

MONITOR_RECORD = T.StructType(
    [
        _field("state_code", T.StringType()),
        _field("county_code", T.StringType()),
        _field("site_number", T.StringType()),
        _field("poc", T.IntegerType()),
        _field("latitude", T.DoubleType()),
        _field("longitude", T.DoubleType()),
        _field("elevation", T.DoubleType()),
        _field("close_date", T.StringType()),
        _field("collection_frequency", T.StringType()),
        _field("local_site_name", T.StringType()),
        _field("address", T.StringType()),
    ]
)


def landed_schema(record: T.StructType) -> T.StructType:
    return T.StructType([_field("Data", T.ArrayType(record))])
