import pytest
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import assign_split, monitor_type, qualifier_flag, range_flag
from hourweave.operators.grid import apply_validation, null_invalid
from tests.helpers import readings_frame

CASES = [
    ("pm25", 0.0, 0), ("pm25", -0.1, 1), ("pm25", -15.0, 1), ("pm25", -15.1, 2),
    ("pm25", 500.0, 0), ("pm25", 500.1, 1), ("pm25", 5000.0, 1), ("pm25", 5000.1, 2),
    ("no2", -10.1, 2), ("o3", 0.5, 0), ("o3", 0.51, 1), ("o3", 10.1, 2),
    ("pm10", 3000.5, 1), ("pm10", -20.5, 2), ("co", 20.5, 1), ("co", -1.5, 2),
    ("unknown", 1e12, 0), ("pm25", None, 0),
]


def test_range_flags_by_bound(spark):
    df = spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(CASES)], "i int, p string, v double")
    got = df.select("i", range_flag(F.col("v"), F.col("p")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [f for *_, f in CASES]


def test_existing_flag_is_never_lowered_and_nan_is_missing(spark):
    rows = [("a", "pm25", 10, 0, 1), ("a", "pm25", 9999, 1, 1), ("a", "pm25", float("nan"), 2, 0), ("a", "pm25", float("inf"), 3, 0)]
    out = null_invalid(apply_validation(readings_frame(spark, rows))).orderBy("timestamp").collect()
    assert [r.quality_flag for r in out] == [1, 2, 0, 0]
    assert [r.value for r in out] == [10.0, None, None, None]


@pytest.mark.parametrize("text, flag", [(None, 0), ("", 0), ("  ", 0), ("QX", 1)])
def test_qualifier(spark, text, flag):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(qualifier_flag(F.col("q")).alias("f")).first().f == flag


def test_monitor_type(spark):
    df = spark.createDataFrame([("Continuous",), ("DAILY",), (None,)], "c string")
    assert [r.t for r in df.select(monitor_type(F.col("c")).alias("t")).collect()] == ["FEM", "FRM", "FRM"]


def test_split_bounds_are_inclusive_days(spark):
    days = ["2025-09-30 23:00:00", "2025-10-01 00:00:00", "2025-12-31 23:00:00", "2026-01-01 00:00:00"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_timestamp("d").alias("ts"))
    assert [r.s for r in df.select(assign_split(F.col("ts")).alias("s")).collect()] == ["train", "val", "val", "test"]


def test_feature_schema_has_24_columns():
    assert len(model.FEATURE_COLUMNS) == 24
    assert model.FEATURE_SCHEMA.names == list(model.FEATURE_COLUMNS)
