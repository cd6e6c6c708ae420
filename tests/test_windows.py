from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import add_calendar
from hourweave.operators.windows import (
    apply_scaler,
    fit_scaler,
    rolling_instances,
    series_dataset,
    training_windows,
    with_boundary,
)
from hourweave.plans.features import to_feature_schema
from tests.helpers import T0, at


def hourly(spark, stations, hours, missing=()):
    rows = [
        (s, at(h), None if (s, h) in missing else float(i * 1000 + h))
        for i, s in enumerate(stations)
        for h in range(hours)
    ]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp, pm25 double")
    return add_calendar(df)


def full(spark, *args, **kw):
    return to_feature_schema(hourly(spark, *args, **kw))


def test_scaler_skips_nulls_uses_population_std_and_guards_constants(spark):
    df = spark.createDataFrame([(1.0, 0.1), (3.0, 0.1), (None, 0.1), (None, 0.1)], "x double, c double")
    got = {r.feature: (r.mean, r.std) for r in fit_scaler(df, ["x", "c"]).collect()}
    assert got["x"] == (2.0, 1.0)
    assert got["c"][1] == 1.0
    scaled = apply_scaler(df, fit_scaler(df, ["x", "c"]), ["x", "c"]).orderBy("x").collect()
    assert sorted(r.x for r in scaled) == [-1.0, 0.0, 0.0, 1.0]
    assert all(abs(r.c) < 1e-12 for r in scaled)


def test_window_count_and_targets(spark, small_blocks):
    df = full(spark, ["a", "b"], 200)
    wins = training_windows(df, fit_scaler(df))
    assert wins.count() == 2 * (200 - 24 - 72)
    first = wins.where("station_id = 'a'").orderBy("timestamp").first()
    assert first.timestamp == datetime(2024, 1, 2)
    assert [first[f"y{h}"] for h in model.HORIZONS] == [27.0, 36.0, 48.0, 96.0]
    assert len(first.x) == 24 and all(len(step) == 21 for step in first.x)
    mean = (sum(range(200)) * 2 + 200 * 1000) / 400
    row = fit_scaler(df).where("feature = 'pm25'").first()
    assert row["mean"] == pytest.approx(mean)
    assert first.x[0][0] == pytest.approx((0 - row["mean"]) / row["std"])
    assert first.x[-1][0] == pytest.approx((23 - row["mean"]) / row["std"])


def test_windows_with_missing_targets_are_dropped(spark):
    df = full(spark, ["a"], 150, missing={("a", 100)})
    # hour 100 is a target of the windows at 97, 88, 76 and 28, of which those below 150 - 72 exist
    assert training_windows(df, fit_scaler(df)).count() == 150 - 96 - 2
    assert training_windows(full(spark, ["a"], 96), fit_scaler(df)).count() == 0


def test_boundary_reaches_to_96_hours_before_midnight(spark):
    df = full(spark, ["a"], 24 * 12).withColumn("split", F.when(F.col("timestamp") < F.lit(at(240)), "train").otherwise("val"))
    rows = with_boundary(df, "val", "train", F.lit((T0 + timedelta(days=9)).date()))
    assert rows.where("split = 'train'").count() == 96 + 24
    assert rows.where("split = 'val'").count() == 48


def test_rolling_instances(spark):
    df = hourly(spark, ["a", "b"], 346).union(hourly(spark, ["c"], 200))
    start, end = datetime(2024, 1, 8), datetime(2024, 1, 15, 9)
    got = rolling_instances(df, start, end).orderBy("station_id", "window_start").collect()
    # starts every 24 h while start + 72 h <= end + 1 h
    assert [r.window_start.day for r in got if r.station_id == "a"] == [8, 9, 10, 11, 12]
    assert {r.station_id for r in got} == {"a", "b"}
    second = [r for r in got if r.station_id == "b"][1]
    assert second.station_ix == 1 and second.start == datetime(2024, 1, 2)
    assert second.target == [1000.0 + h for h in range(24, 192)]
    assert second.actuals == [1000.0 + h for h in range(192, 264)]
    assert len(second.hour_of_day) == 240 and second.hour_of_day[:3] == [0.0, 1.0, 2.0]


def test_rolling_instances_with_other_strides(spark):
    df = hourly(spark, ["a"], 400)
    got = rolling_instances(df, datetime(2024, 1, 4), datetime(2024, 1, 10), context=48, horizon=12, stride=36)
    rows = got.orderBy("window_start").collect()
    assert [(r.window_start - datetime(2024, 1, 4)).total_seconds() / 3600 for r in rows] == [0, 36, 72, 108]
    assert rows[1].target == [float(h) for h in range(108 - 48, 108)]
    assert rows[1].actuals == [float(h) for h in range(108, 120)]


def test_series_parts_make_the_whole_series(spark, small_blocks):
    df = hourly(spark, ["a", "b"], 300)
    parts = series_dataset(df, datetime(2024, 1, 10)).orderBy("station_id", "part").collect()
    whole = [x for p in parts if p.station_id == "b" for x in p.target]
    assert whole == [1000.0 + h for h in range(217)]
    assert {p.station_id: p.station_ix for p in parts} == {"a": 0, "b": 1}
