from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hourweave.operators import checks
from hourweave.registry import QUERIES
from tests.helpers import readings_frame
from tests.test_neighbors import station_frame


def test_duplicates_and_key_counts(spark):
    r = readings_frame(spark, [("a", "pm25", 1, 0), ("a", "pm25", 2, 0), ("a", "co", 1, 0)])
    assert [x.n for x in checks.duplicate_keys(r).collect()] == [2]
    k = checks.key_counts(r).first()
    assert (k.n_rows, k.n_keys, k.n_extra) == (3, 2, 1)
    assert checks.below_row_count(r, 4).count() == 1 and checks.below_row_count(r, 3).count() == 0


def test_completeness_threshold_itself_passes(spark):
    r = readings_frame(spark, [("a", "pm25", 1, h, 0 if h < 8 else 1) for h in range(10)] + [("b", "pm25", None, 0)])
    got = {x.station_id: (x.n_valid, x.pct_valid, x.passing) for x in checks.completeness_flagged(r).collect()}
    assert got == {"a": (8, 80.0, True), "b": (0, 0.0, False)}
    assert [x.station_id for x in checks.incomplete_stations(r).collect()] == ["b"]


def test_allowed_values_units_and_bounds(spark):
    r = readings_frame(spark, [("a", "pm25", 1000.5, 0, 3), ("a", "xx", 1, 1), ("a", "o3", 0.5, 2), ("a", "o3", 0.51, 3)])
    assert {(x.field, x.found) for x in checks.unexpected_values(r).collect()} == {("parameter", "xx"), ("quality_flag", "3")}
    assert {(x.parameter, x.n) for x in checks.implausible_counts(r).collect()} == {("pm25", 1), ("o3", 1)}
    assert checks.wrong_units(r.withColumn("unit", F.lit("ppm"))).count() == 1
    top = checks.parameter_maximum(r).first()
    assert top.max_value == 0.51 and not top.below_limit


def test_hours_days_and_range(spark):
    r = readings_frame(spark, [("a", "pm25", 1, h) for h in range(24)])
    half = r.withColumn("timestamp", F.col("timestamp") + F.expr("interval 30 minutes"))
    assert checks.off_hour_timestamps(r).count() == 0 and checks.off_hour_timestamps(half).count() == 24
    assert checks.crowded_days(r).count() == 0
    assert checks.crowded_days(r.union(half.limit(1))).count() == 1
    assert checks.timestamp_range(r, date(2024, 1, 2), date(2024, 1, 2)).first().in_range
    assert not checks.timestamp_range(r, date(2024, 1, 3), date(2024, 1, 5)).first().in_range


def test_coverage_ignores_short_spans(spark):
    short = [("a", "pm25", 1, 0), ("a", "pm25", 1, 22)]
    sparse = [("b", "pm25", 1, 0), ("b", "pm25", 1, 30)]
    r = readings_frame(spark, short + sparse)
    assert [(x.station_id, x.possible_hours) for x in checks.low_coverage(r).collect()] == [("b", 31)]
    assert checks.low_coverage(r, exclude=("b",)).count() == 0


def test_months(spark):
    jan, feb, mar, may = 0, 31 * 24, 60 * 24, 121 * 24
    r = readings_frame(spark, [("a", "pm25", 1, jan), ("a", "pm25", 1, feb), ("a", "pm25", 1, mar), ("b", "co", 1, mar), ("b", "co", 1, may)])
    low = checks.low_months(r).collect()
    assert [(x.station_id, x.ym, x.possible_hours) for x in low] == [("a", "2024-02", 696)]
    assert [(x.station_id, x.ym) for x in checks.silent_months(r).collect()] == [("b", "2024-04")]


def test_stations_and_stages(spark):
    stations = station_frame(spark, [("a", 34, -118, 0), ("b", 34, -118, 0)])
    r = readings_frame(spark, [("a", "pm25", 1, 0), ("a", "co", 1, 0), ("a", "pm25", 1, 5)])
    assert [x.station_id for x in checks.stations_without_readings(r, stations).collect()] == ["b"]
    s = checks.stage_counts(r).first()
    assert (s.n_readings, s.n_station_hours, s.n_grid_hours) == (3, 2, 6)
    assert checks.too_few_stations(r, 2).count() == 1 and checks.too_few_stations(r, 1).count() == 0


def test_percentile_and_summary(spark):
    r = readings_frame(spark, [("a", "pm25", v, v) for v in range(1, 1001)])
    p = checks.high_percentile(r).first()
    assert p.percentile == pytest.approx(999.001) and not p.below_limit
    stations = station_frame(spark, [("a", 34, -118, 0)])
    got = {x.check: x.n_violations for x in checks.check_summary(r, stations, date(2024, 1, 1), date(2024, 2, 20), 10, 1).collect()}
    assert got.pop("high_percentile") == 1
    assert set(got.values()) == {0} and len(got) == 21


def test_checks_of_the_day_cube_equal_those_of_readings(spark):
    """Uneven series, null values, flags and a null timestamp: the cube stands in for the readings."""
    sql = """SELECT concat('s', id % 7) AS station_id, if(id % 3 = 0, 'pm25', 'o3') AS parameter,
                    if(id = 50, NULL, timestamp '2024-01-01' + make_dt_interval(0, (id * id) % 3000 - if(id % 7 = 2, 1500, 0))) AS timestamp,
                    if(id % 11 = 0, NULL, double(id)) AS value, 'ppm' AS unit, int(id % 13 = 0) AS quality_flag FROM range(600)"""
    readings = spark.sql(sql)
    cube = checks.day_cube(readings)
    assert cube.count() < readings.count()
    stations = spark.createDataFrame([("s1",), ("none",)], "station_id string")
    for check in (
        checks.completeness, checks.incomplete_stations, checks.low_coverage, lambda r: checks.crowded_days(r, 1), checks.monthly_counts,
        lambda r: checks.low_months(r, 0.9, ("s3",)), checks.silent_months, checks.stations_per_parameter,
        lambda r: checks.too_few_stations(r, 100), lambda r: checks.stations_without_readings(r, stations),
    ):
        want = check(readings)
        assert want.schema.names == check(cube).schema.names
        assert sorted(map(str, want.collect())) == sorted(map(str, check(cube).collect()))
    assert checks.crowded_days(cube, 1).count() and checks.low_coverage(cube).count() and checks.low_months(cube, 0.9).count()


@pytest.mark.parametrize("users, missing", [(19, set()), (17, {"06-111-0009", "06-111-2002"})])
def test_the_missing_stations_query_reads_all_readings(spark, tmp_path, users, missing):
    rows = [(u, u, datetime(2024, 1, 2), "click", 5.0, '{"k": 50}') for u in range(users)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert {r.station_id for r in QUERIES["qc_stations_missing"](spark, str(tmp_path)).collect()} == missing
