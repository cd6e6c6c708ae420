import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourweave import model
from hourweave.operators.clean import build_stations, clean_samples
from hourweave.session import shared_folder, written
from hourweave.sources import landed, tables
from tests.helpers import at, readings_frame
from tests.test_neighbors import station_frame


def sample(seq, poc, value, **over):
    base = dict(
        state_code="06", county_code="037", site_number="1103", parameter_code="88101", poc=poc,
        date_gmt="2024-01-15", time_gmt="14:00", sample_measurement=value, sample_duration="1 HOUR", qualifier=None,
    )
    return base | over


def test_clean_samples(spark, tmp_path):
    rows = [
        sample(1, 3, 30.0), sample(2, 1, None), sample(3, 2, 20.0, qualifier=" "), sample(4, 2, 21.0),
        sample(5, 1, 9.0, sample_duration="24 HOUR"), sample(6, 1, 1.0, site_number="9999"),
        sample(7, 0, 5.0, time_gmt="15:00", qualifier="X"), sample(8, 7, 6.0, time_gmt="15:00"),
        sample(9, None, 0.04, parameter_code="44201"), sample(10, 1, 1.0, parameter_code="00000"),
    ]
    (tmp_path / "doc.json").write_text(json.dumps({"Header": [], "Data": rows}, indent=1))
    stations = station_frame(spark, [("06-037-1103", 34, -118, 0)])
    got = clean_samples(landed.read_samples(spark, str(tmp_path / "doc.json"), one_per_file=True), stations).collect()
    by = {(r.parameter, r.timestamp): (r.value, r.unit, r.quality_flag) for r in got}
    assert by == {
        ("pm25", datetime(2024, 1, 15, 14)): (20.0, "µg/m³", 0),
        ("pm25", datetime(2024, 1, 15, 15)): (6.0, "µg/m³", 0),
        ("o3", datetime(2024, 1, 15, 14)): (0.04, "ppm", 0),
    }


def test_ties_go_to_the_document_landed_first(spark, tmp_path):
    stations = station_frame(spark, [("06-037-1103", 34, -118, 0)])
    docs = [[sample(0, 2, 7.0), sample(1, 1, 5.0), sample(2, 1, 6.0)], [sample(3, 1, 9.0)]]
    for nr, rows in enumerate(docs):
        (tmp_path / f"{nr}.json").write_text(json.dumps({"Data": rows}))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"Data": rows}) for rows in reversed(docs)))
    for path, whole, want in (("[01].json", True, 5.0), ("lines.json", False, 9.0)):
        got = clean_samples(landed.read_samples(spark, str(tmp_path / path), one_per_file=whole), stations)
        assert [r.value for r in got.collect()] == [want]
    loose = spark.createDataFrame([(docs[0],)], model.landed_schema(model.SAMPLE_RECORD))
    assert [r.value for r in clean_samples(landed.explode_data(loose), stations).collect()] == [5.0]


def monitor(seq, site, lat=34.0, lon=-118.0, **over):
    base = dict(
        state_code="06", county_code="037", site_number=site, poc=seq, latitude=lat, longitude=lon,
        elevation=10.0, close_date=None, collection_frequency="DAILY", local_site_name=f"n{seq}", address="road",
    )
    return base | over


def test_build_stations(spark, tmp_path):
    rows = [
        monitor(1, "0001"), monitor(2, "0001", collection_frequency="continuous"),
        monitor(3, "0002", lat=33.5, lon=-118.9, local_site_name=None, elevation=None),
        monitor(4, "0003", lat=33.49), monitor(5, "0004", close_date="2020-01-01"), monitor(6, "0005", lat=None),
    ]
    (tmp_path / "m.json").write_text("\n".join(json.dumps({"Data": rows[i : i + 2]}) for i in (0, 2, 4)))
    got = build_stations(landed.read_monitors(spark, str(tmp_path / "m.json")))
    out = {r.station_id: (r.name, r.elevation_m, r.monitor_type) for r in got.collect()}
    assert out == {"06-037-0001": ("n1", 10.0, "FEM"), "06-037-0002": ("road", None, "FRM")}
    tables.write_stations(got, str(tmp_path / "csv"))
    back = tables.read_stations(spark, str(tmp_path / "csv")).orderBy("station_id").collect()
    assert [r.county_code for r in back] == ["037", "037"] and back[1].elevation_m is None


def test_insert_is_idempotent_and_counts_inserted_rows(spark, tmp_path):
    paths = tables.ensure_tables(spark, str(tmp_path))
    assert tables.ensure_tables(spark, str(tmp_path)) == paths
    schema = tables.table_schemas()[tables.READINGS]
    r = readings_frame(spark, [("a", "pm25", 1, 0), ("a", "pm25", 2, 1)])
    target = paths[tables.READINGS]
    assert tables.insert_new(r, target, model.READING_KEY, schema).count() == 2
    late_first = readings_frame(spark, [("b", "pm25", 8, 5), ("b", "pm25", 7, 5)]).withColumn("offset", -F.col("value"))
    assert [x.value for x in tables.insert_new(late_first.repartition(4), target, model.READING_KEY, schema, ["offset"]).collect()] == [8.0]
    in_place = readings_frame(spark, [("c", "pm25", v, 5) for v in range(50)]).coalesce(1)
    assert [x.value for x in tables.insert_new(in_place, target, model.READING_KEY, schema).collect()] == [0.0]
    more = readings_frame(spark, [("a", "pm25", 99, 1), ("a", "pm25", 3, 2), ("a", "pm25", 3, 2)]).drop("quality_flag")
    fresh = tables.insert_new(more, target, model.READING_KEY, schema)
    assert [(x.value, x.quality_flag) for x in fresh.collect()] == [(3.0, 0)]
    now = tables.read_table(spark, target, schema)
    assert sorted(x.value for x in now.where("station_id = 'a'").collect()) == [1.0, 2.0, 3.0]
    assert now.where("ingested_at is null").count() == 0
    assert tables.insert_new(more, target, model.READING_KEY, schema).count() == 0


def test_files_without_a_late_column_read_as_null(spark, tmp_path):
    spark.createDataFrame([("a", at(0), 1.0)], "station_id string, timestamp timestamp, pm25 double").write.parquet(str(tmp_path / "old"))
    row = tables.read_table(spark, str(tmp_path / "old"), model.FEATURE_SCHEMA).first()
    assert row.split is None and row.pm25 == 1.0


def test_split_scan_prunes_partitions_and_columns(spark, tmp_path):
    from hourweave.plans.features import to_feature_schema

    rows = [("a", at(h), float(h), s) for h, s in enumerate(["train", "val", "test"])]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp, pm25 double, split string")
    tables.write_features(to_feature_schema(df), str(tmp_path / "f"))
    scan = tables.read_split(spark, str(tmp_path / "f"), ["val"], ["pm25"])
    assert [r.pm25 for r in scan.collect()] == [1.0]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<station_id:string,timestamp:timestamp,pm25:double>" in plan


@pytest.mark.parametrize("a, b, n", [(None, None, 72), ("2024-01-02", None, 48), (None, "2024-01-02", 48), ("2024-01-02", "2024-01-02", 24)])
def test_date_range_is_inclusive(spark, a, b, n):
    r = readings_frame(spark, [("a", "pm25", 1, h) for h in range(72)])
    assert tables.date_range(r, a, b).count() == n


def test_small_stores(spark, tmp_path):
    scaler = spark.createDataFrame([("pm25", 1.5, 2.5)], tables.SCALER_SCHEMA)
    tables.write_scaler(scaler, str(tmp_path / "s"))
    assert tables.read_scaler(spark, str(tmp_path / "s")).collect() == scaler.collect()
    margins = spark.createDataFrame([(3, 10, 0.9, 1.0, 0.0, 80.0, 90.0)], tables.MARGIN_SCHEMA)
    tables.write_margins(margins, str(tmp_path / "m"))
    assert tables.read_margins(spark, str(tmp_path / "m")).collect() == margins.collect()
    samples = spark.createDataFrame([("a", at(0), 3, k, float(k)) for k in range(5)], "station_id string, window_start timestamp, horizon int, sample_id int, value double")
    tables.write_samples(samples, str(tmp_path / "x"))
    assert sorted(r.value for r in tables.read_samples(spark, str(tmp_path / "x")).collect()) == [0, 1, 2, 3, 4]


class _Session:
    """Just what ``shared_folder`` asks of a session."""

    def __init__(self, master, folder=None):
        self.folder = folder
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_folder(_Session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(ValueError):
        shared_folder(_Session("yarn"))
    made = shared_folder(_Session("local[2]"))
    assert made == shared_folder(_Session("local[2]"))


def test_written_tables_live_in_the_shared_folder(spark):
    df = written(spark.range(3), "t")
    assert df.count() == 3
    assert all(shared_folder(spark) in f for f in df.inputFiles())
    assert written(spark.range(0).select(F.col("id")), "empty").count() == 0


def test_the_first_row_of_equal_keys_is_inserted(spark):
    from hourweave.sources.tables import new_rows

    batch = spark.createDataFrame([("a", 0.0, 2), ("a", 1.0, 1), ("b", 5.0, 3)], "k string, v double, n int").coalesce(1)
    target = spark.createDataFrame([("b",)], "k string")
    assert [tuple(r) for r in new_rows(batch, target, ["k"]).collect()] == [("a", 0.0, 2)]
    assert [tuple(r) for r in new_rows(batch, target, ["k"], ["n"]).collect()] == [("a", 1.0, 1)]


def test_forecast_windows_push_their_period_down(spark, tmp_path):
    from datetime import datetime

    from hourweave.operators.forecasts import seasonal_ensemble, window_actuals

    path = str(tmp_path / "hours")
    spark.sql("select 'a' station_id, timestamp'2024-01-10 00:00:00' timestamp, 1.0D pm25").write.parquet(path)
    hours = spark.read.parquet(path)
    for make in (seasonal_ensemble, window_actuals):
        plan = make(hours, datetime(2024, 1, 5), datetime(2024, 1, 20))._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan
