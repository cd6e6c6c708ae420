import math

import pytest

from hourweave import fixtures, model
from hourweave.operators.neighbors import neighbor_edges, neighbor_summary
from hourweave.operators.spatial import add_spatial, neighbor_means
from hourweave.operators.rolling import add_rolling_lags
from hourweave.operators.grid import hourly_grid
from hourweave.sources import tables
from tests.helpers import at, readings_frame, series


def station_frame(spark, rows):
    full = [(s, s, float(la), float(lo), float(e), "037", "06", "FEM") for s, la, lo, e in rows]
    return spark.createDataFrame(full, model.STATION_SCHEMA)


@pytest.fixture(scope="module")
def base(spark):
    return station_frame(spark, [s[:4] for s in fixtures.BASE_STATIONS])


def test_golden_weights(spark, base):
    w = {(r.station_id, r.neighbor_id): r.weight for r in neighbor_edges(base, 0.0005).collect()}
    assert len(w) == 82
    assert w["06-037-1103", "06-037-1201"] == pytest.approx(0.08863106844251212, abs=1e-12)
    assert w["06-037-1201", "06-111-2002"] == pytest.approx(0.4253081246670519, abs=1e-12)


def test_weights_sum_to_one_and_isolated_stations(spark, base):
    edges = neighbor_edges(base)
    sums = {}
    for r in edges.collect():
        sums[r.station_id] = sums.get(r.station_id, 0) + r.weight
    assert all(v == pytest.approx(1.0) for v in sums.values())
    assert set(s[0] for s in fixtures.BASE_STATIONS) - set(sums) == {"06-037-9035", "06-071-0306"}
    s = neighbor_summary(base, edges).first()
    assert (s.n_stations, s.min_neighbors, s.max_neighbors, s.n_isolated) == (19, 0, 8, 2)


def _km(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    d = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * model.EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(d)))


def test_cell_join_finds_every_close_pair_on_the_whole_globe(spark):
    rows = []
    for lat in (-89.9, -89.5, -60, -0.1, 0.1, 45, 75, 89.6, 89.95):
        for lon in (-179.95, -179.7, -90, -0.1, 0.1, 89.9, 90.2, 179.8, 179.99):
            rows.append((f"{lat}/{lon}", lat, lon, 0.0))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and _km(a, b) < 40 - 1e-9}
    got = [(r.station_id, r.neighbor_id) for r in neighbor_edges(station_frame(spark, rows), 0.001, 40.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and len(want) > 50


def test_index_file_round_trip(spark, base, tmp_path):
    edges = neighbor_edges(base)
    tables.write_edges(base, edges, str(tmp_path / "index"))
    back = {(r.station_id, r.neighbor_id): r.weight for r in tables.read_edges(spark, str(tmp_path / "index")).collect()}
    assert back == {(r.station_id, r.neighbor_id): r.weight for r in edges.collect()}
    assert spark.read.text(str(tmp_path / "index")).count() == 19


def three(spark):
    stations = station_frame(spark, [("a", 34, -118, 100), ("b", 34.1, -118, 50), ("c", 34.0, -118.1, 300), ("z", 10, 10, 0)])
    edges = spark.createDataFrame([("a", "b", 0.25), ("a", "c", 0.75), ("b", "a", 1.0), ("c", "a", 1.0)], model.EDGE_SCHEMA)
    rows = [("a", "pm25", 1, h) for h in range(10)]
    rows += [("b", "pm25", 10 + h, h) for h in range(10)]
    rows += [("c", "pm25", 100 + h, h) for h in range(3, 10)] + [("z", "pm25", 1, 0)]
    return stations, edges, add_rolling_lags(hourly_grid(readings_frame(spark, rows)))


def test_neighbor_features(spark):
    stations, edges, base = three(spark)
    out = add_spatial(base, edges, stations).cache()
    lag1 = series(out, "spatial_pm25_lag1")
    # hours 0-2: only b has values, so its weight counts fully; then both
    assert lag1[0] is None and lag1[1] == pytest.approx(10) and lag1[3] == pytest.approx(12)
    assert lag1[5] == pytest.approx(0.25 * 14 + 0.75 * 104)
    lag3 = series(out, "spatial_pm25_lag3")
    assert lag3[:3] == [None] * 3 and lag3[3] == pytest.approx(10)
    roll6 = series(out, "spatial_pm25_roll6")
    assert roll6[4] == pytest.approx(0.25 * 12 + 0.75 * 103.5)
    assert set(series(out, "spatial_elev_diff")) == {0.25 * 50 + 0.75 * 200}
    assert series(out, "spatial_elev_diff", "z") == [None]


def test_elevation_weights_are_not_rescaled_without_data(spark):
    stations, edges, base = three(spark)
    out = add_spatial(base.where("station_id <> 'c'"), edges, stations)
    assert set(series(out, "spatial_elev_diff")) == {0.25 * 50}


def test_several_settings_in_one_pass(spark, base, small_blocks):
    _, edges, frame = three(spark)
    from pyspark.sql import functions as F

    one = edges.withColumns({"lam": F.lit(0.1), "cutoff": F.lit(1.0)})
    two = edges.where("neighbor_id <> 'c'").withColumns({"lam": F.lit(0.2), "cutoff": F.lit(1.0)})
    both = neighbor_means(frame, one.unionByName(two), settings=[(0.1, 1.0), (0.2, 1.0)])
    assert both.count() == 2 * frame.count()
    alone = neighbor_means(frame, edges)
    a = [r.asDict() for r in both.where("lam = 0.1").drop("lam", "cutoff").orderBy("station_id", "timestamp").collect()]
    b = [r.asDict() for r in alone.orderBy("station_id", "timestamp").collect()]
    for x, y in zip(a, b, strict=True):
        assert x == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in y.items()}


def test_neighbor_hours_meet_without_sorting_contributions(spark):
    """Columns of fixed width are aggregated by hashing; strings still come back."""
    rows = [(s, at(h), float(h), None, None, 1.0 * h, "train") for s in ("a", "b") for h in range(5)]
    features = spark.createDataFrame(rows, "station_id string, timestamp timestamp, pm25 double, no2 double, o3 double, pm25_roll6 double, split string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "station_id string, neighbor_id string, weight double")
    narrow = neighbor_means(features.drop("split"), edges)
    assert "SortAggregate" not in narrow._jdf.queryExecution().executedPlan().toString()
    whole = neighbor_means(features, edges)
    assert {r.split for r in whole.collect()} == {"train"}
    assert sorted(map(repr, whole.drop("split").collect())) == sorted(map(repr, narrow.select(*whole.drop("split").columns).collect()))
    assert sorted(r.spatial_pm25_lag1 for r in narrow.collect() if r.station_id == "a" and r.spatial_pm25_lag1 is not None) == [0.0, 1.0, 2.0, 3.0]
