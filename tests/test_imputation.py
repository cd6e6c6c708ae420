import pytest

from hourweave.operators.fill import fill_series, gap_runs
from hourweave.operators.grid import hourly_grid
from hourweave.operators.rolling import add_rolling_lags
from hourweave.plans.features import imputed_grid
from tests.helpers import gappy, impute_plainly, readings_frame, series


def two_series(spark, hours=24 * 60):
    pm, no2 = gappy(1, hours), gappy(2, hours)
    pm[0], pm[-1] = 5.0, 6.0
    rows = [("a", "pm25", v, h) for h, v in enumerate(pm) if v is not None]
    rows += [("a", "no2", v, h) for h, v in enumerate(no2) if v is not None]
    return pm, no2, readings_frame(spark, rows)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None)
        if w is not None:
            assert g == pytest.approx(w, abs=1e-9)


def test_tiers_equal_plain_restatement(spark):
    pm, no2, r = two_series(spark)
    out = imputed_grid(r).cache()
    same(series(out, "pm25"), impute_plainly(pm))
    same(series(out, "no2"), impute_plainly(no2))


def test_small_blocks_change_nothing(spark, small_blocks):
    pm, no2, r = two_series(spark)
    out = imputed_grid(r).cache()
    same(series(out, "pm25"), impute_plainly(pm))
    same(series(out, "no2"), impute_plainly(no2))
    rolled = add_rolling_lags(out)
    filled = impute_plainly(pm)
    lag24 = [None] * 24 + filled[:-24]
    same(series(rolled, "pm25_lag24"), lag24)
    means = []
    for i in range(len(filled)):
        have = [x for x in filled[max(0, i - 23) : i + 1] if x is not None]
        means.append(sum(have) / len(have) if have else None)
    same(series(rolled, "pm25_roll24"), means)


def test_history_longer_than_one_stretch_of_days(spark):
    hours = 24 * 200
    pm = gappy(7, hours)
    pm[0], pm[-1] = 1.0, 2.0
    r = readings_frame(spark, [("a", "pm25", v, h) for h, v in enumerate(pm) if v is not None])
    same(series(imputed_grid(r), "pm25"), impute_plainly(pm))


def test_grid_spans_all_parameters(spark, small_blocks):
    r = readings_frame(spark, [("a", "pm25", 1, 10), ("a", "co", 2, 500), ("b", "o3", 0.1, 3)])
    grid = hourly_grid(r)
    assert grid.where("station_id = 'a'").count() == 491
    assert grid.where("station_id = 'b'").count() == 1
    assert grid.where("pm25 is not null or co is not null or o3 is not null").count() == 3


def test_edge_runs(spark):
    # pm25 starts 2 hours after the station and ends 5 hours before it
    rows = [("a", "co", 1, 0), ("a", "co", 1, 40)] + [("a", "pm25", h, h) for h in range(2, 36)]
    out = imputed_grid(readings_frame(spark, rows))
    pm = series(out, "pm25")
    assert pm[:2] == [None, None]
    assert pm[36:] == [12.0, 13.0, 14.0, 15.0, 16.0]


def test_fill_is_forward_then_backward_then_zero(spark, small_blocks):
    rows = [("a", "pm25", 7, 200), ("a", "pm25", 9, 205), ("a", "co", 1, 0), ("a", "co", 1, 400)]
    grid = hourly_grid(readings_frame(spark, rows)).select("station_id", "timestamp", "pm25", "o3")
    out = fill_series(grid, ["pm25", "o3"])
    pm = series(out, "pm25")
    assert pm[0] == 7 and pm[199] == 7 and pm[204] == 7 and pm[205] == 9 and pm[400] == 9
    assert set(series(out, "o3")) == {0.0}


def test_gap_runs_longer_than_a_block(spark, small_blocks):
    rows = [("a", "pm25", 1, 0), ("a", "pm25", 1, 300), ("a", "pm25", 1, 302)]
    runs = gap_runs(hourly_grid(readings_frame(spark, rows))).where("parameter = 'pm25'")
    found = sorted((r.run_hours, r.has_left, r.has_right) for r in runs.collect())
    assert found == [(1, True, True), (299, True, True)]
    whole = gap_runs(hourly_grid(readings_frame(spark, rows))).where("parameter = 'co'").collect()
    assert [(r.run_hours, r.has_left, r.has_right) for r in whole] == [(303, False, False)]


def test_gaps_longer_than_the_halo_are_refused(spark):
    from hourweave.operators.grid import blocked_grid
    from hourweave.operators.impute import impute

    readings = readings_frame(spark, [("a", "pm25", 1.0, h) for h in (0, 40, 41)])
    with pytest.raises(ValueError):
        impute(blocked_grid(readings, halo=24), median_max=48)
    assert impute(blocked_grid(readings, halo=48), median_max=48, halo=48).count() == 42
