from datetime import datetime

import numpy as np
import pytest

from hourweave.operators import alerts
from hourweave.operators import forecasts as fc
from hourweave.operators.conformal import apply_conformal, calibrate_conformal
from hourweave.plans.forecasts import split_bounds
from tests.helpers import at

SAMPLES = "station_id string, window_start timestamp, horizon int, sample_id int, value double"
ACTUALS = "station_id string, window_start timestamp, horizon int, actual double"


def tables(spark, draws, truth, horizon=3):
    s = [("a", at(i), horizon, k, float(v)) for i, row in enumerate(draws) for k, v in enumerate(row)]
    a = [("a", at(i), horizon, float(v)) for i, v in enumerate(truth)]
    return spark.createDataFrame(s, SAMPLES), spark.createDataFrame(a, ACTUALS)


def test_crps_is_zero_for_a_perfect_forecast(spark):
    s, a = tables(spark, np.full((4, 50), 7.0), np.full(4, 7.0))
    assert [r.crps for r in fc.crps(s, a).collect()] == [0.0] * 4


def test_crps_equals_the_pairwise_definition(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(20, 5, (6, 40)), rng.normal(20, 5, 6)
    s, a = tables(spark, x, y)
    got = [r.crps for r in fc.crps(s, a).orderBy("window_start").collect()]
    n = 40
    want = [
        np.abs(xi - yi).mean() - np.abs(xi[:, None] - xi[None, :]).sum() / (2 * n * (n - 1)) for xi, yi in zip(x, y)
    ]
    assert got == pytest.approx(want)


def test_crps_of_a_single_draw_is_the_absolute_error(spark):
    s, a = tables(spark, [[3.0]], [5.0])
    assert fc.crps(s, a).first().crps == 2.0


def test_quantiles_equal_numpy(spark):
    x = np.random.default_rng(1).normal(0, 3, (5, 63))
    s, _ = tables(spark, x, np.zeros(5))
    for r, xi in zip(fc.sample_quantiles(s).orderBy("window_start").collect(), x):
        assert (r.p05, r.p50, r.p95) == pytest.approx(tuple(np.percentile(xi, [5, 50, 95])))


def test_interval_and_point_metrics(spark):
    rows = [("a", at(0), 3, 5.0, 10.0, 15.0), ("a", at(1), 3, 0.0, 10.0, 20.0)]
    q = spark.createDataFrame(rows, "station_id string, window_start timestamp, horizon int, p05 double, p50 double, p95 double")
    a = spark.createDataFrame([("a", at(0), 3, 10.0), ("a", at(1), 3, 20.0)], ACTUALS)
    got = {r.horizon: r for r in fc.evaluate_quantiles(q, a).collect()}
    assert got["3"].mean_width == 15.0 and got["3"].pi_coverage_pct == 100.0
    assert got["overall"].mae == 5.0 and got["overall"].rmse == pytest.approx(50**0.5)
    f = spark.createDataFrame([("a", at(0), 3, 12.0)], "station_id string, window_start timestamp, horizon int, predicted double")
    assert {r.horizon: r.mape for r in fc.evaluate_point(f, a).collect()}["3"] == pytest.approx(20.0)


def test_overall_crps_is_the_mean_of_the_horizons(spark):
    s1, a1 = tables(spark, [[0.0], [0.0], [0.0]], [1.0, 1.0, 1.0], 3)
    s2, a2 = tables(spark, [[0.0]], [5.0], 12)
    got = {r.horizon: r for r in fc.evaluate_samples(s1.union(s2), a1.union(a2)).collect()}
    assert got["overall"].crps == 3.0 and got["overall"].mae == 2.0


def test_conformal_margins_equal_numpy_and_widen(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(20, 2, (57, 30)), rng.normal(20, 6, 57)
    s, a = tables(spark, x, y)
    m = calibrate_conformal(s, a).first()
    n = 57
    level = min(np.ceil((n + 1) * 0.9) / n, 1.0)
    p05, p95 = np.percentile(x, [5, 95], axis=1)
    assert m.n == n and m.q_level == pytest.approx(level)
    assert m.upper == pytest.approx(np.quantile(np.maximum(y - p95, 0), level))
    assert m.lower == pytest.approx(np.quantile(np.maximum(p05 - y, 0), level))
    assert m.coverage_after >= m.coverage_before
    margins = calibrate_conformal(s, a)
    plain = {r.horizon: r for r in fc.evaluate_samples(s, a).collect()}
    wide = {r.horizon: r for r in apply_conformal(s, a, margins).collect()}
    assert wide["3"].mean_width == pytest.approx(plain["3"].mean_width + m.upper + m.lower)
    assert wide["3"].crps == pytest.approx(plain["3"].crps) and wide["3"].mae == pytest.approx(plain["3"].mae)
    assert wide["3"].conformal_margin_upper == pytest.approx(m.upper)


def test_seasonal_ensemble_uses_the_latest_days_before_the_window(spark):
    df = spark.createDataFrame([("a", at(h), float(h)) for h in range(600)], "station_id string, timestamp timestamp, pm25 double")
    start, end = datetime(2024, 1, 20), datetime(2024, 1, 23, 23)
    s = fc.seasonal_ensemble(df, start, end, members=3).where("window_start = '2024-01-20'")
    got = {}
    for r in s.collect():
        got.setdefault(r.horizon, {})[r.sample_id] = r.value
    t = 19 * 24
    for h in (3, 12, 24, 72):
        hour = (t + h - 1) % 24
        assert got[h] == {k: float(t - 24 * k + hour) for k in (1, 2, 3)}
    a = fc.window_actuals(df, start, end)
    assert {r.window_start.day for r in a.collect()} == {20, 21}
    assert a.where("window_start = '2024-01-21' and horizon = 72").first().actual == t + 24 + 71


def test_breach_risk_and_status(spark):
    s, a = tables(spark, [[30, 40, 60, 60], [10, 10, 10, 10]], [50.0, 10.0])
    b = {r.window_start: r for r in alerts.breach_probability(s).collect()}
    first = b[min(b)]
    assert (first.p_advisory, first.p_warning) == (0.75, 0.5)
    scores = alerts.risk_score(alerts.breach_probability(s))
    status = [r.status for r in alerts.station_status(scores).orderBy("window_start").collect()]
    assert status == ["WARNING", "CLEAR"]
    q = alerts.alert_quality(alerts.breach_probability(s), a).first()
    assert (q.precision, q.recall) == (1.0, 1.0)
    br = alerts.brier(alerts.breach_probability(s), a).first()
    assert br.advisory_brier == pytest.approx(0.25**2 / 2) and br.warning_brier == pytest.approx(0.125)


def test_narrow_forecasts_weigh_most(spark):
    s1, _ = tables(spark, [[36, 36.1, 35, 36]], [0.0], 3)
    s2, _ = tables(spark, [[0, 100, 0, 0]], [0.0], 72)
    r = alerts.risk_score(alerts.breach_probability(s1.union(s2))).first()
    assert 0.7 < r.advisory_score <= 0.75


def test_split_bounds():
    from datetime import date

    b = split_bounds(date(2024, 1, 20), date(2024, 1, 25), datetime(2024, 1, 30, 23))
    assert b["val"] == (datetime(2024, 1, 21), datetime(2024, 1, 25, 23))
    assert b["test"][0] == datetime(2024, 1, 26)
