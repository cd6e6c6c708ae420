"""One SQL statement per registered query."""

from __future__ import annotations

from hourweave import fixtures, model
from hourweave.plans.search import default_grid
from hourweave.registry import FILL_COLUMNS, SENSITIVITY
from oracles.ctes import compose, edges_sql, fill, r, spatial_sql

P = model.PARAMETERS
READ = "station_id, parameter, {v} AS value, unit, timestamp, quality_flag"
SERIES = "station_id, parameter"
KEY = "station_id, window_start, horizon"
ADV, WARN = model.ADVISORY_THRESHOLD, model.WARNING_THRESHOLD


def rs(*columns: str) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def reading(source: str, where: str = "") -> str:
    return f"SELECT {READ.format(v=r('value'))} FROM {source} {where}"


FEATURES = (
    "station_id, timestamp, " + rs(*P) + ", hour_of_day, day_of_week, month, is_weekend, "
    + rs(*model.ROLLING, *model.SPATIAL) + ", split"
)
FEATURE_SQL = compose(f"SELECT {FEATURES} FROM features", "features")

COMPLETE = f"""
SELECT {SERIES}, count(*) AS n_readings, min(timestamp) AS earliest, max(timestamp) AS latest,
       count(*) FILTER (value IS NOT NULL AND quality_flag = 0) AS n_valid,
       round(100.0::DOUBLE * count(*) FILTER (value IS NOT NULL AND quality_flag = 0) / count(*), 1) AS pct_valid
FROM readings {{where}} GROUP BY station_id, parameter"""
COMPLETE_OUT = f"{SERIES}, n_readings, earliest, latest, n_valid, {r('pct_valid')} AS pct_valid"

IMPLAUSIBLE = " OR ".join(
    f"(parameter = '{p}' AND (value < {lo} OR value > {hi}))" for p, (lo, hi) in model.PLAUSIBLE_BOUNDS.items()
)
UNIT_OF = "CASE parameter " + " ".join(f"WHEN '{p}' THEN '{u}'" for p, u in model.UNITS.items()) + " END"


def months(days: str) -> str:
    return f"""
copies AS (SELECT r.* REPLACE (timestamp + INTERVAL (d) DAY AS timestamp)
           FROM readings r CROSS JOIN (VALUES {days}) q(d)),
monthly AS (SELECT {SERIES}, date_trunc('month', timestamp) AS m, count(*) AS n_readings FROM copies GROUP BY ALL)"""


LOW_MONTHS = f"""
SELECT {SERIES}, strftime(m, '%Y-%m') AS ym, n_readings, hours AS possible_hours, {r('n_readings / hours')} AS coverage
FROM (SELECT *, min(m) OVER (PARTITION BY {SERIES}) AS a, max(m) OVER (PARTITION BY {SERIES}) AS b,
             (day(last_day(m)) * 24)::INTEGER AS hours FROM monthly WHERE station_id <> '06-059-2022') x
WHERE m > a AND m < b AND n_readings / hours < {{limit}}"""
SILENT_MONTHS = f"""
SELECT {SERIES}, strftime(m, '%Y-%m') AS ym
FROM (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS q
      FROM (SELECT s.station_id, s.parameter, s.m, coalesce(c.n_readings, 0) AS n
            FROM (SELECT {SERIES}, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS m
                  FROM (SELECT {SERIES}, min(m) AS a, max(m) AS b FROM monthly GROUP BY ALL) e) s
            LEFT JOIN monthly c USING (station_id, parameter, m)) g
      WINDOW w AS (PARTITION BY {SERIES} ORDER BY m)) z
WHERE n = 0 AND p > 0 AND q > 0"""
LOW_COVERAGE = f"""
SELECT {SERIES}, n_readings, possible_hours, {r('n_readings / possible_hours')} AS coverage
FROM (SELECT {SERIES}, count(*) AS n_readings, date_diff('hour', min(timestamp), max(timestamp)) + 1 AS possible_hours
      FROM readings WHERE station_id <> '06-059-2022' GROUP BY {SERIES}) x
WHERE possible_hours >= 24 AND n_readings / possible_hours < 0.8"""
DUPLICATES = "SELECT station_id, parameter, timestamp, count(*) AS n FROM {t} GROUP BY ALL HAVING count(*) > 1"
P999 = "quantile_cont(value, 0.999::DOUBLE)"

SAMPLE_ROWS = """
landed AS (
  SELECT station_id, parameter, timestamp, CASE WHEN k <> 60 THEN value END AS value, unit,
         CASE WHEN k >= 95 THEN 1 ELSE 0 END AS quality_flag,
         CASE WHEN k % 7 = 0 THEN 99 ELSE poc END AS poc, event_id
  FROM raw WHERE k <> 50)"""
MONITORS = """
monitors AS (
  SELECT station_id, site, name || CASE WHEN poc = 2 THEN '-b' ELSE '' END AS name, lat, lon, CASE WHEN site <> 15 THEN elevation_m END AS elevation_m, county_code, state_code,
         monitor_type = 'FEM' AND poc = 2 AS fem, poc
  FROM stations CROSS JOIN (VALUES (1), (2)) q(poc)
  WHERE NOT (site = 9 AND poc = 2) AND NOT (site = 5 AND poc = 1)
    AND lat BETWEEN 33.5 AND 34.8 AND lon BETWEEN -118.9 AND -117.0)"""


def _metrics(source: str, measures: dict[str, str], out: list[str]) -> str:
    """Per horizon and pooled; the pooled CRPS is the mean over horizons."""
    per = ", ".join(f"{e} AS {n}" for n, e in measures.items())
    return f"""
SELECT horizon, n, {", ".join(out)} FROM (
  SELECT horizon::VARCHAR AS horizon, count(*) AS n, {per} FROM {source} GROUP BY horizon
  UNION ALL
  SELECT 'overall', count(*), {per} FROM {source}) x"""


POINT = {"mae": "avg(abs(p50 - actual))", "rmse": "sqrt(avg(power(p50 - actual, 2)))"}
BAND = {
    "pi_coverage_pct": "avg(CASE WHEN actual >= p05 AND actual <= p95 THEN 1.0::DOUBLE ELSE 0 END) * 100",
    "mean_width": "avg(p95 - p05)",
}
CRPS = {"crps": "avg(crps)"}


def sample_metrics(source: str) -> str:
    base = _metrics(source, POINT | BAND | CRPS, [rs(*POINT, *BAND), "crps"])
    return f"""
SELECT horizon, n, mae, rmse, pi_coverage_pct, mean_width,
       {r(f"CASE WHEN horizon = 'overall' THEN (SELECT avg(c) FROM (SELECT avg(crps) AS c FROM {source} GROUP BY horizon)) ELSE crps END")} AS crps
FROM ({base}) m"""


def margins(s: str) -> str:
    return f"""
SELECT m.horizon, any_value(m.n) AS n, {r('any_value(q_level)')} AS q_level, {r('any_value(upper)')} AS upper,
       {r('any_value(lower)')} AS lower,
       {r('avg(CASE WHEN actual BETWEEN p05 AND p95 THEN 100.0::DOUBLE ELSE 0 END)')} AS coverage_before,
       {r('avg(CASE WHEN actual BETWEEN p05 - lower AND p95 + upper THEN 100.0::DOUBLE ELSE 0 END)')} AS coverage_after
FROM margins_{s} m JOIN scores_{s} s ON s.horizon = m.horizon GROUP BY m.horizon"""


WIDENED = """
widened AS (
  SELECT s.* REPLACE (p05 - lower AS p05, p95 + upper AS p95)
  FROM scores_test s JOIN margins_val m ON m.horizon = s.horizon)"""

RISK = f"""
SELECT station_id, window_start,
       sum(p_advisory / greatest(sigma, 1e-6)) / sum(1 / greatest(sigma, 1e-6)) AS advisory_score,
       sum(p_warning / greatest(sigma, 1e-6)) / sum(1 / greatest(sigma, 1e-6)) AS warning_score
FROM breach_test GROUP BY station_id, window_start"""


def status(a: str, w: str, at: float = 0.5) -> str:
    return f"CASE WHEN {w} >= {at} THEN 'WARNING' WHEN {a} >= {at} THEN 'ADVISORY' ELSE 'CLEAR' END"


BRIER = (
    f"avg(power(p_advisory - CASE WHEN actual > {ADV} THEN 1 ELSE 0 END, 2)) AS advisory_brier, "
    f"avg(power(p_warning - CASE WHEN actual > {WARN} THEN 1 ELSE 0 END, 2)) AS warning_brier"
)


def sensitivity() -> str:
    thresholds = sorted({t for a, w, _ in [(ADV, WARN, 0.5), *SENSITIVITY] for t in (a, w)})
    col = {t: f"q{i}" for i, t in enumerate(thresholds)}
    shares = ", ".join(f"avg(CASE WHEN value > {t} THEN 1.0::DOUBLE ELSE 0 END) AS {c}" for t, c in col.items())
    score = ", ".join(f"sum({c} / greatest(sigma, 1e-6)) / sum(1 / greatest(sigma, 1e-6)) AS {c}" for c in col.values())
    base = status(col[ADV], col[WARN])
    arms = " UNION ALL ".join(
        f"SELECT {r(f'{a}::DOUBLE')} AS advisory, {r(f'{w}::DOUBLE')} AS warning, {r(f'{at}::DOUBLE')} AS active_at, count(*) AS n_statuses, "
        f"count(*) FILTER ({status(col[a], col[w], at)} <> {base}) AS n_changed FROM risk"
        for a, w, at in SENSITIVITY
    )
    extra = f"""
risk AS (SELECT station_id, window_start, {score}
         FROM (SELECT {KEY}, stddev_pop(value) AS sigma, {shares} FROM samples_test GROUP BY {KEY}) x
         GROUP BY station_id, window_start)"""
    return compose(arms, "samples_test", extra=(extra,))


def _batch(ts: str, source: str, n: int) -> str:
    h = f"(epoch({ts})::BIGINT // 3600)"
    lo, hi = (f"(SELECT {f}({h}) FROM {source})" for f in ("min", "max"))
    return f"((({h} - {lo}) * {n}) // ({hi} - {lo} + 1) + 1)::INTEGER"


def psi() -> str:
    feats = ("pm25", "pm25_roll6", "pm25_lag24", "spatial_pm25_lag1", "no2", "o3")
    melt = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, split, timestamp, round({f}, 9) AS value FROM features WHERE {f} IS NOT NULL" for f in feats
    )
    extra = (
        f"melt AS MATERIALIZED ({melt})",
        "cuts AS (SELECT feature, unnest(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edge FROM melt WHERE split = 'train' GROUP BY feature)",
        "test_rows AS (SELECT * FROM features WHERE split = 'test')",
        f"binned AS (SELECT feature, split, CASE WHEN split = 'train' THEN 0 ELSE {_batch('timestamp', 'test_rows', 4)} END AS batch, "
        "(SELECT count(*) FROM cuts c WHERE c.feature = m.feature AND c.edge < m.value) AS bin FROM melt m WHERE split <> 'val')",
        "counts AS (SELECT feature, batch, bin, count(*) AS n FROM binned GROUP BY ALL)",
        "keys AS (SELECT DISTINCT feature, batch FROM counts)",
        "shares AS (SELECT k.feature, k.batch, b.bin, greatest(coalesce(c.n, 0)::DOUBLE / sum(c.n) OVER (PARTITION BY k.feature, k.batch), 1e-4) AS s "
        "FROM keys k CROSS JOIN range(0, 10) b(bin) LEFT JOIN counts c ON c.feature = k.feature AND c.batch = k.batch AND c.bin = b.bin)",
    )
    return compose(
        f"SELECT p.feature, p.batch, {r('sum((p.s - q.s) * ln(p.s / q.s))')} AS psi FROM shares p JOIN shares q "
        "ON q.feature = p.feature AND q.bin = p.bin AND q.batch = 0 WHERE p.batch > 0 GROUP BY p.feature, p.batch",
        "features",
        extra=extra,
    )


def ks() -> str:
    extra = (f"b AS MATERIALIZED (SELECT p_advisory AS v, {_batch('window_start', 'breach_test', 4)} AS batch FROM breach_test)",)
    return compose(
        f"""
SELECT versus, {r('max(abs(c1 / n1 - c2 / n2))')} AS ks, any_value(n1) AS n_first, any_value(n2) AS n_other FROM (
  SELECT q.versus, x.v, (SELECT count(*) FROM b WHERE batch = 1) AS n1, (SELECT count(*) FROM b WHERE batch = q.versus) AS n2,
         (SELECT count(*) FROM b WHERE batch = 1 AND b.v <= x.v) AS c1,
         (SELECT count(*) FROM b WHERE batch = q.versus AND b.v <= x.v) AS c2
  FROM (VALUES (2), (3), (4)) q(versus) CROSS JOIN (SELECT DISTINCT v FROM b) x) z
GROUP BY versus""",
        "breach_test",
        extra=extra,
    )


def brier_drift() -> str:
    extra = (
        f"joined AS (SELECT *, {_batch('window_start', 'breach_test', 4)} AS batch FROM breach_test JOIN actuals_test USING ({KEY}))",
        f"per AS (SELECT batch, count(*) AS n, {BRIER} FROM joined GROUP BY batch)",
        f"val AS (SELECT {BRIER} FROM breach_val JOIN actuals_val USING ({KEY}))",
    )
    return compose(
        f"""SELECT batch, n, {rs('advisory_brier', 'warning_brier')},
  per.advisory_brier > 1.1 * (SELECT advisory_brier FROM val) AS advisory_drift,
  per.warning_brier > 1.1 * (SELECT warning_brier FROM val) AS warning_drift FROM per""",
        "breach_test", "actuals_test", "breach_val", "actuals_val",
        extra=extra,
    )


def scaler_cte() -> str:
    arms = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}::DOUBLE) AS mean, CASE WHEN stddev_pop({c}::DOUBLE) = 0 THEN 1 ELSE stddev_pop({c}::DOUBLE) END AS std "
        "FROM features WHERE split = 'train'"
        if c != "is_weekend"
        else f"SELECT '{c}', avg({c}::INTEGER::DOUBLE), CASE WHEN stddev_pop({c}::INTEGER::DOUBLE) = 0 THEN 1 ELSE stddev_pop({c}::INTEGER::DOUBLE) END "
        "FROM features WHERE split = 'train'"
        for c in model.MODEL_INPUTS
    )
    return f"scaler AS MATERIALIZED ({arms})"


BOUNDARY = "(split = 'val' OR (split = 'train' AND timestamp >= TIMESTAMP '2024-01-20' - INTERVAL 96 HOUR))"


def scaled_cte() -> str:
    cols = ", ".join(
        f"coalesce(({c + '::INTEGER' if c == 'is_weekend' else c} - (SELECT mean FROM scaler WHERE feature = '{c}')) / (SELECT std FROM scaler WHERE feature = '{c}'), 0) AS {c}"
        for c in model.MODEL_INPUTS
    )
    return f"scaled AS MATERIALIZED (SELECT station_id, timestamp, pm25 AS target, {cols} FROM features WHERE {BOUNDARY})"


def training_windows() -> str:
    total = " + ".join(model.MODEL_INPUTS)
    w = "OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    o = "OVER (PARTITION BY station_id ORDER BY timestamp)"
    leads = ", ".join(f"lead(target, {h}) {o} AS y{h}" for h in model.HORIZONS)
    ys = " AND ".join(f"y{h} IS NOT NULL" for h in model.HORIZONS)
    return compose(
        f"""
SELECT station_id, timestamp, 24 AS n_steps, 504 AS n_values, {rs('x_sum', 'first_pm25', 'last_pm25', 'last_elev', *[f'y{h}' for h in model.HORIZONS])}
FROM (SELECT station_id, timestamp, sum({total}) {w} AS x_sum, first_value(pm25) {w} AS first_pm25, last_value(pm25) {w} AS last_pm25,
             last_value(spatial_elev_diff) {w} AS last_elev, {leads},
             row_number() {o} AS i, count(*) OVER (PARTITION BY station_id) AS n FROM scaled) x
WHERE i > 24 AND i <= n - 72 AND {ys}""",
        "features",
        extra=(scaler_cte(), scaled_cte()),
    )


def filled_series() -> str:
    cols = ", ".join(f"{r(fill(c + '::INTEGER' if c == 'is_weekend' else c))} AS {c}" for c in FILL_COLUMNS if c != "is_weekend")
    return compose(
        f"SELECT station_id, timestamp, {cols}, {r('is_weekend::INTEGER::DOUBLE')} AS is_weekend, split, "
        "date_diff('hour', (SELECT min(timestamp) FROM features), timestamp) AS time_idx FROM features",
        "features",
    )


def rolling_instances() -> str:
    a = ", ".join(f"{r(f'max(f.pm25) FILTER (f.timestamp = w.t + INTERVAL {h - 1} HOUR)')} AS a{h}" for h in model.HORIZONS)
    return compose(
        f"""
SELECT w.station_id, any_value(w.ix) AS station_ix, w.t AS window_start, w.t - INTERVAL 168 HOUR AS start, 168 AS n_target,
       {r('sum(f.pm25) FILTER (f.timestamp < w.t)')} AS sum_target,
       {r('max(f.pm25) FILTER (f.timestamp = w.t - INTERVAL 168 HOUR)')} AS first_target,
       {r('max(f.pm25) FILTER (f.timestamp = w.t - INTERVAL 1 HOUR)')} AS last_target,
       240 AS n_calendar, {r('sum(hour_of_day)::DOUBLE')} AS sum_hours,
       {r('sum(is_weekend::INTEGER)::DOUBLE')} AS sum_weekend,
       {r('sum(f.pm25) FILTER (f.timestamp >= w.t)')} AS sum_actuals, {a}
FROM (SELECT station_id, (row_number() OVER (ORDER BY station_id) - 1) AS ix FROM (SELECT DISTINCT station_id FROM filled)) s
JOIN LATERAL (SELECT s.station_id, s.ix, unnest([TIMESTAMP '2024-01-21', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-23']) AS t) w ON true
JOIN filled f ON f.station_id = w.station_id AND f.timestamp >= w.t - INTERVAL 168 HOUR AND f.timestamp < w.t + INTERVAL 72 HOUR
GROUP BY w.station_id, w.t
HAVING count(*) FILTER (f.timestamp < w.t) = 168 AND count(*) FILTER (f.timestamp >= w.t) = 72""",
        "filled",
    )


_SEARCH = edges_sql("grid_edges", default_grid())
_TWO = edges_sql("two_edges", [(0.0005, 30.0), (0.001, 50.0)])


def param_search() -> str:
    o = "OVER (PARTITION BY station_id ORDER BY timestamp)"
    extra = (
        _SEARCH,
        spatial_sql("found", "grid_edges", "lam, cutoff"),
        f"targets AS (SELECT station_id, timestamp, split, unnest([0, 1, 2, 3]) AS nr, unnest([{', '.join(f'y{h}' for h in model.HORIZONS)}]) AS y "
        f"FROM (SELECT station_id, timestamp, split, {', '.join(f'lead(pm25, {h}) {o} AS y{h}' for h in model.HORIZONS)} FROM features) q)",
        "points AS MATERIALIZED (SELECT lam, cutoff, nr, split, spatial_pm25_lag1 AS x, y FROM found JOIN targets USING (station_id, timestamp) "
        "WHERE spatial_pm25_lag1 IS NOT NULL AND y IS NOT NULL)",
        "lines AS (SELECT lam, cutoff, nr, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM points WHERE split = 'train' GROUP BY ALL)",
        "mae AS (SELECT lam, cutoff, avg(m) AS val_mae FROM (SELECT p.lam, p.cutoff, p.nr, avg(abs(a + b * x - y)) AS m "
        "FROM points p JOIN lines l ON l.lam = p.lam AND l.cutoff = p.cutoff AND l.nr = p.nr WHERE split = 'val' GROUP BY ALL) z GROUP BY lam, cutoff)",
    )
    return compose(
        f"SELECT {r('lam')} AS lam, {r('cutoff')} AS cutoff, {r('val_mae')} AS val_mae, "
        "row_number() OVER (ORDER BY val_mae, lam, cutoff)::INTEGER AS rank FROM mae",
        "features",
        extra=extra,
    )


def summary() -> str:
    one = {
        "null_station": "station_id IS NULL",
        "null_parameter": "parameter IS NULL",
        "null_timestamp": "timestamp IS NULL",
        "null_value": "value IS NULL",
        "null_unit": "unit IS NULL",
        "unexpected_parameter": "parameter NOT IN ('pm25', 'no2', 'o3', 'pm10', 'co')",
        "unexpected_flag": "quality_flag NOT IN (0, 1, 2)",
        "off_hour": "minute(timestamp) <> 0 OR second(timestamp) <> 0",
        "out_of_range_ts": "timestamp < TIMESTAMP '2023-12-31' OR timestamp > TIMESTAMP '2024-01-31'",
        "implausible_value": IMPLAUSIBLE,
        "wrong_unit": f"unit <> {UNIT_OF}",
        "o3_at_limit": "parameter = 'o3' AND value >= 0.5",
    }
    parts = [f"SELECT '{k}' AS \"check\", count(*) FILTER ({v}) AS n_violations FROM readings" for k, v in one.items()]
    parts.append("SELECT 'too_few_rows', CASE WHEN count(*) < 1500000 THEN 1 ELSE 0 END FROM readings")
    counted = {
        "duplicate_key": DUPLICATES.format(t="readings"),
        "station_missing": "SELECT station_id FROM stations WHERE station_id NOT IN (SELECT station_id FROM readings)",
        "too_few_stations": "SELECT 1 FROM readings WHERE parameter = 'pm25' HAVING count(DISTINCT station_id) < 14",
        "incomplete": f"SELECT * FROM ({COMPLETE.format(where=chr(32))}) c WHERE parameter = 'pm25' AND pct_valid < 80",
        "low_coverage": LOW_COVERAGE,
        "crowded_day": f"SELECT 1 FROM readings GROUP BY {SERIES}, timestamp::DATE HAVING count(*) > 24",
        "low_month": LOW_MONTHS.format(limit=0.1),
        "silent_month": SILENT_MONTHS,
        "high_percentile": f"SELECT 1 FROM readings WHERE parameter = 'pm25' HAVING {P999} >= 500",
    }
    parts += [f"SELECT '{k}', count(*) FROM ({v}) t" for k, v in counted.items()]
    return compose(" UNION ALL ".join(parts), "readings", "stations", extra=(months("(0)"),))


SQL: dict[str, str] = {
    "processed_features": FEATURE_SQL,
    "stream_features": FEATURE_SQL,
    "validated_readings": compose(reading("valid"), "valid"),
    "flag_counts": compose("SELECT parameter, quality_flag, count(*) AS n FROM flagged GROUP BY ALL", "flagged"),
    "completeness": compose(f"SELECT {COMPLETE_OUT} FROM ({COMPLETE.format(where='')}) c", "readings"),
    "completeness_flagged": compose(
        f"SELECT {COMPLETE_OUT}, pct_valid >= 95 AS passing FROM ({COMPLETE.format(where='')}) c WHERE parameter = 'pm25'", "readings"
    ),
    "stage_counts": compose(
        "SELECT (SELECT count(*) FROM readings) AS n_readings, (SELECT count(*) FROM (SELECT DISTINCT station_id, timestamp FROM readings)) AS n_station_hours, "
        "(SELECT count(*) FROM grid) AS n_grid_hours", "grid", "readings",
    ),
    "extent": compose("SELECT min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(DISTINCT station_id) AS n_stations FROM readings", "readings"),
    "lowest_poc": compose(reading("readings"), "readings"),
    "clean_samples": compose(
        f"SELECT {READ.format(v=r('value'))} FROM landed WHERE value IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY station_id, parameter, timestamp ORDER BY poc, event_id) = 1",
        "raw", extra=(SAMPLE_ROWS,),
    ),
    "build_stations": compose(
        f"""SELECT station_id, CASE WHEN first(site ORDER BY poc) % 4 <> 0 THEN first(name ORDER BY poc) ELSE 'address ' || first(name ORDER BY poc) END AS name,
        {r('first(lat ORDER BY poc)')} AS lat, {r('first(lon ORDER BY poc)')} AS lon, {r('first(elevation_m ORDER BY poc)')} AS elevation_m,
        first(county_code) AS county_code, first(state_code) AS state_code, CASE WHEN bool_or(fem) THEN 'FEM' ELSE 'FRM' END AS monitor_type
        FROM monitors GROUP BY station_id""",
        "stations", extra=(MONITORS,),
    ),
    "stations_csv": compose(
        f"SELECT station_id, name, {rs('lat', 'lon', 'elevation_m')}, county_code, state_code, monitor_type FROM stations", "stations"
    ),
    "insert_new": compose(
        f"SELECT {READ.format(v=r('value'))} FROM readings n WHERE NOT EXISTS (SELECT 1 FROM readings o WHERE o.quality_flag = 0 "
        "AND o.station_id = n.station_id AND o.parameter = n.parameter AND o.timestamp = n.timestamp)", "readings",
    ),
    "messages_roundtrip": compose(reading("flagged"), "flagged"),
    "replay": compose(reading("readings", "WHERE timestamp::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'"), "readings"),
    "date_range": compose(reading("readings", "WHERE timestamp::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-19'"), "readings"),
    "wide_readings": compose(f"SELECT station_id, timestamp, {rs(*P)} FROM wide", "wide"),
    "hourly_grid": compose(
        f"SELECT station_id, timestamp, {rs(*P)} FROM grid LEFT JOIN wide USING (station_id, timestamp)", "grid", "wide"
    ),
    "calendar_split": compose(
        "SELECT station_id, timestamp, hour(timestamp)::INTEGER AS hour_of_day, (isodow(timestamp) - 1)::INTEGER AS day_of_week, "
        "month(timestamp)::INTEGER AS month, isodow(timestamp) >= 6 AS is_weekend, "
        f"CASE WHEN timestamp::DATE <= DATE '{fixtures.TRAIN_END}' THEN 'train' WHEN timestamp::DATE <= DATE '{fixtures.VAL_END}' THEN 'val' ELSE 'test' END AS split FROM grid",
        "grid",
    ),
    "gap_runs": compose(
        "SELECT station_id, parameter, min(timestamp) AS run_start, max(timestamp) AS run_end, count(*) AS run_hours, "
        "grp > 0 AS has_left, bool_or(nv IS NOT NULL) AS has_right FROM tier1 WHERE v IS NULL GROUP BY station_id, parameter, grp",
        "tier1",
    ),
    "impute_linear": compose(
        "SELECT station_id, timestamp, "
        + ", ".join(f"{r(f'''max(v1) FILTER (parameter = '{p}')''')} AS {p}" for p in P)
        + ", sum(CASE WHEN t2 THEN CASE parameter WHEN 'pm25' THEN 1 WHEN 'no2' THEN 2 WHEN 'o3' THEN 4 WHEN 'pm10' THEN 8 ELSE 16 END ELSE 0 END)::INTEGER AS pending "
        "FROM tier1 GROUP BY station_id, timestamp", "tier1",
    ),
    "impute_full": compose(f"SELECT station_id, timestamp, {rs(*P)} FROM imputed", "imputed"),
    "rolling_lags": compose(f"SELECT station_id, timestamp, {rs(*model.ROLLING)} FROM rolled", "rolled"),
    "neighbor_index": compose(f"SELECT station_id, neighbor_id, {rs('weight')} FROM edges", "edges"),
    "neighbor_index_file": compose(f"SELECT station_id, neighbor_id, {rs('weight')} FROM edges", "edges"),
    "neighbor_summary": compose(
        f"SELECT count(*) AS n_stations, min(n) AS min_neighbors, max(n) AS max_neighbors, {r('avg(n)')} AS mean_neighbors, "
        "count(*) FILTER (n = 0) AS n_isolated FROM (SELECT s.station_id, count(e.neighbor_id) AS n FROM stations s LEFT JOIN edges e USING (station_id) GROUP BY 1) c",
        "stations", "edges",
    ),
    "top_neighbors": compose(
        f"SELECT station_id, neighbor_id, {rs('weight')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY weight DESC, neighbor_id)::INTEGER AS rank FROM edges) x WHERE rank <= 5",
        "edges",
    ),
    "spatial_features": compose(f"SELECT station_id, timestamp, {rs(*model.SPATIAL)} FROM spatial", "spatial"),
    "spatial_by_setting": compose(
        f"SELECT {rs('lam', 'cutoff')}, station_id, timestamp, {rs(*model.SPATIAL)} FROM found", "rolled", "stations",
        extra=(_TWO, spatial_sql("found", "two_edges", "lam, cutoff")),
    ),
    "param_search": param_search(),
    "split_scan": compose(f"SELECT station_id, timestamp, {rs('pm25', 'pm25_roll6')}, is_weekend, split FROM features WHERE split IN ('val', 'test')", "features"),
    "boundary_scan": compose(f"SELECT station_id, timestamp, {rs('pm25')}, split FROM features WHERE {BOUNDARY}", "features"),
    "exclude_frm": compose(
        f"SELECT station_id, timestamp, {rs('pm25')} FROM rolled WHERE station_id IN (SELECT station_id FROM stations WHERE monitor_type <> 'FRM')", "rolled", "stations"
    ),
    "encoder_context": compose(
        f"SELECT station_id, timestamp, {rs('pm25')} FROM rolled WHERE timestamp >= TIMESTAMP '2024-01-26' - INTERVAL 168 HOUR", "rolled"
    ),
    "history_merge": compose(
        f"SELECT {READ.format(v=r('CASE WHEN quality_flag = 1 THEN value + 1000 ELSE value END'))} FROM readings", "readings"
    ),
    "history_lookup": compose(
        reading("readings", "WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20' AND split_part(station_id, '-', 2) = '071'"),
        "readings",
    ),
    "batch_hours": compose(
        f"SELECT station_id, timestamp, {rs('pm25')}, split FROM features WHERE (station_id, timestamp) IN (SELECT (station_id, timestamp) FROM readings WHERE parameter = 'co')",
        "features", "readings",
    ),
    "scaler": compose(f"SELECT feature, {rs('mean', 'std')} FROM scaler", "features", extra=(scaler_cte(),)),
    "scaled_features": compose(
        f"SELECT station_id, timestamp, {rs(*model.MODEL_INPUTS)} FROM scaled", "features", extra=(scaler_cte(), scaled_cte())
    ),
    "training_windows": training_windows(),
    "filled_series": filled_series(),
    "station_index": compose("SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS ix FROM stations", "stations"),
    "rolling_instances": rolling_instances(),
    "series_dataset": compose(
        f"SELECT f.station_id, any_value(ix) AS station_ix, min(timestamp) AS start, count(*) AS n, {r('sum(pm25)')} AS sum_target, {r('sum(day_of_week)::DOUBLE')} AS sum_days "
        "FROM filled f JOIN (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS ix FROM (SELECT DISTINCT station_id FROM filled)) s USING (station_id) "
        "WHERE timestamp <= TIMESTAMP '2024-01-25 23:00:00' GROUP BY f.station_id", "filled",
    ),
    "ensemble_samples": compose(f"SELECT {KEY}, sample_id::INTEGER AS sample_id, {rs('value')} FROM samples_test", "samples_test"),
    "window_actuals": compose(f"SELECT {KEY}, {rs('actual')} FROM actuals_test", "actuals_test"),
    "sample_quantiles": compose(
        f"SELECT {KEY}, {r('quantile_cont(value, 0.05)')} AS p05, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.95)')} AS p95 FROM samples_test GROUP BY {KEY}",
        "samples_test",
    ),
    "crps": compose(f"SELECT {KEY}, {rs('crps')} FROM scores_test", "scores_test"),
    "point_metrics": compose(
        _metrics("scores_test", POINT | {"mape": "avg(abs(p50 - actual) / greatest(abs(actual), 1)) * 100"}, [rs("mae", "rmse", "mape")]), "scores_test"
    ),
    "interval_metrics": compose(_metrics("scores_test", POINT | BAND, [rs(*POINT, *BAND)]), "scores_test"),
    "sample_metrics": compose(sample_metrics("scores_test"), "scores_test"),
    "vector_metrics": compose(sample_metrics("scores_vec"), "scores_vec"),
    "vector_margins": compose(margins("vec"), "margins_vec"),
    "conformal_margins": compose(margins("val"), "margins_val"),
    "conformal_margins_file": compose(f"SELECT horizon, {rs('upper', 'lower')} FROM margins_val", "margins_val"),
    "conformal_metrics": compose(
        f"SELECT t.*, {r('m.upper')} AS conformal_margin_upper, {r('m.lower')} AS conformal_margin_lower "
        f"FROM ({sample_metrics('widened')}) t LEFT JOIN margins_val m ON m.horizon::VARCHAR = t.horizon",
        "scores_test", "margins_val", extra=(WIDENED,),
    ),
    "breach_probability": compose(f"SELECT {KEY}, {rs('p_advisory', 'p_warning', 'sigma')} FROM breach_test", "breach_test"),
    "risk_score": compose(f"SELECT station_id, window_start, {rs('advisory_score', 'warning_score')} FROM ({RISK}) x", "breach_test"),
    "station_status": compose(
        f"SELECT station_id, window_start, {rs('advisory_score', 'warning_score')}, {status('advisory_score', 'warning_score')} AS status FROM ({RISK}) x", "breach_test"
    ),
    "brier": compose(
        f"SELECT horizon, n, {rs('advisory_brier', 'warning_brier')} FROM (SELECT horizon, count(*) AS n, {BRIER} FROM breach_test JOIN actuals_test USING ({KEY}) GROUP BY horizon) x",
        "breach_test", "actuals_test",
    ),
    "alert_quality": compose(
        f"""SELECT horizon, n_alerts, n_events, n_hits, {r('n_hits / nullif(n_alerts, 0)')} AS precision, {r('n_hits / nullif(n_events, 0)')} AS recall
        FROM (SELECT horizon, count(*) FILTER (p_advisory >= 0.5) AS n_alerts, count(*) FILTER (actual > {ADV}) AS n_events,
              count(*) FILTER (p_advisory >= 0.5 AND actual > {ADV}) AS n_hits FROM breach_test JOIN actuals_test USING ({KEY}) GROUP BY horizon) x""",
        "breach_test", "actuals_test",
    ),
    "psi": psi(),
    "ks": ks(),
    "brier_drift": brier_drift(),
    "threshold_sensitivity": sensitivity(),
    "qc_duplicate_keys": compose(DUPLICATES.format(t="raw"), "raw"),
    "qc_key_counts": compose(
        "SELECT n_rows, n_keys, n_rows - n_keys AS n_extra FROM (SELECT (SELECT count(*) FROM raw) AS n_rows, "
        "(SELECT count(*) FROM (SELECT DISTINCT station_id, parameter, timestamp FROM raw)) AS n_keys) x", "raw",
    ),
    "qc_row_count": compose("SELECT count(*) AS n_rows FROM readings HAVING count(*) < 1500000", "readings"),
    "qc_null_counts": compose(
        "SELECT " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in ("station_id", "parameter", "timestamp", "value", "unit")) + " FROM valid", "valid"
    ),
    "qc_unexpected_values": compose(
        "SELECT DISTINCT 'parameter' AS field, parameter || '_neg' AS found FROM raw WHERE value < 0", "raw"
    ),
    "qc_off_hour": compose(
        "SELECT event_id, station_id, timestamp + INTERVAL 30 MINUTE AS timestamp FROM raw WHERE k = 7", "raw"
    ),
    "qc_timestamp_range": compose(
        "SELECT min(timestamp) AS earliest, max(timestamp) AS latest, min(timestamp) >= TIMESTAMP '2023-12-31' AND max(timestamp) <= TIMESTAMP '2024-01-31' AS in_range FROM readings",
        "readings",
    ),
    "qc_stations_missing": compose("SELECT station_id FROM stations WHERE station_id NOT IN (SELECT station_id FROM readings)", "stations", "readings"),
    "qc_stations_per_parameter": compose("SELECT parameter, count(DISTINCT station_id) AS n_stations FROM readings GROUP BY 1", "readings"),
    "qc_too_few_stations": compose("SELECT count(DISTINCT station_id) AS n_stations FROM readings WHERE parameter = 'pm25' HAVING count(DISTINCT station_id) < 1000000", "readings"),
    "qc_incomplete": compose(
        f"SELECT {COMPLETE_OUT}, false AS passing FROM ({COMPLETE.format(where='')}) c WHERE parameter = 'pm25' AND pct_valid < 95", "readings"
    ),
    "qc_low_coverage": compose(LOW_COVERAGE, "readings"),
    "qc_crowded_days": compose(f"SELECT {SERIES}, timestamp::DATE AS day, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 6", "raw"),
    "qc_low_months": compose(LOW_MONTHS.format(limit=0.18), "readings", extra=(months("(0), (31), (60)"),)),
    "qc_silent_months": compose(SILENT_MONTHS, "readings", extra=(months("(0), (60)"),)),
    "qc_implausible": compose(reading("readings", f"WHERE {IMPLAUSIBLE}"), "readings"),
    "qc_implausible_counts": compose(f"SELECT parameter, count(*) AS n FROM readings WHERE {IMPLAUSIBLE} GROUP BY 1", "readings"),
    "qc_percentile": compose(
        f"SELECT 'pm25' AS parameter, count(value) AS n, {r(P999)} AS percentile, {P999} < 500 AS below_limit FROM readings WHERE parameter = 'pm25'", "readings"
    ),
    "qc_parameter_max": compose(f"SELECT {r('max(value)')} AS max_value, max(value) < 0.5 AS below_limit FROM readings WHERE parameter = 'o3'", "readings"),
    "qc_wrong_units": compose(
        f"SELECT station_id, parameter, {r('value')} AS value, 'ppb' AS unit, timestamp, quality_flag FROM readings WHERE quality_flag = 1 AND parameter <> 'no2'", "readings"
    ),
    "qc_summary": summary(),
}

# stores and scans give back what went in
SQL |= {
    "readings_scan": SQL["date_range"].replace("BETWEEN DATE '2024-01-08' AND DATE '2024-01-19'", ">= DATE '2024-01-01'"),
    "insert_features": f"SELECT * FROM ({FEATURE_SQL}) f WHERE split <> 'train'",
    "sample_store": SQL["ensemble_samples"],
    "scaler_store": SQL["scaler"],
    "finite_values": compose(f"SELECT event_id, CASE WHEN k NOT IN (7, 8, 9) THEN {r('value')} END AS value FROM raw", "raw"),
    "distinct_messages": compose(
        f"SELECT {READ.format(v=r('value'))} FROM readings WHERE timestamp < TIMESTAMP '2024-01-22' "
        f"UNION ALL SELECT {READ.format(v=r('value + 1000'))} FROM readings WHERE timestamp < TIMESTAMP '2024-01-13' AND hour(timestamp) % 5 = 0 "
        "AND timestamp > (SELECT max(timestamp) - INTERVAL 48 HOUR FROM readings WHERE timestamp < TIMESTAMP '2024-01-13')",
        "readings",
    ),
}
