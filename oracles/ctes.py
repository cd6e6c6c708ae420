"""Named SQL building blocks of the oracles (DuckDB), written from the operators' meaning."""

from __future__ import annotations

from hourweave import fixtures, model

P = model.PARAMETERS
NUDGE = "1.3e-8"


def r(expr: str) -> str:
    return f"round(({expr}) + {NUDGE}, 6)"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows)


def _bounds(table: dict) -> str:
    return _rows((p, lo, hi) for p, (lo, hi) in table.items())


def _case(mapping: dict, column: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in mapping.items())
    return f"CASE {column} {arms} END"


CTES: dict[str, tuple[tuple, str]] = {}


def cte(name: str, *needs: str):
    def keep(sql: str) -> None:
        CTES[name] = (needs, sql)

    return keep


cte("base")(
    "base(i, sid, lat, lon, elev, kind) AS (VALUES "
    + _rows((i, *s) for i, s in enumerate(fixtures.BASE_STATIONS))
    + ")"
)
cte("stations", "base")("""
stations AS (
  SELECT CASE WHEN net = 0 THEN sid ELSE sid || '-' || net END AS station_id,
         'site-' || i AS name, i AS site,
         lat - (net % 30) * 2 AS lat,
         CASE WHEN lon + ((net // 30) % 120) * 3 > 180 THEN lon + ((net // 30) % 120) * 3 - 360
              ELSE lon + ((net // 30) % 120) * 3 END AS lon,
         elev AS elevation_m, split_part(sid, '-', 2) AS county_code,
         split_part(sid, '-', 1) AS state_code, kind AS monitor_type
  FROM base CROSS JOIN (SELECT DISTINCT user_id // 190 AS net FROM events) n)""")
cte("raw", "base")(f"""
raw AS (
  SELECT event_id, station_id, parameter, timestamp, k,
         CASE WHEN k < 3 THEN -m WHEN k = 3 THEN m * 1000
              ELSE m * CASE parameter WHEN 'o3' THEN 0.001::DOUBLE WHEN 'co' THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END
         END AS value,
         {_case(model.UNITS, "parameter")} AS unit,
         CASE WHEN k >= 95 THEN 1 ELSE 0 END AS quality_flag, k % 3 + 1 AS poc
  FROM (
    SELECT event_id, value AS m,
           CASE WHEN user_id // 190 = 0 THEN sid ELSE sid || '-' || (user_id // 190) END AS station_id,
           CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'no2' WHEN 'signup' THEN 'o3'
                           WHEN 'error' THEN 'pm10' WHEN 'purchase' THEN 'co' END AS parameter,
           date_trunc('hour', ts) AS timestamp,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
    FROM events JOIN base ON i = user_id % 19) x)""")
cte("readings", "raw")("""
readings AS (
  SELECT station_id, parameter, value, unit, timestamp, quality_flag FROM raw
  QUALIFY row_number() OVER (PARTITION BY station_id, parameter, timestamp ORDER BY poc, event_id) = 1)""")
cte("flagged", "readings")(f"""
flagged AS (
  SELECT r.* REPLACE (greatest(r.quality_flag,
           CASE WHEN value < i.lo OR value > i.hi THEN 2 WHEN value < s.lo OR value > s.hi THEN 1 ELSE 0 END) AS quality_flag)
  FROM readings r
  LEFT JOIN (VALUES {_bounds(model.INVALID_BOUNDS)}) i(p, lo, hi) ON i.p = parameter
  LEFT JOIN (VALUES {_bounds(model.SUSPECT_BOUNDS)}) s(p, lo, hi) ON s.p = parameter)""")
cte("valid", "flagged")("""
valid AS (SELECT * REPLACE (CASE WHEN quality_flag < 2 THEN value END AS value) FROM flagged)""")
cte("grid", "valid")("""
grid AS (
  SELECT s.station_id, h.timestamp
  FROM (SELECT station_id, min(timestamp) AS a, max(timestamp) AS b FROM valid GROUP BY 1) s,
       LATERAL (SELECT unnest(generate_series(s.a, s.b, INTERVAL 1 HOUR)) AS timestamp) h)""")
cte("wide", "valid")(
    "wide AS (SELECT station_id, timestamp, "
    + ", ".join(f"max(value) FILTER (parameter = '{p}') AS {p}" for p in P)
    + " FROM valid GROUP BY 1, 2)"
)
cte("long", "grid", "valid")(f"""
long AS MATERIALIZED (
  SELECT g.station_id, q.p AS parameter, g.timestamp, v.value AS v,
         date_diff('hour', min(g.timestamp) OVER (PARTITION BY g.station_id), g.timestamp) AS t
  FROM grid g CROSS JOIN (VALUES {_rows((p,) for p in P)}) q(p)
  LEFT JOIN valid v ON v.station_id = g.station_id AND v.timestamp = g.timestamp AND v.parameter = q.p)""")
cte("runs", "long")("""
runs AS (
  SELECT *, count(v) OVER (PARTITION BY station_id, parameter ORDER BY timestamp) AS grp,
         first_value(v IGNORE NULLS) OVER (PARTITION BY station_id, parameter ORDER BY timestamp
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM long)""")
cte("tier1", "runs")("""
tier1 AS MATERIALIZED (
  SELECT station_id, parameter, timestamp, t, v, grp, nv,
         CASE WHEN v IS NOT NULL THEN v
              WHEN run_len <= 3 AND grp > 0 AND nv IS NOT NULL THEN lv + (nv - lv) * pos / (run_len + 1) END AS v1,
         v IS NULL AND run_len BETWEEN 4 AND 24 AS t2
  FROM (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, parameter, grp) AS run_len,
               first_value(v) OVER (PARTITION BY station_id, parameter, grp ORDER BY timestamp) AS lv,
               row_number() OVER (PARTITION BY station_id, parameter, grp ORDER BY timestamp)
                 - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS pos
        FROM runs) x)""")
cte("fold", "tier1")("""
fold AS (
  SELECT station_id, parameter, t % 24 AS o, t // 24 AS d, timestamp, y, [y] AS h
  FROM (SELECT *, CASE WHEN t2 THEN NULL ELSE v1 END AS y FROM tier1 WHERE t < 24) s
  UNION ALL
  SELECT station_id, parameter, o, d, timestamp, y, list_slice(list_append(h, y), -14, -1)
  FROM (SELECT n.station_id, n.parameter, f.o, f.d + 1 AS d, n.timestamp, f.h,
               CASE WHEN NOT n.t2 THEN n.v1
                    WHEN list_count(list_slice(f.h, -7, -1)) >= 4 THEN list_median(list_slice(f.h, -7, -1))
                    ELSE list_median(f.h) END AS y
        FROM fold f JOIN tier1 n
          ON n.station_id = f.station_id AND n.parameter = f.parameter AND n.t = (f.d + 1) * 24 + f.o) z)""")
cte("imputed", "fold")(
    "imputed AS MATERIALIZED (SELECT station_id, timestamp, "
    + ", ".join(f"max(y) FILTER (parameter = '{p}') AS {p}" for p in P)
    + " FROM fold GROUP BY 1, 2)"
)
_w = "PARTITION BY station_id ORDER BY timestamp"
cte("rolled", "imputed")(
    "rolled AS MATERIALIZED (SELECT *, "
    + ", ".join(f"avg(pm25) OVER ({_w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS pm25_roll{n}" for n in model.ROLLS)
    + ", "
    + ", ".join(f"lag(pm25, {n}) OVER ({_w}) AS pm25_lag{n}" for n in model.LAGS)
    + " FROM imputed)"
)


def edges_sql(name: str, settings) -> str:
    """All ordered pairs, composite distance, kernel, weights per station."""
    return f"""
{name} AS MATERIALIZED (
  SELECT lam, cutoff, station_id, neighbor_id, gap, w / sum(w) OVER (PARTITION BY lam, cutoff, station_id) AS weight
  FROM (SELECT *, 1 - power(sqrt(power(km, 2) + lam * power(gap, 2)) / cutoff, 2) AS w
        FROM (SELECT g.lam, g.cutoff, a.station_id, b.station_id AS neighbor_id, abs(a.elevation_m - b.elevation_m) AS gap,
                     2 * {model.EARTH_RADIUS_KM} * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2)
                       + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) AS km
              FROM stations a JOIN stations b ON a.station_id <> b.station_id
              CROSS JOIN (VALUES {_rows(settings)}) g(lam, cutoff)) p) k
  WHERE w > 0)"""


cte("edges", "stations")(edges_sql("edges", [(model.ELEVATION_LAMBDA, model.DISTANCE_CUTOFF_KM)]))


def spatial_sql(name: str, edges: str, keys: str = "") -> str:
    """Neighbour means on the listener's grid; ``keys`` names extra setting columns."""
    k = f"{keys}, " if keys else ""
    means = ", ".join(
        f"sum(e.weight * n.{c}) / nullif(sum(CASE WHEN n.{c} IS NOT NULL THEN e.weight END), 0) AS m_{c}"
        for c in ("pm25", "no2", "o3", "pm25_roll6")
    )
    settings = f"(SELECT DISTINCT {keys} FROM {edges}) s CROSS JOIN rolled f" if keys else "rolled f"
    own = f"{keys.replace('lam', 's.lam').replace('cutoff', 's.cutoff')}, f.station_id, f.timestamp" if keys else "f.station_id, f.timestamp"
    join = " AND ".join(
        [f"nb.{c} = s.{c}" for c in keys.split(", ") if c] + ["nb.station_id = f.station_id", "nb.timestamp = f.timestamp"]
    )
    win = f"PARTITION BY {k}station_id ORDER BY timestamp"
    ejoin = " AND ".join([f"el.{c} = x.{c}" for c in keys.split(", ") if c] + ["el.station_id = x.station_id"])
    return f"""
{name} AS MATERIALIZED (
  SELECT x.* , el.spatial_elev_diff FROM (
    SELECT {k}station_id, timestamp,
           lag(m_pm25, 1) OVER ({win}) AS spatial_pm25_lag1, lag(m_pm25, 3) OVER ({win}) AS spatial_pm25_lag3,
           m_pm25_roll6 AS spatial_pm25_roll6, lag(m_no2, 1) OVER ({win}) AS spatial_no2_lag1,
           lag(m_o3, 1) OVER ({win}) AS spatial_o3_lag1
    FROM (SELECT {own}, m_pm25, m_no2, m_o3, m_pm25_roll6
          FROM {settings} LEFT JOIN (
            SELECT {k.replace('lam', 'e.lam').replace('cutoff', 'e.cutoff')}e.station_id, n.timestamp, {means}
            FROM {edges} e JOIN rolled n ON n.station_id = e.neighbor_id GROUP BY ALL) nb ON {join}) y) x
  LEFT JOIN (SELECT {k}station_id, sum(weight * gap) AS spatial_elev_diff FROM {edges}
             WHERE neighbor_id IN (SELECT station_id FROM rolled) GROUP BY ALL) el ON {ejoin})"""


cte("spatial", "rolled", "edges")(spatial_sql("spatial", "edges"))
cte("features", "rolled", "spatial")(f"""
features AS MATERIALIZED (
  SELECT r.station_id, r.timestamp, {", ".join(f"r.{p}" for p in P)},
         hour(r.timestamp)::INTEGER AS hour_of_day, (isodow(r.timestamp) - 1)::INTEGER AS day_of_week,
         month(r.timestamp)::INTEGER AS month, isodow(r.timestamp) >= 6 AS is_weekend,
         {", ".join(f"r.{c}" for c in model.ROLLING)}, {", ".join(f"s.{c}" for c in model.SPATIAL)},
         CASE WHEN r.timestamp::DATE <= DATE '{fixtures.TRAIN_END}' THEN 'train'
              WHEN r.timestamp::DATE <= DATE '{fixtures.VAL_END}' THEN 'val' ELSE 'test' END AS split
  FROM rolled r JOIN spatial s ON s.station_id = r.station_id AND s.timestamp = r.timestamp)""")


def fill(c: str) -> str:
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({_w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"
    )


cte("filled", "rolled")(
    "filled AS MATERIALIZED (SELECT station_id, timestamp, " + fill("pm25") + " AS pm25, "
    "hour(timestamp) AS hour_of_day, isodow(timestamp) - 1 AS day_of_week, month(timestamp) AS month, "
    "isodow(timestamp) >= 6 AS is_weekend FROM rolled)"
)

STARTS = {"val": "TIMESTAMP '2024-01-21'", "test": "TIMESTAMP '2024-01-26'"}
_HORIZONS = _rows((h,) for h in model.HORIZONS)
for _period, _start in STARTS.items():
    cte(f"targets_{_period}", "filled")(f"""
targets_{_period} AS (
  SELECT station_id, {_start} + INTERVAL (d) DAY AS window_start, h AS horizon,
         {_start} + INTERVAL (d) DAY + INTERVAL (h - 1) HOUR AS at
  FROM (SELECT DISTINCT station_id FROM filled) s CROSS JOIN (VALUES (0), (1), (2)) w(d)
  CROSS JOIN (VALUES {_HORIZONS}) z(h))""")
    # same-hour values of the 14 days before the window; the k-th latest day is sample k
    cte(f"samples_{_period}", f"targets_{_period}")(f"""
samples_{_period} AS (
  SELECT t.station_id, window_start, horizon,
         (date_diff('day', date_trunc('day', f.timestamp), date_trunc('day', window_start - INTERVAL 1 HOUR)) + 1)
            AS sample_id, pm25 AS value
  FROM targets_{_period} t JOIN filled f
    ON f.station_id = t.station_id AND hour(f.timestamp) = hour(t.at)
   AND f.timestamp < window_start AND f.timestamp >= window_start - INTERVAL 14 DAY)""")
    cte(f"actuals_{_period}", f"targets_{_period}")(f"""
actuals_{_period} AS (
  SELECT t.station_id, window_start, horizon, pm25 AS actual
  FROM targets_{_period} t JOIN filled f ON f.station_id = t.station_id AND f.timestamp = t.at)""")

cte("samples_vec")(f"""
samples_vec AS (
  SELECT 'vector' AS station_id, TIMESTAMP '2024-01-01' + INTERVAL (vec_id) HOUR AS window_start,
         CASE vec_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 24 ELSE 72 END AS horizon,
         i AS sample_id, 20.0::DOUBLE + 40.0::DOUBLE * embedding[i]::DOUBLE AS value
  FROM embeddings CROSS JOIN range(1, 64) q(i))""")
cte("actuals_vec")("""
actuals_vec AS (
  SELECT 'vector' AS station_id, TIMESTAMP '2024-01-01' + INTERVAL (vec_id) HOUR AS window_start,
         CASE vec_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 24 ELSE 72 END AS horizon,
         20.0::DOUBLE + 40.0::DOUBLE * embedding[64]::DOUBLE AS actual
  FROM embeddings)""")
_KEY = "station_id, window_start, horizon"
for _s in ("val", "test", "vec"):
    cte(f"scores_{_s}", f"samples_{_s}", f"actuals_{_s}")(f"""
scores_{_s} AS MATERIALIZED (
  SELECT {_KEY}, any_value(actual) AS actual, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50,
         quantile_cont(value, 0.95) AS p95,
         avg(abs(value - actual)) - CASE WHEN count(*) > 1
           THEN sum((2 * rk - n - 1) * value) / (count(*) * (count(*) - 1)) ELSE 0 END AS crps
  FROM (SELECT s.*, a.actual, row_number() OVER (PARTITION BY {", ".join("s." + c for c in _KEY.split(", "))} ORDER BY value) AS rk,
               count(*) OVER (PARTITION BY {", ".join("s." + c for c in _KEY.split(", "))}) AS n
        FROM samples_{_s} s JOIN actuals_{_s} a USING ({_KEY})) x
  GROUP BY {_KEY})""")
    cte(f"margins_{_s}", f"scores_{_s}")(f"""
margins_{_s} AS MATERIALIZED (
  SELECT horizon, any_value(n) AS n, any_value(lev) AS q_level,
         max(q) FILTER (side = 'upper') AS upper, max(q) FILTER (side = 'lower') AS lower
  FROM (SELECT horizon, side, any_value(n) AS n, any_value(lev) AS lev,
               max(shot) FILTER (rk = floor((n - 1) * lev) + 1)
               + (max(shot) FILTER (rk = ceil((n - 1) * lev) + 1) - max(shot) FILTER (rk = floor((n - 1) * lev) + 1))
                 * (any_value((n - 1) * lev) - floor(any_value((n - 1) * lev))) AS q
        FROM (SELECT *, least(ceil((n + 1) * (1 - 0.1::DOUBLE)) / n, 1.0::DOUBLE) AS lev
              FROM (SELECT *, row_number() OVER (PARTITION BY horizon, side ORDER BY shot) AS rk,
                           count(*) OVER (PARTITION BY horizon, side) AS n
                    FROM (SELECT horizon, 'upper' AS side, greatest(actual - p95, 0) AS shot FROM scores_{_s}
                          UNION ALL SELECT horizon, 'lower', greatest(p05 - actual, 0) FROM scores_{_s}) a) b) c
        GROUP BY horizon, side) e
  GROUP BY horizon)""")
    cte(f"breach_{_s}", f"samples_{_s}")(f"""
breach_{_s} AS (
  SELECT {_KEY}, avg(CASE WHEN value > {model.ADVISORY_THRESHOLD} THEN 1.0::DOUBLE ELSE 0 END) AS p_advisory,
         avg(CASE WHEN value > {model.WARNING_THRESHOLD} THEN 1.0::DOUBLE ELSE 0 END) AS p_warning,
         stddev_pop(value) AS sigma
  FROM samples_{_s} GROUP BY {_KEY})""")


def compose(final: str, *needs: str, extra: tuple[str, ...] = ()) -> str:
    """``WITH`` clause of ``needs`` and what they need, in order, then ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in needs:
        visit(name)
    parts = [CTES[n][1].strip() for n in order] + [e.strip() for e in extra]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final
