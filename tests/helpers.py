"""Small data builders and plain restatements of the rules."""

from datetime import datetime, timedelta, timezone

import numpy as np

from hourweave import model

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(hour):
    return T0 + timedelta(hours=int(hour))


def readings_frame(spark, rows):
    """rows: (station, parameter, value, hour[, flag])"""
    full = [
        (s, p, None if v is None else float(v), model.UNITS.get(p, "?"), at(h), flag[0] if flag else 0)
        for s, p, v, h, *flag in rows
    ]
    return spark.createDataFrame(full, model.READING_SCHEMA)


def series(df, column, station="a"):
    rows = df.where(f"station_id = '{station}'").orderBy("timestamp").collect()
    return [r[column] for r in rows]


def gappy(seed, hours, keep=None):
    """A random series with gaps of 1-40 hours (None = missing)."""
    rng = np.random.default_rng(seed)
    out, h = [], 0
    while h < hours:
        run = int(rng.integers(1, 60))
        gap = int(rng.choice([1, 2, 3, 4, 10, 24, 25, 40]))
        for _ in range(min(run, hours - h)):
            out.append(float(np.round(rng.uniform(1, 50), 2)))
            h += 1
        for _ in range(min(gap, hours - h)):
            out.append(None)
            h += 1
    return out


def impute_plainly(values, first_hour=0):
    """The tiers, run by run, on one hourly list."""
    s = list(values)
    n = len(s)
    runs, i = [], 0
    while i < n:
        if s[i] is not None:
            i += 1
            continue
        j = i
        while j < n and s[j] is None:
            j += 1
        runs.append((i, j))
        i = j
    for a, b in runs:
        size = b - a
        if size <= 3:
            if a > 0 and b < n:
                for k in range(size):
                    s[a + k] = s[a - 1] + (s[b] - s[a - 1]) * (k + 1) / (size + 1)
        elif size <= 24:
            for t in range(a, b):
                for days in (7, 14):
                    found = [s[t - 24 * d] for d in range(1, days + 1) if t - 24 * d >= 0]
                    found = [x for x in found if x is not None]
                    if len(found) >= 4 or (days == 14 and found):
                        s[t] = float(np.median(found))
                        break
    return s
