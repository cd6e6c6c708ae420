"""Run a query and its SQL side by side and report the first differences."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"f{v:.9g}"
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return str(v)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when names, row count and every value (types included) agree."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    expected = found.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    order = sorted(names)
    place = {n: i for i, n in enumerate(names)}
    want = sorted(tuple(_plain(row[place[n]]) for n in order) for row in expected)
    got = sorted(tuple(_plain(row[n]) for n in order) for row in spark_df.collect())
    out = []
    if len(want) != len(got):
        out.append(f"rows {len(got)} != {len(want)}")
    only_got = sorted(set(got) - set(want))
    only_want = sorted(set(want) - set(got))
    if only_got or only_want:
        out.append(f"{len(only_got)} / {len(only_want)} rows differ in {order}")
        out += [f"  got  {x}" for x in only_got[:2]] + [f"  want {x}" for x in only_want[:2]]
    return out
