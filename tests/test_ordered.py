import numpy as np
import pytest
from pyspark.sql import functions as F

from hourweave.operators import ordered
from hourweave.operators.drift import ks_statistic
from hourweave.operators.ordered import dense_index, exact_quantiles, running_totals


def test_quantiles_equal_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    data = {
        "skewed": np.concatenate([np.zeros(4000), rng.lognormal(0, 4, 1500)]),
        "mixed": np.concatenate([rng.normal(0, 1, 999), -rng.exponential(1e-9, 300)]),
        "single": np.array([4.25]),
        "pair": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    levels = [0.0, 0.05, 0.5, 0.731, 0.95, 0.999, 1.0]
    out = exact_quantiles(df, ["k"], "v", lambda n: [F.lit(q) for q in levels]).collect()
    assert len(out) == len(data) * len(levels)
    for r in out:
        assert r.n == len(data[r.k])
        assert r.quantile == pytest.approx(float(np.quantile(data[r.k], r.level)), rel=1e-12, abs=1e-15)


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_VALUES", 40)


def test_narrow_bands_fill_buckets_evenly(spark, small_buckets):
    """200,000 values within a thousandth of each other, hot ones among them, and an extreme one."""
    rng = np.random.default_rng(1)
    v = np.concatenate([np.round(100 + rng.random(200_000) / 10, 7), [1e300, -1e300, 0.0], np.full(50_000, 100.05)])
    df = spark.createDataFrame([(float(x), 1) for x in v], "v double, n bigint").withColumn("k", F.lit("one"))
    held = ordered._collapsed(df, ["k"], "v", ["n"])
    sizes = [r["count"] for r in held.groupBy("_bucket").count().collect()]
    assert len(sizes) > 900 and max(sizes) < 3 * sum(sizes) / len(sizes)
    ranges = held.groupBy("_bucket").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_bucket").collect()
    assert all(x.b < y.a for x, y in zip(ranges, ranges[1:]))
    levels = [0.0, 0.05, 0.5, 0.999, 1.0]
    got = exact_quantiles(df, ["k"], "v", lambda n: [F.lit(q) for q in levels]).orderBy("level_nr").collect()
    assert [r.quantile for r in got] == pytest.approx([float(np.quantile(v, q)) for q in levels], rel=1e-12)


def test_quantiles_and_totals_do_not_depend_on_buckets(spark, small_buckets):
    test_quantiles_equal_numpy_with_a_hot_value(spark)
    test_ks_against_brute_force(spark)
    test_running_totals(spark)


def test_running_totals(spark):
    df = spark.createDataFrame([("a", float(x), 1) for x in (3, 1, 1, 2, 50)], "k string, v double, n bigint")
    out = {r.v: (r.n, r.upto_n, r.total_n) for r in running_totals(df, ["k"], "v", ["n"]).collect()}
    assert out == {1.0: (2, 2, 5), 2.0: (1, 3, 5), 3.0: (1, 4, 5), 50.0: (1, 5, 5)}


def test_dense_index(spark):
    ids = ["06-037-2", "06-037-1", "06-111-9", "01-000-5", "06-037-1"]
    out = dense_index(spark.createDataFrame([(i,) for i in ids], "station_id string"), "station_id").collect()
    assert {r.station_id: r.ix for r in out} == {"01-000-5": 0, "06-037-1": 1, "06-037-2": 2, "06-111-9": 3}


def test_many_ids_with_one_prefix_are_numbered_by_several_tasks(spark):
    ids = spark.range(100_000).select(F.concat(F.lit("06-037-same-prefix-"), F.hex("id")).alias("station_id"))
    out = dense_index(ids.union(ids.limit(500)), "station_id")
    order = [r.station_id for r in out.orderBy("ix").collect()]
    assert len(order) == 100_000 and order == sorted(order)
    assert out.agg(F.min("ix"), F.max("ix"), F.countDistinct("ix")).first()[:] == (0, 99_999, 100_000)
    dealt = out.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()})
    sizes = [r["count"] for r in dealt.groupBy("_p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3 * 100_000 / len(sizes)


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.4, 1.3, 200), 1)
    rows = [(1, float(x)) for x in a] + [(2, float(x)) for x in b]
    got = ks_statistic(spark.createDataFrame(rows, "batch int, v double"), "v", 2).first()
    points = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert got.ks == pytest.approx(want) and (got.n_first, got.n_other) == (300, 200)
