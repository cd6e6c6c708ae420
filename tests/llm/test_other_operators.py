import math

import numpy as np
import pytest

from hourweave.llm import hosts, nearest, queries
from hourweave.llm.components import connected
from hourweave.llm.overlaps import linked
from pyspark.sql import functions as F
from tests.llm.helpers import groups, none, odd


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    queries.reachable(spark)


def test_components(spark):
    r = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (220, 2))] + [(i, i + 1) for i in range(500, 540)] + [(7, 7), (None, 3)]
    found = {x.node: x.component for x in connected(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    links = [(a, b) for a, b in pairs if a is not None and a != b]
    assert found == groups({x for p in links for x in p}, links)


def test_prefix_tree_equals_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(20):
        sets = []
        for _ in range(40):
            if sets and r.random() < 0.6:
                s = sets[r.integers(len(sets))].copy()
                s[r.random(len(s)) < 0.06] = r.integers(0, 1 << 40, 1)[0]
                sets.append(np.unique(s))
            else:
                sets.append(np.unique(r.integers(0, 300, r.integers(1, 60))).astype(np.int64))
        near = [
            (y, x) for x, a in enumerate(sets) for y, b in enumerate(sets[:x])
            if 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b))
        ]
        assert groups(range(40), linked(sets, 0, (3, 4))) == groups(range(40), near)
        cut = [(y, x) for y, x in near if y < 30]
        assert groups(range(40), linked(sets, 10, (3, 4))) == groups(range(40), cut)


# --- 5 URL filters -----------------------------------------------------------

URLS = [
    "https://A.Example.org/es/1", "http://example.org/en/12?x", "https://b.org", "http://shop.com/fr/9#a", "http://shop.com/de/9",
    "http://shop.com/en/9", "nothing", None, "x://y://z", "ftp://net.example.net?q=/fr/", "http://notorg/", "http://org/a", "http://com/fr", "://h/p",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id int, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge_urls(pages).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("b.org", "", None, "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][:2] == ("y:", "//z") and got[9][:2] == ("net.example.net", "") and got[10][2] is None
    assert got[11][2] == "org/" and got[12][2] is None and got[13][:2] == ("h", "/p")
    assert hosts.judge_urls(pages.limit(0)).count() == 0


def page_rank(links, seed, damping=0.85):
    total = sum(seed.values())
    s = {h: v / total for h, v in seed.items() if v}
    rank, out = dict(s), {}
    for a, b, n in links:
        out[a] = out.get(a, 0) + n
    for _ in range(200):
        flow = {}
        for a, b, n in links:
            flow[b] = flow.get(b, 0) + damping * rank.get(a, 0) * n / out[a]
        lost = 1 - sum(flow.values())
        rank = {h: flow.get(h, 0) + lost * s.get(h, 0) for h in {*flow, *s}}
    return rank


def test_ranks_equal_power_iteration(spark):
    r = np.random.default_rng(5)
    links = {(f"h{a}", f"h{b}"): int(n) for a, b, n in zip(r.integers(0, 30, 90), r.integers(0, 30, 90), r.integers(1, 5, 90)) if a != b}
    links = [(a, b, n) for (a, b), n in links.items()]
    good, bad = {"h1": 3, "h2": 1}, {"h9": 2, "alone": 1}
    seeds = spark.createDataFrame([(h, good.get(h, 0), bad.get(h, 0)) for h in {*good, *bad}], "host string, trusted int, blocked int")
    found = {x.host: x for x in hosts.propagate(spark.createDataFrame(links, "src string, dst string, n int"), seeds).collect()}
    trust = page_rank(links, good)
    distrust = page_rank([(b, a, n) for a, b, n in links], bad)
    for h in {*trust, *distrust}:
        assert found[h].trust == pytest.approx(trust.get(h, 0), abs=1e-7)
        assert found[h].distrust == pytest.approx(distrust.get(h, 0), abs=1e-7)


def test_verdicts_follow_links(spark):
    link = lambda *h: "".join(f"<a href='https://{x}/p'>" for x in h)
    pages = [
        (1, "http://good.org/x", link("liked.net")), (2, "http://bad.com/de/", ""), (3, "http://fan.net/", link("bad.com", "BAD.com")),
        (4, "http://liked.net/", ""), (5, "http://other.net/", "<a href=/rel>"),
    ]
    got = {r.page_id: r.verdict for r in hosts.judge_urls(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}


# --- 8 top-k -----------------------------------------------------------------

def best(vectors, asks, k):
    codes = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in sorted(i for i in codes if asks(i)):
        found = sorted((-sum(a * b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)
        yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k]))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP_QUERIES", 4)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    monkeypatch.setattr(nearest, "DATA_BLOCK", 40)
    r = np.random.default_rng(6)
    centers = r.normal(0, 1, (5, 6))
    vectors = [(i, (centers[i % 5] + r.normal(0, 0.05, 6)).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[3][1]) for i in range(30)] + [(20, vectors[20][1])]
    vectors += [(300, None), (310, []), (320, [1.0] * 5 + [None]), (330, [float("nan")] + [0.0] * 5), (340, [float("inf")] * 6), (None, [0.0] * 6), (350, [0.0] * 6)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumn("code", F.lit(1)).repartition(4)
    got = sorted(map(tuple, nearest.top_k(table, F.col("vec_id") % 10 == 0).collect()))
    assert got == sorted(best(dict(v for v in vectors if v[0] is not None).items(), lambda i: i % 10 == 0, 5))


def test_top_k_small_and_huge(spark):
    table = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e14, 3.0]), (2, [-1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, nearest.top_k(table, F.col("vec_id") == 2).collect()))
    assert [g[1:3] for g in got] == [(1, 1), (2, 0)]
    assert nearest.top_k(table.limit(0), F.lit(True)).count() == 0
    assert nearest.top_k(table, F.lit(False)).count() == 0
    assert nearest.top_k(table.where("vec_id = 1"), F.lit(True)).count() == 0


# --- pipeline ----------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        before, docs = docs.count(), corpus_pipeline.written(out, "stage")
        assert name.startswith(("mixing", "Sentence")) or 0 < docs.count() <= before
    assert docs.where("n_tokens != size(ids) or ids[n_tokens - 1] != 2").count() == 0


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    for table in (odd(spark), none(spark)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_ranks_on_a_ring_settle_with_the_shipped_steps(spark):
    links = [(f"h{i}", f"h{(i + 1) % 12}", 1) for i in range(12)]
    seeds = spark.createDataFrame([("h0", 1, 0), ("h6", 0, 1)], "host string, trusted int, blocked int")
    ring = spark.createDataFrame(links, "src string, dst string, n int")
    found = {x.host: x for x in hosts.propagate(ring, seeds).collect()}
    for i in range(12):  # the walk returns to its seed with 0.15 from everywhere
        assert found[f"h{i}"].trust == pytest.approx(0.15 * 0.85**i / (1 - 0.85**12), abs=1e-8)
        assert found[f"h{i}"].distrust == pytest.approx(0.15 * 0.85 ** ((6 - i) % 12) / (1 - 0.85**12), abs=1e-8)
    with pytest.raises(ArithmeticError):
        hosts.propagate(ring, seeds, steps=20)
    assert hosts.propagate(ring, seeds.limit(0)).count() == 0


def test_small_seeds_keep_their_rank(spark):
    seeds = spark.range(1000).select(F.concat(F.lit("s"), "id").alias("host"), F.when(F.col("id") == 0, 1).otherwise(10**12).alias("trusted"), F.lit(0).alias("blocked"))
    links = spark.createDataFrame([("s0", "t", 1)], "src string, dst string, n int")
    found = {x.host: x.trust for x in hosts.propagate(links, seeds).where("host in ('s0', 't')").collect()}
    assert 0 < found["t"] < found["s0"] < 1e-14


def test_settled_keeps_its_result_alone(spark):
    import os

    from hourweave.llm import scratch

    here = []

    def build():
        inner = scratch.settled("inner", lambda: scratch.written(spark.range(6), "first").where("id > 1"))
        here.extend(inner.inputFiles())
        return scratch.written(inner, "second").where("id > 2")

    out = scratch.settled("outer", build)
    assert sorted(r.id for r in out.collect()) == [3, 4, 5]
    assert here and not any(os.path.exists(f.removeprefix("file://")) for f in here)

    def fails():
        here.extend(scratch.written(spark.range(3), "lost").inputFiles())
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        scratch.settled("failed", fails)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in here)
