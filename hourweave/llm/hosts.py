"""URL filters: rules first, then trust and distrust propagated over the host graph.

Pages whose url a rule fits get its verdict. For the others, personalised PageRank carries
trust from hosts of allowed pages along links, and distrust from hosts of blocked pages
against them; a host is blocked when distrust outweighs trust by a threshold. Every step is a
join and a sum in Spark over (host, host) edges with multiplicities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave.llm.expressions import ascii_lower
from hourweave.session import written

#: (verdict, host, path start). A rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
TOLERANCE = 1e-9
MAX_STEPS = 200
#: Share of distrust in a host's trust and distrust from which on it is blocked.
THRESHOLD = 0.75
#: Steps between two writes of the ranks, which cut their lineage.
WRITE_EVERY = 5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(at + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts in ``pages`` (host, html), counted."""
    found = pages.where("host != ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst")
    )
    return found.withColumn("dst", ascii_lower(F.col("dst"))).where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(
    links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, steps: int = MAX_STEPS
) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    ``links`` is (src, dst, n), ``seeds`` is (host, trusted, blocked), non-negative weights. Trust follows
    links, distrust goes against them. What leaves no link returns to the seeds, so either
    rank sums to 1, or is 0 everywhere if it has no seed. Stops when ranks move
    less than ``tolerance`` in sum, and fails if they still do after ``steps``. Ranks are rounded to 12 places
    below the smallest seed's share, so that no host that a seed reaches falls to 0 in a graph of very many seeds.
    """
    arcs = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").union(
        links.select(F.lit("distrust"), "dst", "src", "n")
    )
    out = arcs.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    arcs = written(arcs.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("share")), "arcs")
    base = seeds.select(F.lit("trust").alias("kind"), F.col("host"), F.col("trusted").cast("double").alias("seed")).union(
        seeds.select(F.lit("distrust"), "host", F.col("blocked").cast("double"))
    )
    sums = base.groupBy("kind").agg(F.sum("seed").alias("total"))
    base = written(base.where("seed > 0").join(sums, "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed")), "seeds")
    least = base.agg(F.min("seed")).head()[0]
    if least is None:  # no seeds, no ranks
        return base.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    places = 12 + math.ceil(-math.log10(least))
    ranks = base.withColumnRenamed("seed", "rank")
    for step in range(1, steps + 1):
        moved = arcs.join(ranks.withColumnRenamed("host", "a"), ["kind", "a"])
        inflow = moved.groupBy("kind", F.col("b").alias("host")).agg((F.sum(F.col("share") * F.col("rank")) * damping).alias("inflow"))
        kept = inflow.groupBy("kind").agg(F.sum("inflow").alias("kept"))
        again = base.join(kept, "kind", "left").select(
            "kind", "host", (F.col("seed") * (1 - F.coalesce("kept", F.lit(0.0)))).alias("inflow")
        )
        fresh = inflow.select("kind", "host", "inflow").union(again)
        fresh = fresh.groupBy("kind", "host").agg(F.round(F.sum("inflow"), places).alias("rank"))
        if step % WRITE_EVERY and 1 < step < steps:
            ranks = fresh
            continue
        fresh = written(fresh, "ranks")
        change = fresh.select("kind", "host", "rank").union(ranks.select("kind", "host", -F.col("rank")))
        moved_by = change.groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0.0))).head()[0]
        ranks = fresh
        if moved_by < tolerance:
            break
    else:
        raise ArithmeticError(f"ranks still move by {moved_by} after {steps} steps")
    rank = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(rank("trust"), rank("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and belongs to no host
    of the graph. Without trust and distrust a page is allowed. Null html has no links. Repeated rows
    count each; other columns are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    judged = parsed.drop("html").withColumns({"rule": rule, "_verdict": verdict})
    count = lambda v: F.count(F.when(F.col("_verdict") == v, 1))
    seeds = judged.where("_verdict is not null").groupBy("host").agg(count("allow").alias("trusted"), count("block").alias("blocked"))
    hosts = propagate(host_links(parsed), seeds)
    bad = F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust"))
    hosts = hosts.withColumn("_host_verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_verdict", "_host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
