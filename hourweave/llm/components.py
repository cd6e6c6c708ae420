"""Distributed union-find: connected components of a graph given as edge rows.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every step hangs the neighbours of a node on the smallest
of them, until all nodes of a component hang on its smallest node. Steps are joins
and minimum aggregations; nothing is gathered per node, so a node with very many
neighbours is combined before the exchange and split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourweave.llm.scratch import written

#: Steps after which a graph of any practical size has settled; more is an error, not a cut.
MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v, least): ``edges`` with the smallest node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("least"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _stars(down)
    hung = stars.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = stars.select("u", F.col("least").alias("v"))
    return hung.union(own).distinct()


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of a non-loop edge; ``component`` is its smallest node.

    Rows with a null end and loops are ignored, repeated edges count once. Nodes may be of any type that orders.
    Each step is written to the shared folder, so lineage stays short and lost
    executors cost one step.
    """
    pairs = (
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current = written(pairs, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        # both stars in one step; the graph is stable when neither changes an edge
        current = written(_small_star(_large_star(current)), "edges")
        now = current.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))
        ).head()
        if now == before:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = now
    raise RuntimeError("components did not settle")
