"""Exact top-k search by inner product as a Voronoi kNN join.

Inner products become distances by one more coordinate: with M the greatest norm,
data points get sqrt(M^2 - |x|^2) and queries 0, so the squared distance is
|q|^2 + M^2 - 2 q.x and the nearest points have the greatest products. Data are assigned
to their nearest pivot; of each cell only a summary goes to the driver (its radius, its
smallest distances, its count). Query groups have pivots and radii of their own. The
triangle inequality bounds the k-th distance of all queries of a group, and a data point goes to a
group only if it can be that near. Groups and data are cut into blocks, and each
pair of blocks is solved in one task; the k best of all blocks are merged per query.

Vectors that many rows share are one point with the smallest ids, which are all that k results can need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave.session import written

#: Data pivots, and vectors of the sample they are chosen from; both bound what the driver holds.
PIVOTS, PIVOT_SAMPLE = 64, 1024
#: Queries aimed at in a group, and groups at most.
GROUP_QUERIES, MAX_GROUPS = 1024, 256
#: Rows of one block of queries and of one block of data.
QUERY_BLOCK, DATA_BLOCK = 4096, 50_000
_STEP = 8192


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a null or empty vector, or one with a component null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))
    return F.when(usable, F.transform(doubles, lambda x: F.floor(x * scale)))


def _matrix(codes) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<i8").reshape(len(codes), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; as doubles where these hold them exactly, else as Python numbers."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        lists = batch.column(1)
        codes = [np.asarray(x.values, "<i8").tobytes() for x in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["id", "code"])


def _fewest(ids: int):
    """Equal codes together, each with its smallest ids; per batch, or over a whole partition of (code, ids)."""

    def grouped(entries, held: dict[bytes, list[int]]) -> None:
        for code, more in entries:
            own = held.setdefault(code, [])
            own += more
            if len(own) > 4 * ids:
                own[:] = sorted(set(own))[:ids]

    def rows(held: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
        names = list(held)
        for a in range(0, len(names), 10_000):
            part = names[a : a + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([sorted(set(held[c]))[:ids] for c in part], pa.list_(pa.int64()))],
                ["code", "ids"],
            )

    def first(source):
        for batch in source:
            held: dict[bytes, list[int]] = {}
            grouped(((c, [i]) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), held)
            yield from rows(held)

    def then(source):
        held: dict[bytes, list[int]] = {}
        for batch in source:
            grouped(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), held)
        yield from rows(held)

    return first, then


class _Pivots:
    """Pivots in the extended space, where data have one more coordinate and queries a 0 there."""

    def __init__(self, points: np.ndarray, height: np.ndarray):
        self.points = np.column_stack([points.astype(np.float64), height])

    def distances(self, codes: np.ndarray, height: np.ndarray) -> np.ndarray:
        x = np.column_stack([codes.astype(np.float64), height])
        square = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * x @ self.points.T
        return np.sqrt(np.maximum(square, 0))


def _heights(codes: np.ndarray, top: float) -> np.ndarray:
    x = codes.astype(np.float64)
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0))


def _spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``points`` far from each other, by the farthest-first rule; deterministic."""
    points = points.astype(np.float64)
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` greatest integer inner products.

    ``vectors`` has (vec_id, embedding); rows where ``queries`` holds are queries, all rows are candidates except
    those with the query's own id. Ties go to the smaller id. Rows with a null id, or a vector that ``quantised``
    makes null, take no part; repeated rows count once. Vectors of different lengths are not compared: those of the most
    frequent length take part (the longer of equally frequent ones). Fewer candidates than k give fewer rows.
    Scores beyond 63 bits are given as the largest of these, with their sign. Other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("id"), quantised(F.col("embedding"), scale).alias("code"), queries.alias("asks"))
    usable = usable.where("id is not null and code is not null")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    length = usable.groupBy(F.size("code").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    if length is None:
        return empty
    usable = usable.where(F.size("code") == length["n"])
    first, then = _fewest(k + 1)
    coded = usable.select("id", "code").mapInArrow(_packed, "id bigint, code binary")
    data = written(
        coded.mapInArrow(first, "code binary, ids array<bigint>").repartition("code").mapInArrow(then, "code binary, ids array<bigint>"), "points"
    )
    asked = written(usable.where(F.coalesce("asks", F.lit(False))).select("id", "code").distinct().mapInArrow(_packed, "id bigint, code binary"), "queries")
    n_data, n_asked = data.count(), asked.count()
    if not n_asked:
        return empty

    def longest(source):
        best = max((float((_matrix(b.column(0).to_pylist()).astype(np.float64) ** 2).sum(1).max()) for b in source if b.num_rows), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([best])], ["top"])

    top = data.select("code").mapInArrow(longest, "top double").agg(F.max("top")).head()[0]
    sample = _matrix([bytes(r[0]) for r in data.select("code").orderBy(F.xxhash64("code"), "code").limit(PIVOT_SAMPLE).collect()])
    sample = sample[_spread_out(sample, PIVOTS)]
    pivots = _Pivots(sample, _heights(sample, top))

    def placed(source):
        for batch in source:
            if batch.num_rows:
                codes = _matrix(batch.column(0).to_pylist())
                far = pivots.distances(codes, _heights(codes, top))
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])],
                    ["code", "ids", "cell", "far"],
                )

    data = written(data.mapInArrow(placed, "code binary, ids array<bigint>, cell int, far double"), "placed")
    cells = _summaries(data, k + 1).collect()
    ask_sample = _matrix([bytes(r[0]) for r in asked.select("code").orderBy(F.xxhash64("code"), "id").limit(PIVOT_SAMPLE).collect()])
    ask_sample = ask_sample[_spread_out(ask_sample, min(MAX_GROUPS, -(-n_asked // GROUP_QUERIES)))]
    groups = _Pivots(ask_sample, np.zeros(len(ask_sample)))

    def grouped(source):
        for batch in source:
            if batch.num_rows:
                codes = _matrix(batch.column(1).to_pylist())
                far = groups.distances(codes, np.zeros(len(codes)))
                g = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(g, pa.int32()), pa.array(far[np.arange(len(g)), g])], ["id", "code", "grp", "far"]
                )

    asked = written(asked.mapInArrow(grouped, "id bigint, code binary, grp int, far double"), "grouped")
    sizes = {r["grp"]: (r["n"], r["radius"]) for r in asked.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    subs = {g: -(-n // QUERY_BLOCK) for g, (n, _) in sizes.items()}
    n_blocks = -(-n_data // DATA_BLOCK)
    between = groups.distances(sample, _heights(sample, top))  # (pivot, group)
    reach = {g: _reach(cells, between[:, g], radius, k + 1) for g, (_, radius) in sizes.items()}

    def replicated(source):
        """Each point to the groups that it can be near enough to, once for each of their blocks of queries."""
        for batch in source:
            cell, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
            block = (np.frombuffer(b"".join(c[:8] for c in batch.column(0).to_pylist()), "<u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(n_blocks)
            for g in sizes:
                low = np.abs(between[cell, g] - far) - sizes[g][1]
                near = np.flatnonzero(low <= reach[g])
                for sub in range(subs[g] if len(near) else 0):
                    part = batch.take(pa.array(near))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(near), g, np.int32)), pa.array(np.full(len(near), sub, np.int32)), pa.array(block[near].astype(np.int32)),
                         pa.array(np.ones(len(near), np.int32)), part.column(1), part.column(0)],
                        ["grp", "sub", "block", "role", "ids", "code"],
                    )

    unit = "grp int, sub int, block int, role int, ids array<bigint>, code binary"
    n_subs = F.create_map(*[F.lit(x) for g, n in subs.items() for x in (g, n)])
    own = asked.select(
        "grp", F.pmod(F.xxhash64("id"), F.element_at(n_subs, F.col("grp"))).cast("int").alias("sub"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(0).alias("role"), F.array("id").alias("ids"), "code",
    )
    solved = (
        own.union(data.mapInArrow(replicated, unit))
        .repartition("grp", "sub", "block")
        .sortWithinPartitions("grp", "sub", "block", "role")
        .mapInArrow(_solver(k), "query_id bigint, vec_id bigint, score bigint")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _summaries(data: DataFrame, n: int) -> DataFrame:
    """(cell, part, radius, least): of each cell and task its radius and the smallest distances; small whatever the input."""

    def summed(source):
        held: dict[int, tuple[float, np.ndarray]] = {}
        for batch in source:
            cell, far = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                own = far[cell == c]
                radius, least = held.get(c, (0.0, np.empty(0)))
                held[c] = max(radius, float(own.max())), np.sort(np.r_[least, own])[:n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([r for r, _ in held.values()], pa.float64()), pa.array([x.tolist() for _, x in held.values()], pa.list_(pa.float64()))],
            ["cell", "radius", "least"],
        )

    parts = data.select("cell", "far").mapInArrow(summed, "cell int, radius double, least array<double>")
    return parts.groupBy("cell").agg(
        F.max("radius").alias("radius"), F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, n).alias("least")
    )


def _reach(cells, between: np.ndarray, radius: float, n: int) -> float:
    """Within this distance every query of the group has ``n`` points, if there are so many."""
    bounds = sorted(radius + between[c["cell"]] + far for c in cells for far in c["least"])
    # a little more than the bound itself, for rounding
    return bounds[n - 1] * (1 + 1e-9) + 1e-6 if len(bounds) >= n else float("inf")


def _solver(k: int):
    """The k best of each query within its block, the data taken in steps."""

    def best(asked: list[tuple[int, bytes]], points: list[tuple[list[int], bytes]], held: dict[int, list]) -> None:
        scores = _products(_matrix([c for _, c in asked]), _matrix([c for _, c in points]))
        n = min(k + 1, len(points))
        # all points that score at least as much as the n-th: ties are decided by id below
        least = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
        for row, (query, _) in enumerate(asked):
            own = held[query]
            for j in np.flatnonzero(scores[row] >= least[row]).tolist():
                own += [(-int(scores[row, j]), i) for i in points[j][0] if i != query]
            own.sort()
            del own[k:]

    def solved(source):
        unit, asked, points, held = None, [], [], {}
        out = []
        for batch in source:
            for *now, role, ids, code in zip(*[c.to_pylist() for c in batch.columns]):
                if now != unit:
                    if asked and points:
                        best(asked, points, held)
                    out += held.items()
                    unit, asked, points, held = now, [], [], {}
                if role == 0:
                    asked.append((ids[0], code))
                    held[ids[0]] = []
                elif asked:
                    points.append((ids, code))
                    if len(points) == _STEP:
                        best(asked, points, held)
                        points = []
            yield rows(out)
            out = []
        if asked and points:
            best(asked, points, held)
        yield rows(list(held.items()))

    def rows(found):
        flat = [(q, i, -s) for q, own in found for s, i in own]
        return pa.RecordBatch.from_arrays([pa.array([r[x] for r in flat], pa.int64()) for x in range(3)], ["query_id", "vec_id", "score"])

    return solved
