"""N-gram Jaccard join by prefix trees.

A document is the set of its word shingles, as hashes in one global order: by the
count of the shingle's slot in a fixed-size counter array over all documents, then by
hash, so shingles of widely shared passages come last. Documents with similarity of at least
t share one of the first |x| - ceil(t |x|) + 1 shingles.

1. Equal sets are one class from the start. The first shingles go to buckets, packed per batch.
   A bucket's task groups equal shingles and names the smallest class of each group its hub;
   (hub, member) rows, again packed, are made distinct. Any two documents that share a first shingle
   are members of one hub, so no pair of documents is ever written down for comparison.
2. Members of a hub are cut into blocks of bounded size, each with the hub itself. A task
   builds a prefix tree per block and finds exact links; a pair already connected is skipped.
3. Components are formed in Spark. Where a hub had several blocks, members outside its
   largest component are compared with its other blocks, which completes the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourweave.llm.components import connected
from hourweave.llm.overlaps import linked
from hourweave.llm.scratch import settled, written
from hourweave.llm.substrings import RollingHasher, _held, _planes, _unplaned

SHINGLE = 5
#: Similar means 4 * shared >= 3 * all shingles of two documents, a Jaccard similarity of 0.75.
SIMILARITY = (3, 4)
#: Slots of the counter array, 8 bytes each. Its size does not depend on the data.
SLOTS = 1 << 22
_SLICES = 64
#: Shingles (with repeats) in one block of a hub; a longer document is a block of its own.
BLOCK_SHINGLES = 1_000_000
BATCH_WORDS = 2_000_000


class _Shingler:
    def __init__(self, n: int):
        self.n = n
        self._hasher = RollingHasher(n)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text; all its words as one if they are fewer."""
        docs = [t.encode().lower().split() for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        codes = self._hasher.codes([w for d in docs for w in d])
        windows = np.maximum(sizes - (self.n - 1), 0)
        offsets = np.cumsum(sizes) - sizes
        starts = np.arange(windows.sum()) + np.repeat(offsets - (np.cumsum(windows) - windows), windows)
        found = np.split(self._hasher.hashes(codes, starts, 0), np.cumsum(windows)[:-1]) if docs else []
        return [
            np.unique(h) if len(h) else np.array([xxhash.xxh3_64_intdigest(b" ".join(d))] if d else [], np.uint64)
            for h, d in zip(found, docs)
        ]


def _batched(source: Iterator[pa.RecordBatch], shingler: _Shingler) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(rows of the first column, sets of the second column's texts), in batches of bounded size."""
    for batch in source:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        first = size = 0
        held: list[str] = []
        for i, text in enumerate(texts):
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size > 5 * BATCH_WORDS or i + 1 == len(keys):
                yield keys[first : i + 1], shingler.sets(held)
                first, size, held = i + 1, 0, []


def _signature(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def classes(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(key, doc_id, n_shingles, class): equal shingle sets have an equal class; no shingles, null."""

    out = _keyed(docs).select("key", "text", "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def with_ids(source):
        shingler = _Shingler(n)
        for batch in source:
            done = [(s, k) for keys, sets in _batched([batch], shingler) for s, k in zip(sets, keys)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s, _ in done], pa.int64()),
                    pa.array([_signature(s) if len(s) else None for s, _ in done], pa.int64()),
                ],
                ["key", "doc_id", "n_shingles", "class"],
            )

    return out.mapInArrow(with_ids, f"key bigint, doc_id {kind}, n_shingles bigint, class bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def slot_counts(docs: DataFrame, n: int = SHINGLE) -> np.ndarray:
    """How many shingles of all documents fall into each slot. What reaches the driver is SLOTS numbers."""
    width = SLOTS // _SLICES

    def count(source):
        shingler = _Shingler(n)
        total = np.zeros(SLOTS, np.int64)
        for _, sets in _batched(source, shingler):
            total += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS)
        yield from _slices({i: total[i * width : (i + 1) * width] for i in range(_SLICES)})

    def add(source):
        totals: dict[int, np.ndarray] = {}
        for batch in source:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[i] = totals.get(i, 0) + _unplaned(c, "<i8")
        yield from _slices(totals)

    parts = docs.select(F.lit(0).alias("key"), "text").mapInArrow(count, "slice int, counts binary")
    rows = parts.repartition("slice").mapInArrow(add, "slice int, counts binary").collect()
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] = _unplaned(bytes(r["counts"]), "<i8")
    return out


def _slices(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([_planes(c, "<i8") for c in parts.values()], pa.binary())],
            ["slice", "counts"],
        )


_PACKED = "bucket int, hashes binary, classes binary, sizes binary, counts binary"


def _first_shingles(counts, n: int, buckets: int, similarity: tuple[int, int]):
    """The first shingles of each text in the global order, packed by bucket."""
    a, b = similarity

    def batches(source):
        shingler = _Shingler(n)
        order_of = counts.value
        for _, sets in _batched(source, shingler):
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            first = []
            for s in sets:
                wanted = len(s) - -(-a * len(s) // b) + 1
                first.append(s[np.lexsort((s, order_of[_slot(s)]))[:wanted]])
            h = np.concatenate(first)
            doc = np.repeat(np.arange(len(sets)), [len(f) for f in first])
            names = np.array([_signature(s) for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, h, doc = bucket[order], h[order], doc[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            rows = []
            for x, y in zip(edges[:-1], edges[1:]):
                starts = np.flatnonzero(np.diff(doc[x:y], prepend=-1))
                own = doc[x:y][starts]
                low = np.ascontiguousarray(h[x:y].view(np.uint8).reshape(-1, 8)[:, :6])
                rows.append((
                    int(bucket[x]), low.tobytes(), names[own].tobytes(), _planes(sizes[own], "<u4"),
                    _planes(np.diff(starts, append=y - x), "<u4"),
                ))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                ["bucket", "hashes", "classes", "sizes", "counts"],
            )

    return batches


def _distinct(hub: np.ndarray, member: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((member, hub))
    hub, member, size = hub[order], member[order], size[order]
    fresh = np.ones(len(hub), bool)
    fresh[1:] = (hub[1:] != hub[:-1]) | (member[1:] != member[:-1])
    return hub[fresh], member[fresh], size[fresh]


_HUBS = "target int, hubs binary, members binary, sizes binary"


def _hubs(similarity: tuple[int, int], targets: int):
    """Of each bucket the distinct (hub, member, size) of classes that share a first shingle, packed by target."""
    a, b = similarity

    def read(h: bytes, names: bytes, sizes: bytes, counts: bytes) -> tuple[np.ndarray, ...]:
        wide = np.zeros((len(h) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
        counts = _unplaned(counts, "<u4").astype(np.int64)
        sizes = _unplaned(sizes, "<u4").astype(np.int64)
        return wide.reshape(-1).view("<u8"), np.repeat(np.frombuffer(names, np.int64), counts), np.repeat(sizes, counts)

    def shared(h: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((names, sizes, h))
        h, names, sizes = h[order], names[order], sizes[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (names[1:] != names[:-1])
        h, names, sizes = h[fresh], names[fresh], sizes[fresh]
        # a group ends where the shingle changes, or where sizes step too far for any pair across
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (b * sizes[:-1] < a * sizes[1:])])
        length = np.diff(starts, append=len(h))
        hub = np.repeat(np.minimum.reduceat(names, starts), length)
        found = np.repeat(length > 1, length)
        return _distinct(hub[found], names[found], sizes[found])

    def batches(source):
        for held in _held(source, read):
            hub, member, size = shared(*held)
            target = ((_spread(hub, member) >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            hub, member, size, target = hub[order], member[order], size[order], target[order]
            edges = np.flatnonzero(np.diff(target, prepend=-1, append=-1)) if len(hub) else np.zeros(1, np.int64)
            rows = [
                (int(target[x]), hub[x:y].tobytes(), member[x:y].tobytes(), _planes(size[x:y], "<u4"))
                for x, y in zip(edges[:-1], edges[1:])
            ]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                ["target", "hubs", "members", "sizes"],
            )

    return batches


def _spread(hub: np.ndarray, member: np.ndarray) -> np.ndarray:
    # by pair: the rows of one hub, which may be a third of all, go to many tasks
    mixed = (hub.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ member.view(np.uint64)
    return mixed * np.uint64(0xC2B2AE3D27D4EB4F)


def _unpacked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (hub, member, size) of a target."""

    def read(hubs: bytes, members: bytes, sizes: bytes) -> tuple[np.ndarray, ...]:
        return np.frombuffer(hubs, np.int64), np.frombuffer(members, np.int64), _unplaned(sizes, "<u4").astype(np.int64)

    for held in _held(source, read):
        columns = _distinct(*held)
        for x in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[x : x + 50_000]) for v in columns], ["hub", "member", "size"])


def _links(n: int, similarity: tuple[int, int]):
    """Links inside each block; rows come sorted by (hub, block, part), probes last."""

    def of_block(names: list[int], texts: list[str], probes: int, shingler: _Shingler) -> list[tuple[int, int]]:
        sets = [s for x in range(0, len(texts), 500) for s in shingler.sets(texts[x : x + 500])]
        return [(names[x], names[y]) for x, y in linked(sets, probes, similarity)] if len(sets) > 1 else []

    def batches(source):
        shingler = _Shingler(n)
        block, seen, texts, probes = None, {}, [], 0
        out: list[tuple[int, int]] = []
        for batch in source:
            for *now, member, probe, text in zip(*[c.to_pylist() for c in batch.columns]):
                if now != block:
                    out += of_block(list(seen), texts, probes, shingler)
                    block, seen, texts, probes = now, {}, [], 0
                if member not in seen:
                    seen[member] = True
                    texts.append(text)
                    probes += probe
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        out += of_block(list(seen), texts, probes, shingler)
        yield _pairs(out)

    def _pairs(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"]
        )

    return batches


def _compared(members: DataFrame, texts: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) links of ``members`` (hub, block, part, member, probe), given (class, text)."""
    return (
        members.join(texts, members["member"] == texts["class"])
        .select("hub", "block", "part", "member", "probe", "text")
        .repartition("hub", "block", "part")
        .sortWithinPartitions("hub", "block", "part", "probe", "member")
        .mapInArrow(_links(n, similarity), "a bigint, b bigint")
    )


def _components(docs: DataFrame, members: DataFrame, counts, n: int, similarity, block_shingles: int, buckets: int) -> DataFrame:
    """(node, component) of the classes that are similar to another one."""
    packed = docs.select(F.lit(0).alias("key"), "text").mapInArrow(_first_shingles(counts, n, buckets, similarity), _PACKED)
    hubs = (
        packed.repartitionById(buckets, "bucket")
        .mapInArrow(_hubs(similarity, buckets), _HUBS)
        .repartitionById(buckets, "target")
        .mapInArrow(_unpacked, "hub bigint, member bigint, size bigint")
    )
    hubs = written(hubs, "hubs")
    n_blocks = F.ceil(F.sum("size") / block_shingles).cast("int")
    large = hubs.groupBy("hub").agg(n_blocks.alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("member"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = hubs.join(large, "hub", "left").select(
        "hub", "member", F.coalesce("blocks", F.lit(1)).alias("blocks"), own.alias("block")
    )
    dealt = placed.select(
        "hub",
        F.explode(F.when(F.col("member") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("block"),
        F.lit(0).alias("part"),
        "member",
        F.lit(0).alias("probe"),
    )
    # of each class that is compared, the text of one document
    chosen = members.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("key").alias("key"))
    wanted = chosen.join(hubs.select(F.col("member").alias("class")).distinct(), "class")
    texts = written(_keyed(docs).join(wanted, "key").select("class", "text"), "texts")
    links = written(_compared(dealt, texts, n, similarity), "links")
    found = written(connected(links, "a", "b"), "components")

    apart = _apart(placed.where("blocks > 1"), found)
    if apart is not None:
        more = _compared(apart, texts, n, similarity)
        found = written(connected(links.union(written(more, "links")), "a", "b"), "components")
    return found


def similarity_classes(
    docs: DataFrame,
    n: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
    block_shingles: int = BLOCK_SHINGLES,
    buckets: int | None = None,
) -> DataFrame:
    """(key, doc_id, n_shingles, component, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id that similar pairs lead to, a document itself
    included. Equal texts, and equal rows, are similar. Null texts and texts without words
    have no shingles, are similar to nothing and keep their own id. ``key`` is a hash of id and text, by
    which rows with the same id are told apart. Other columns are ignored.
    Shingles and sets are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.sparkContext.broadcast(slot_counts(docs, n))
    members = written(classes(docs, n), "classes")
    found = settled("components", lambda: _components(docs, members, counts, n, similarity, block_shingles, buckets))
    named = members.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    smallest = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "component", "left").select(
        "key", "doc_id", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _apart(placed: DataFrame, found: DataFrame, part_rows: int = 500) -> DataFrame | None:
    """Members outside the largest component of their hub, against its other blocks; None if there are none."""
    named = placed.join(found.withColumnRenamed("node", "member"), "member", "left").withColumn(
        "component", F.coalesce("component", "member")
    )
    sizes = named.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    named = written(named.join(largest, "hub"), "apart")
    rest = named.where("component != largest")
    if rest.isEmpty():
        return None
    parts = rest.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("member", F.lit(1)), F.col("parts")).cast("int").alias("part")
    probes = rest.join(parts, "hub").select(
        "hub", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))).alias("block"), part, "member", F.lit(1).alias("probe")
    )
    base = named.join(parts, "hub").select(
        "hub", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "member", F.lit(0).alias("probe")
    )
    return base.union(probes)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of similar documents: the one with the
    smallest id, null last.

    Of rows that agree in id and text one stays; rows without words all stay.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    found = similarity_classes(docs).where("n_shingles > 0")
    first = found.groupBy("component").agg(F.min_by("key", order).alias("_key")).select("_key")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("_key"))
    has_words = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = rows.where(has_words).join(first, "_key", "left_semi").dropDuplicates(["_key"])
    return chosen.select("row").union(rows.where(~has_words).select("row")).select("row.*")
