"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1. Each Arrow batch of texts becomes arrays of rolling window hashes (no loop over
   windows). A second, independent rolling hash names the bucket, and each bucket gets one
   packed row per batch: window hashes, and which document and place they come from.
2. The rows are dealt by bucket; a task holds one bucket, sorts its hashes and hands back
   the places whose hash occurs more than once. A bucket's expected size is the number of
   windows over the number of buckets; one window that is repeated without end adds only
   its own entries to a single bucket.
3. The places go, again packed, to the tasks of their documents, merge there into maximal
   removal intervals, and the intervals are joined to the documents by key.

56 bits of a window's hash travel; with the bucket's bits two different windows agree
with probability 2^-(56 + log2(buckets)), so the width grows with the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 35
#: Words handled at once in one task; a longer document is handled alone.
BATCH_WORDS = 2_000_000
CACHED_WORDS = 400_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordCodes(dict):
    """64-bit codes of words as bytes."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


class RollingHasher:
    """Polynomial hashes modulo 2^64 of all windows of a sequence, by prefix sums."""

    def __init__(self, window: int):
        self.window = window
        self._codes = _WordCodes()
        self._powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * len(_BASES)

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self._codes) > CACHED_WORDS:
            self._codes.clear()
        return np.fromiter(map(self._codes.__getitem__, words), np.uint64, len(words))

    def _power(self, which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self._powers[which]
        if len(up) < size:
            base = _BASES[which]
            up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            for powers in (up, down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
            self._powers[which] = up, down
        return up, down

    def hashes(self, codes: np.ndarray, starts: np.ndarray, which: int) -> np.ndarray:
        up, down = self._power(which, len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        h = (sums[starts + self.window] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as byte planes: the high bytes of small numbers then compress to nothing."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


_PACKED = "bucket int, hashes binary, keys binary, counts binary, places binary"


def _windows(window: int, buckets: int):
    """Packs the windows of (key, text) batches by bucket."""

    def pack(hasher: RollingHasher, keys: list[int], docs: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(w) for w in docs], np.int64)
        codes = hasher.codes([w for d in docs for w in d])
        n = np.maximum(sizes - (window - 1), 0)
        doc = np.repeat(np.arange(len(docs)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = place + np.repeat(np.cumsum(sizes) - sizes, n)
        h = hasher.hashes(codes, starts, 0)
        bucket = ((hasher.hashes(codes, starts, 1) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, h, doc, place = bucket[order], h[order], doc[order], place[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
        rows = []
        own_keys = np.array(keys, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            counts = np.diff(first, append=b - a)
            steps = np.diff(place[a:b], prepend=0)
            steps[first] = place[a:b][first]
            rows.append((
                int(bucket[a]),
                np.ascontiguousarray(h[a:b].view(np.uint8).reshape(-1, 8)[:, :7]).tobytes(),
                own_keys[doc[a:b][first]].tobytes(),
                _planes(counts, "<u4"),
                _planes(steps, "<u4"),
            ))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
            ["bucket", "hashes", "keys", "counts", "places"],
        )

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHasher(window)
        keys: list[int] = []
        docs: list[list[bytes]] = []
        size = 0
        for batch in source:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().encode().split()
                if len(words) < window:
                    continue
                if size and size + len(words) > BATCH_WORDS:
                    yield pack(hasher, keys, docs)
                    keys, docs, size = [], [], 0
                keys.append(key)
                docs.append(words)
                size += len(words)
        if docs:
            yield pack(hasher, keys, docs)

    return batches


_MARKED = "target int, keys binary, counts binary, places binary"


def _held(source: Iterator[pa.RecordBatch], read) -> Iterator[tuple[np.ndarray, ...]]:
    """The packed rows of a partition, put together for each value of the first column."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in source:
        for name, *data in zip(*[column.to_pylist() for column in batch.columns]):
            held.setdefault(name, []).append(read(*data))
    for name in list(held):
        yield tuple(np.concatenate(x) for x in zip(*held.pop(name)))


def _with_steps(keys: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, ...]:
    """Per entry the document key and the place, from steps that start anew in every document."""
    counts, steps = _unplaned(counts, "<u4").astype(np.int64), _unplaned(steps, "<u4").astype(np.int64)
    sums, first = np.cumsum(steps), np.cumsum(counts) - counts
    return np.repeat(np.frombuffer(keys, np.int64), counts), sums - np.repeat(sums[first] - steps[first], counts)


def _repeated(targets: int):
    """Of each bucket the places whose window hash occurs more than once, packed by target."""

    def read(hashes: bytes, *packed: bytes) -> tuple[np.ndarray, ...]:
        wide = np.zeros((len(hashes) // 7, 8), np.uint8)
        wide[:, :7] = np.frombuffer(hashes, np.uint8).reshape(-1, 7)
        return wide.reshape(-1).view("<u8"), *_with_steps(*packed)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, key, place in _held(source, read):
            order = np.argsort(h)
            same = np.diff(h[order]) == 0
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            key, place = key[twice], place[twice]
            target = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((place, key, target))
            key, place, target = key[order], place[order], target[order]
            edges = np.flatnonzero(np.diff(target, prepend=-1, append=-1)) if len(key) else np.zeros(1, np.int64)
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                own, at = key[a:b], place[a:b]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                steps = np.diff(at, prepend=0)
                steps[first] = at[first]
                counts = np.diff(first, append=b - a)
                rows.append((int(target[a]), own[first].tobytes(), _planes(counts, "<u4"), _planes(steps, "<u4")))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                ["target", "keys", "counts", "places"],
            )

    return batches


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _merged(window: int):
    """Places of each document to maximal removal intervals, one row per document."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, place in _held(source, _with_steps):
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            new = np.r_[True, key[1:] != key[:-1]]
            begins = np.flatnonzero(new | np.r_[True, place[1:] > place[:-1] + window])
            ends = np.r_[place[begins[1:] - 1], place[-1:]] + window
            spans = pa.StructArray.from_arrays(
                [pa.array(place[begins].astype(np.int32)), pa.array(ends.astype(np.int32))], ["first", "end"]
            )
            first = np.flatnonzero(new[begins])
            for a in range(0, len(first), 20_000):
                part = np.append(first[a : a + 20_000], first[a + 20_000] if a + 20_000 < len(first) else len(begins))
                lists = pa.ListArray.from_arrays(
                    pa.array((part - part[0]).astype(np.int32)), spans.slice(part[0], part[-1] - part[0])
                )
                yield pa.RecordBatch.from_arrays([pa.array(key[begins[part[:-1]]]), lists], ["key", "removed"])

    return batches


def _cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., text, removed) to the number of words and the text that is left."""
    for batch in source:
        n_words, kept = [], []
        removed = [r or [] for r in batch.column("removed").to_pylist()]
        for text, spans in zip(batch.column("text"), removed):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            for span in reversed(spans):
                del words[span["first"] : span["end"]]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "removed", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, removed, kept) for every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else
    in the input, the same document included. ``removed`` lists the maximal intervals of
    word numbers, end exclusive; ``kept`` is what is left, joined by one space. Windows are
    judged on the input. Texts shorter than the window keep all words; null and empty
    texts have none. Rows are told apart by id and text: exact repeats of a row are copies
    of each other and lose all windows, as any two equal texts do. Other columns are ignored.

    ``buckets`` (the session's shuffle partitions unless given) bounds a task's share.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    packed = keyed.where(F.col("text").isNotNull()).select("key", "text").mapInArrow(_windows(window, buckets), _PACKED)
    marks = (
        packed.repartitionById(buckets, "bucket")
        .mapInArrow(_repeated(buckets), _MARKED)
        .repartitionById(buckets, "target")
        .mapInArrow(_merged(window), "key bigint, removed array<struct<first:int,end:int>>")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        keyed.join(marks, "key", "left")
        .select("doc_id", "text", "removed")
        .mapInArrow(
            _cut,
            f"doc_id {kind}, n_words bigint, removed array<struct<first:int,end:int>>, kept string",
        )
    )
