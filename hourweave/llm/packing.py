"""Packing documents into training sequences with a controlled mixture of sources.

Every source is a queue of token ids. Deficit round-robin serves the queues: a round gives each
queue its quantum (its share of one window), the queue hands over the whole ids its deficit
counter covers, and the fraction stays in the counter for later rounds. The ids served, one round
after the other, are cut into windows, so that every window holds the sources in their target proportions
up to a few ids. A queue that runs dry leaves its share to the others.

After r rounds a queue's counter has received v(r) times its weight, where v is a line with one
bend per source that runs dry, so what a queue has been served, its deficit and the place of every round follow
from r alone. A task that holds any stretch of a queue continues there with the deficits that all
earlier windows, in whatever partition, leave behind; nothing is passed from task to task.

1. Texts are encoded in Arrow batches; ids are written together with each row's place in its batch.
2. Running sums over batches, partitions and blocks of partitions give every batch its place in each queue. These are
   sums of small tables, joined to the ids by batch.
3. Each stretch of a queue is cut where rounds, windows and documents change.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourweave.session import written

WINDOW = 2048
END_ID = 1
#: Sources with queues of their own, the ones with most documents; all others share one more queue. Bounds what each task is sent.
MAX_QUEUES = 256
#: Ids in a written batch, and words whose ids a worker remembers.
BATCH_IDS, CACHED_WORDS, CACHED_LENGTH = 1_000_000, 300_000, 64
_GOLDEN = 0.6180339887498949
_PARTS = 1 << 32


def _byte_signs() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}


_BYTE_SIGNS = _byte_signs()


class WordIds(dict):
    """Ids of the words of a text, as little-endian bytes.

    The tokenizer splits at white space and drops it, so a text's ids are those of its words, one after the
    other. Words of characters below U+0250, which no normalisation changes but lower-casing, are lower-cased and cut
    here by the tokenizer's own pattern, and its merges are applied to each piece; other words, and those that may hold
    special tokens, go through the whole library. Two generations of words and pieces are remembered; the older one is
    dropped when the newer is full.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_str(model)
        self._merges = self._tokenizer.model
        parts = json.loads(model)["pre_tokenizer"]["pretokenizers"]
        self._cut = regex.compile(parts[0]["pattern"]["Regex"]).findall
        self._older: dict[bytes, bytes] = {}

    def _merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self._merges.tokenize(piece)]).tobytes()

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        lower = text.lower()
        plain = word.isascii()
        if plain and text.isalpha():
            return self._merged(text) if lower == text else self[lower.encode()]
        if "<|" in text or not plain and max(max(text), max(lower)) >= "\u0250":
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = self._cut(lower)
        if len(pieces) == 1 and pieces[0] == text:
            return self._merged(word.decode("latin-1").translate(_BYTE_SIGNS))
        return b"".join([self[piece.encode()] for piece in pieces])

    def __missing__(self, word: bytes) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self._older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))


_codecs: dict[str, WordIds] = {}


def _codec(model: str) -> WordIds:
    """The word ids of a model, kept in each Python process."""
    name = hashlib.sha256(model.encode()).hexdigest()
    if name not in _codecs:
        _codecs[name] = WordIds(model)
    return _codecs[name]


def _encoded(model: str, end_id: int):
    """(doc_id, queue, text) to (doc_id, queue, chunk, before, n, ids): a chunk is one batch of output, ``before``
    the ids of the same queue earlier in it."""
    end = np.array([end_id], "<u4").tobytes()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(model)
        chunks = itertools.count(TaskContext.get().partitionId() * _PARTS)
        for batch in source:
            queues = batch.column(1).to_pylist()
            first, size, done, before, served = 0, 0, [], [], {}
            for i, text in enumerate(batch.column(2)):
                ids = own.encode(text.as_py() or "") + end
                before.append(served.get(queues[i], 0))
                served[queues[i]] = before[-1] + len(ids) // 4
                done.append(ids)
                size += len(ids) // 4
                if size >= BATCH_IDS or i + 1 == batch.num_rows:
                    n = len(done)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                            pa.array(np.full(n, next(chunks)), pa.int64()), pa.array(before, pa.int64()),
                            pa.array([len(x) // 4 for x in done], pa.int64()), pa.array(done, pa.binary()),
                        ],
                        ["doc_id", "queue", "chunk", "before", "n", "ids"],
                    )
                    first, size, done, before, served = i + 1, 0, [], [], {}

    return batches


class Rounds:
    """What deficit round-robin has served after any number of rounds."""

    def __init__(self, sizes, weights, window: int = WINDOW):
        self.sizes = np.asarray(sizes, np.int64)
        self.weights = np.where(self.sizes > 0, np.asarray(weights, float), 0.0)
        if (self.weights[self.sizes > 0] <= 0).any():
            raise ValueError("a source with ids needs a positive weight")
        self.window, self.total = window, int(self.sizes.sum())
        # deficits start at different fractions, so that small queues are not all served in the same round
        self.first = np.mod((np.arange(len(self.sizes)) + 1) * _GOLDEN, 1.0)
        used = self.weights > 0
        dry = np.where(used, self.sizes / np.where(used, self.weights, 1.0), 0.0)
        self._time = np.r_[0.0, np.unique(dry[used])]
        active = np.array([self.weights[dry >= t].sum() for t in self._time[1:]])
        self._speed = window / active  # time a round takes before each bend
        self._round = np.r_[0.0, np.cumsum(np.diff(self._time) / self._speed)]
        self.rounds = int(np.ceil(self._round[-1])) + 1
        full = self.total // window
        rest = self.total - full * window
        powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        #: Where the sequences of the last, partial window start: powers of two need no padding.
        self.tail = full * window + np.cumsum([0, *powers], dtype=np.int64)
        self.full = full

    def _when(self, r: np.ndarray) -> np.ndarray:
        if len(self._time) == 1:
            return np.zeros(len(r))
        k = np.clip(np.searchsorted(self._round, r, "right") - 1, 0, len(self._speed) - 1)
        return np.minimum(self._time[k] + (r - self._round[k]) * self._speed[k], self._time[k + 1])

    def served(self, r: np.ndarray, queues=slice(None)) -> np.ndarray:
        """(rounds, queues): ids handed over in the first ``r`` rounds. The deficit left is the fraction cut off here."""
        r = np.asarray(r, np.int64)
        counters = np.floor(self._when(r)[:, None] * self.weights[queues] + self.first[queues])
        out = np.minimum(counters, self.sizes[queues]).astype(np.int64)
        out[r >= self.rounds] = self.sizes[queues]
        return out

    def serving(self, queue: int, low: int, high: int) -> np.ndarray:
        """The rounds that serve ids ``low`` to ``high`` (exclusive) of a queue."""
        one = slice(queue, queue + 1)

        def about(ids: np.ndarray) -> np.ndarray:
            time = np.maximum(ids - self.first[queue], 0.0) / self.weights[queue]
            k = np.clip(np.searchsorted(self._time, time, "right") - 1, 0, len(self._speed) - 1)
            r = np.floor(self._round[k] + (time - self._time[k]) / self._speed[k]).astype(np.int64)
            return np.clip(r, 0, self.rounds)

        a, b = about(np.array([low, high], float))
        if b - a <= 2 * (high - low) + 16:
            r = np.arange(max(a - 3, 0), min(b + 3, self.rounds) + 1)
            s = self.served(r, one)[:, 0]
            return r[:-1][(s[1:] > s[:-1]) & (s[1:] > low) & (s[:-1] < high)]
        ids = np.arange(low, high)
        r = np.maximum(about(ids + 1.0) - 3, 0)
        for _ in range(7):  # the guess is off by rounding only
            r += self.served(r + 1, one)[:, 0] <= ids
        return np.unique(r)

    def stretches(self, queue: int, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each round: the queue's first id in it, and that id's place among all ids."""
        starts, places = [], []
        step = max(1, 1_000_000 // len(self.sizes))
        for a in range(0, len(rounds), step):
            r = rounds[a : a + step]
            done, then = self.served(r), self.served(r + 1)
            starts.append(done[:, queue])
            places.append(done.sum(1) + (then - done)[:, :queue].sum(1))
        return np.concatenate(starts), np.concatenate(places)

    def sequence(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of places among all ids."""
        late = np.maximum(np.searchsorted(self.tail, place, "right") - 1, 0)
        in_tail = place >= self.full * self.window
        return (
            np.where(in_tail, self.full + late, place // self.window),
            np.where(in_tail, place - self.tail[late], place % self.window),
        )

    def pieces(self, queue: int, low: int, lengths: np.ndarray) -> list[np.ndarray]:
        """(document, start, length, sequence, offset) of documents that follow each other from id ``low`` of a queue."""
        ends = low + np.cumsum(lengths)
        high = int(ends[-1])
        begin, place = self.stretches(queue, self.serving(queue, low, high))
        size = np.diff(begin, append=max(high, int(begin[-1]) + 1))
        # places where a window or a sequence of the last window begins inside a stretch
        first = place // self.window + 1
        n = np.maximum((place + size - 1) // self.window - first + 1, 0)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inside = np.repeat(begin, n) + (np.repeat(first, n) + nth) * self.window - np.repeat(place, n)
        at = np.searchsorted(place, self.tail, "right") - 1
        late = (begin[at] + self.tail - place[at])[(at >= 0) & (self.tail < place[at] + size[at])]
        cuts = np.unique(np.concatenate([[low], begin, inside, late, ends]))
        cuts = cuts[(cuts >= low) & (cuts <= high)]
        start, length = cuts[:-1], np.diff(cuts)
        stretch = np.searchsorted(begin, start, "right") - 1
        doc = np.searchsorted(ends, start, "right")
        where = place[stretch] + start - begin[stretch]
        sequence, offset = self.sequence(where)
        # what follows without a gap in the same sequence is one piece
        new = np.r_[True, (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (where[1:] != where[:-1] + length[:-1])]
        heads = np.flatnonzero(new)
        length = np.add.reduceat(length, heads)
        doc, start = doc[heads], start[heads]
        return [doc, start - (ends - lengths)[doc], length, sequence[heads], offset[heads]]


def _cut(rounds: Rounds, kind: pa.DataType):
    """(doc_id, queue, start, n, ids) to pieces."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            queue, start, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            order = np.lexsort((start, queue))
            new = np.r_[True, (queue[order][1:] != queue[order][:-1]) | (start[order][1:] != (start + n)[order][:-1])]
            for run in np.split(order, np.flatnonzero(new)[1:]):
                doc, first, length, sequence, offset = rounds.pieces(int(queue[run[0]]), int(start[run[0]]), n[run])
                row = run[doc]
                texts = [batch.column(4)[int(i)].as_py() for i in run]
                ids = [texts[d][4 * a : 4 * (a + m)] for d, a, m in zip(doc.tolist(), first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)).cast(kind), pa.array(first), pa.array(length), pa.array(ids, pa.binary()),
                        pa.array(n[row]), pa.array(sequence), pa.array(offset),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return batches


def _earlier(value: str, keys: list[str], order: str) -> F.Column:
    """The sum of ``value`` over the rows before this one."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _chunk_starts(ids: DataFrame) -> DataFrame:
    """(queue, chunk, from): the place in its queue where each chunk's ids begin."""
    part, block = F.shiftright("chunk", 32), F.shiftright("chunk", 42)
    sums = ids.groupBy("queue", "chunk").agg(F.sum("n").alias("m")).withColumns({"part": part, "block": block})
    parts = sums.groupBy("queue", "block", "part").agg(F.sum("m").alias("m"))
    blocks = parts.groupBy("queue", "block").agg(F.sum("m").alias("m"))
    blocks = blocks.select("queue", "block", _earlier("m", ["queue"], "block").alias("b"))
    parts = parts.select("queue", "block", "part", _earlier("m", ["queue", "block"], "part").alias("p"))
    chunks = sums.select("queue", "block", "part", "chunk", _earlier("m", ["queue", "part"], "chunk").alias("c"))
    placed = chunks.join(parts, ["queue", "block", "part"]).join(blocks, ["queue", "block"])
    return placed.select("queue", "chunk", (F.col("b") + F.col("p") + F.col("c")).alias("from"))


def pack(
    docs: DataFrame, model: str, window: int = WINDOW, end_id: int = END_ID, weights: dict | None = None, max_queues: int = MAX_QUEUES
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every row of ``docs``.

    ``model`` is the text of a tokenizer file whose words never reach across white space; a document's ids
    are its text's and then ``end_id``. Sequences hold ``window`` ids each; the ids that do not fill the last
    one are cut into sequences of powers of two. ``ids`` are little-endian unsigned 32-bit numbers, ``start`` the ids of the
    document before the piece, ``offset`` those of the sequence. Pieces of a document are in order, and a sequence has no gaps.

    ``weights`` maps sources to their share of a window (any scale). Without it, and for sources it does not
    name, the share is the source's share of all ids, so that all queues run dry together.

    A null text counts as empty and gives its end id alone; null ids and sources are values like
    others (all rows without source are one queue). Repeated rows are packed each on their own, a very long
    text in as many pieces as it needs, and an empty table gives no rows. Within a queue, documents follow the order in
    which the table is read. Other columns are ignored.
    """
    spark = docs.sparkSession
    most = docs.groupBy("source").count().orderBy(F.desc("count"), F.col("source").asc_nulls_last()).limit(max_queues).collect()
    names = sorted((r["source"] for r in most), key=lambda s: (s is None, s or ""))
    known = [s for s in names if s is not None]
    place = {s: i for i, s in enumerate(names)}
    others = F.lit(len(names))
    if known:
        listed = F.create_map(*[x for s in known for x in (F.lit(s), F.lit(place[s]))])
        named = F.coalesce(F.try_element_at(listed, F.col("source")), others)
    else:
        named = others
    queue = F.when(F.col("source").isNull(), F.lit(place.get(None, len(names)))).otherwise(named)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = written(
        docs.select("doc_id", queue.cast("int").alias("queue"), "text").mapInArrow(
            _encoded(model, end_id), f"doc_id {kind}, queue int, chunk bigint, before bigint, n bigint, ids binary"
        ),
        "packing_ids",
    )
    starts = written(_chunk_starts(ids), "packing_starts")
    sizes = np.zeros(len(names) + 1, np.int64)
    for r in ids.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        sizes[r["queue"]] = r["n"]
    total = max(int(sizes.sum()), 1)
    asked = weights or {}
    scale = sum(asked.values()) or 1.0
    left = sum(int(sizes[place[s]]) for s in names if s not in asked) + int(sizes[-1])
    shares = sizes / total
    for s, share in asked.items():
        if s in place:
            shares[place[s]] = share / scale * (1 - left / total)
    rounds = Rounds(sizes, shares * total, window)
    placed = ids.join(starts, ["queue", "chunk"]).select(
        "doc_id", "queue", (F.col("from") + F.col("before")).alias("start"), "n", "ids"
    )
    return placed.mapInArrow(
        _cut(rounds, pa.from_numpy_dtype(np.int64) if kind == "bigint" else _arrow(spark, kind)),
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def _arrow(spark, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.createDataFrame([], f"x {kind}").schema["x"].dataType)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the pieces of every sequence put together; at most a window per row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
