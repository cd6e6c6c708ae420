"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

Instead of running merges over a whole text, the encoder walks it from left to
right with the longest vocabulary piece at each place (found by one Aho-Corasick
pass) and backs off to shorter pieces. A piece may follow another only if merging
the text of both gives exactly these two pieces again; places from which no piece
works are remembered in a bit field, so every place fails at most once and the
work is linear in the text.

Texts stay rows of a Spark DataFrame: encoding runs per Arrow batch inside the
tasks that read them, without any exchange.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
END_ID = 2
#: Entries of one generation of the word cache in a worker; two generations are kept.
CACHED_WORDS = 150_000
#: Longer stretches are encoded each time anew.
CACHED_LENGTH = 48
#: Text encoded before a batch is handed back, in characters (a longer text is its own batch).
BATCH_CHARS = 4_000_000

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_each", _one_each)


class PieceCodec:
    """Encoder and decoder of one BPE model with byte fallback and no text normalisation."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is expected")
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a model that leaves texts as they are is expected")
        if any(p.type in (_USER, _UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.strings = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        #: Of each piece its packed id and the text that this id decodes to.
        self._known = {s: (np.int32(i).tobytes(), s.replace(SPACE, " ")) for s, i in self.ids.items()}
        self._scores = {p.piece: p.score for p in spec.pieces if p.type == _NORMAL}
        self._byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        if any(SPACE in s.lstrip(SPACE) for s in self.ids):
            raise ValueError("pieces across word borders are not supported")
        #: Single characters take part in merges even where they are no pieces themselves.
        self._atoms = {c for s in self.ids for c in s}
        self._compatible: dict[tuple[str, str], bool] = {}
        reachable = [s for s in self.ids if len(s) == 1 or self.merged(s) == [s]]
        self._usable = set(reachable) | self._atoms
        self._matches = ahocorasick.Automaton()
        for s in self._usable:
            self._matches.add_word(s, len(s))
        self._matches.make_automaton()
        self._shorter = {s: next((k for k in range(len(s) - 1, 0, -1) if s[:k] in self._usable), 0) for s in self._usable}
        newline = "" if "\n" in self._atoms else "\n"
        #: Stretches between which no piece reaches: leading spaces with what follows, and line ends.
        self._stretches = re.compile(rf"{SPACE}+[^{SPACE}{newline}]*|[^{SPACE}{newline}]+" + ("|\n" if newline else "")).findall
        self._young: dict[str, tuple[bytes, str]] = {}
        self._old: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts, scores = list(text), self._scores
        while len(parts) > 1:
            joined = [parts[i] + parts[i + 1] for i in range(len(parts) - 1)]
            best, place = max(((scores.get(s, -np.inf), -i) for i, s in enumerate(joined)))
            if best == -np.inf:
                break
            parts[-place : 2 - place] = [joined[-place]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the text of both leaves exactly these two."""
        found = self._compatible.get((left, right))
        if found is None:
            if len(self._compatible) > 1 << 18:
                self._compatible.clear()
            found = self._compatible[left, right] = self.merged(left + right) == [left, right]
        return found

    def split(self, text: str) -> list[str]:
        """The text (spaces already escaped) as pieces and single characters outside the vocabulary."""
        if text in self._usable:
            return [text]
        longest = [0] * len(text)
        for end, length in self._matches.iter(text):
            longest[end - length + 1] = length  # the match that ends last is the longest
        if 0 not in longest:
            return self._walk(text, longest)
        out, start = [], 0
        while start < len(text):
            if not longest[start]:
                out.append(text[start])
                start += 1
                continue
            stop = start
            while stop < len(text) and longest[stop]:
                stop += 1
            out += self._walk(text[start:stop], longest[start:stop])
            start = stop
        return out

    def _walk(self, text: str, longest: list[int]) -> list[str]:
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        place, length = 0, longest[0]
        while True:
            while length:
                end = place + length
                piece = text[place:end]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                length = self._shorter[piece]
            if length:
                out.append(piece)
                place = end
                if place == len(text):
                    return out
                length = longest[place]
            else:  # nothing fits here after what came before: this place is a dead end
                failed[place >> 3] |= 1 << (place & 7)
                piece = out.pop()
                place -= len(piece)
                length = self._shorter[piece]

    def _ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for s in parts:
            found = self.ids.get(s)
            if found is None:
                out += [self._byte_ids[b] for b in s.encode()]
            else:
                out.append(found)
        return out

    def pieces_to_text(self, ids: list[int]) -> str:
        """Pieces joined, bytes put together, spaces restored; control ids give nothing."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == _BYTE:
                raw.append(int(self.strings[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode(errors="one_each"))
                raw.clear()
            if i >= 0 and self.kinds[i] == _NORMAL:
                out.append(self.strings[i].replace(SPACE, " "))
            elif i >= 0 and self.kinds[i] == _UNKNOWN:
                out.append(" ⁇ ")
        return "".join(out)

    def _stretch(self, s: str) -> tuple[bytes, str]:
        parts = self.split(s)
        try:
            found = [self._known[p] for p in parts]
        except KeyError:
            ids = self._ids_of(parts)
            return np.array(ids, "<i4").tobytes(), self.pieces_to_text(ids)
        return b"".join([c for c, _ in found]), "".join([t for _, t in found])

    def _cached(self, s: str) -> tuple[bytes, str]:
        """The code of a stretch from the cache; two generations keep frequent words and bound the rest."""
        if len(s) > CACHED_LENGTH:
            return self._stretch(s)
        if len(self._young) >= CACHED_WORDS:
            self._old, self._young = self._young, {}
        found = self._young[s] = self._old.get(s) or self._stretch(s)
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as packed 32-bit numbers, and the text that they decode to."""
        if not text:
            return b"", ""
        young = self._young
        codes, texts = [], []
        for s in self._stretches(self.prefix + text.replace(" ", SPACE)):
            found = young.get(s)
            if found is None:
                found = self._cached(s)
                young = self._young
            codes.append(found[0])
            texts.append(found[1])
        return b"".join(codes), self._without_prefix("".join(texts))

    def _without_prefix(self, text: str) -> str:
        return text[1:] if self.prefix and text.startswith(" ") else text

    def encode_ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text or "")[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Only a space that is part of the first piece counts as the added prefix."""
        text = self.pieces_to_text(ids)
        first = next((i for i in ids if self.kinds[i] != _CONTROL), None)
        return self._without_prefix(text) if first is not None and self.kinds[first] == _NORMAL else text


_codecs: dict[str, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model, built once in each Python process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    """A model file's bytes, read where the job is set up; a vocabulary is some hundred KB."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, end_id: int | None = END_ID, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, decoded) for every row of ``docs``.

    ``ids`` are the text's pieces and then ``end_id`` (if not None); ``decoded`` is the
    text that these ids decode to. A null text counts as empty: only the end id, decoded
    to the empty text. Repeated rows and ids give one row each; other columns are left out.
    """
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, ids array<int>, decoded string"
    end = b"" if end_id is None else np.array([end_id], "<i4").tobytes()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in source:
            keys, texts = batch.column(0), batch.column(1)
            first = size = 0
            done: list[tuple[bytes, str]] = []
            for i, text in enumerate(texts):
                done.append(own.encode(text.as_py() or ""))
                size += len(done[-1][1])
                if size >= BATCH_CHARS or i + 1 == len(texts):
                    yield _packed(keys.slice(first, len(done)), done, end)
                    first, size, done = i + 1, 0, []

    return docs.select(id_column, "text").mapInArrow(batches, schema)


def _packed(keys: pa.Array, done: list[tuple[bytes, str]], end: bytes) -> pa.RecordBatch:
    codes = [c for c, _ in done]
    offsets = np.concatenate([[0], np.cumsum([(len(c) + len(end)) // 4 for c in codes])]).astype(np.int32)
    values = np.frombuffer(b"".join(x for pair in zip(codes, repeat(end)) for x in pair), "<i4")
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays([keys, ids, pa.array([t for _, t in done], pa.string())], ["k", "ids", "decoded"])


def decode_ids(encoded: DataFrame, model: bytes, id_column: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids); null ids give null."""
    schema = f"{id_column} {encoded.schema[id_column].dataType.simpleString()}, text string"

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in source:
            texts = [None if x.as_py() is None else own.decode([i for i in x.as_py() if i is not None]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return encoded.select(id_column, "ids").mapInArrow(batches, schema)
