"""Language ID by the nearest of several centroids per language.

A text is a TF-IDF vector over hashed byte 2- and 3-grams of its letters, of length 1. Labelled texts of
each language are clustered into a few centroids (spherical k-means); a text gets the
language of the centroid with the greatest cosine, and is marked as rejected when it is farther away
than nearly all texts that the centroid was made of. Texts are never moved: prediction is one pass over
the documents, with a model whose size is bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hashed features.
FEATURES = 1 << 13
#: The classifier is fitted on at most so many labelled texts, and about so many of each language.
SAMPLE, PER_LANGUAGE = 4000, 800
CENTROIDS = 4
#: Share of a centroid's own texts within its radius, and how much farther a text may be.
WITHIN, SLACK = 0.995, 1.25
UNDETERMINED = "und"
_CHARS = 4_000_000
_ROUNDS = 12

#: Bytes of ASCII letters (lower-cased) and of all other characters stay, the rest become spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _grams(texts: list[str]) -> list[np.ndarray]:
    """Feature numbers of every 2- and 3-gram of each text."""
    raw = [t.lower().encode().translate(_LETTERS) + b"  " for t in texts]
    b = np.frombuffer(b"  " + b"".join(raw), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(65_599) + b[2:] + np.uint32(1 << 20)
    both = [((x * np.uint32(2_654_435_761)) >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int32) for x in (two[1:], three)]
    ends = np.cumsum([len(r) for r in raw])
    return [np.concatenate([x[e - len(r) : e] for x in both]) for e, r in zip(ends.tolist(), raw)]


def _counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams, minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def predict(self, grams: np.ndarray) -> tuple[str, float, bool]:
        """(language, cosine, rejected) of one text's features."""
        at, counts = _counts(grams)
        v = (1 + np.log(counts)) * self.idf[at]
        cosine = v @ self.centroids[at] / max(float(np.sqrt(v @ v)), 1e-12)
        best = int(cosine.argmax())
        score = min(max(float(cosine[best]), 0.0), 1.0)
        return self.languages[self.owner[best]], score, 1 - score > self.radius[best]


def sampled(labelled: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``per_language`` different texts (text, lang) of each language, all where it has fewer, ``sample`` at most.

    They are the ones of smallest hash, however often they are repeated. Which ones is settled on hashes
    alone, so no other texts are moved. The ``sample`` most frequent languages take part.
    """
    spark = labelled.sparkSession
    usable = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    per = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct("h").alias("texts"))
    per = per.orderBy(F.desc("count"), "lang").limit(sample).collect()
    each = min(per_language, max(1, sample // max(1, len(per))))
    # with room for chance, so that enough different texts of every language pass; the smallest hashes of these stay
    shares = spark.createDataFrame([(r["lang"], (2.0 * each + 100) / r["texts"]) for r in per], "_lang string, share double")
    unit = F.shiftrightunsigned("h", 34) / F.lit(float(1 << 30))
    # at most ``sample`` rows, so a bounded broadcast
    taken = usable.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(unit < F.col("share"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 34), "h"))
    chosen = taken.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= each).select("lang", "h")
    # at most ``sample`` hashes, so a bounded broadcast
    return taken.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang")


def fit(labelled: DataFrame, per_cluster: int = CENTROIDS, **bounds) -> Model | None:
    """The model of labelled rows (text, lang); None if no text with a letter has a label.

    Whole texts of the bounded sample become sparse counts in Spark; the driver gets these, at most ``sample``
    rows, and clusters them.
    """

    def features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [(t, lang) for t, lang in zip(*[c.to_pylist() for c in batch.columns]) if _has_letter(t)]
            found = [_counts(g) for g in _grams([t for t, _ in rows])] if rows else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for _, lang in rows], pa.string()),
                    pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary()),
                    pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary()),
                ],
                ["lang", "at", "counts"],
            )

    rows = sampled(labelled, **bounds).mapInArrow(features, "lang string, at binary, counts binary").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["counts"])))
    found = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in rows]
    df = np.bincount(np.concatenate([a for a, _ in found]), minlength=FEATURES)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    languages = sorted({r["lang"] for r in rows})
    centroids, owner, radius = [], [], []
    for n, lang in enumerate(languages):
        own = [f for f, r in zip(found, rows) if r["lang"] == lang]
        x = np.zeros((len(own), FEATURES), np.float32)
        for row, (at, counts) in zip(x, own):
            row[at] = (1 + np.log(counts)) * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for c, within in _clusters(x, per_cluster):
            centroids.append(c)
            owner.append(n)
            radius.append(min(1.0, within * SLACK))
    return Model(languages, idf, np.column_stack(centroids).astype(np.float64), np.array(owner), np.array(radius))


def _clusters(x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, float]]:
    """Spherical k-means from far-apart starts: (centroid, radius).

    A radius is what WITHIN of the centroid's own rows stay under, or of all rows if that is more: a centroid
    of one or two odd texts would else reject everything but these.
    """
    centers = x.mean(0, keepdims=True)
    while len(centers) < min(k, len(x)):
        centers = np.vstack([centers, x[(x @ centers.T).max(1).argmin()]])
    for _ in range(_ROUNDS):
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        nearest = (x @ centers.T).argmax(1)
        centers = np.vstack([x[nearest == i].mean(0) for i in range(len(centers)) if (nearest == i).any()])
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    cosine = x @ centers.T
    nearest = cosine.argmax(1)
    usual = float(np.quantile(1 - cosine.max(1), WITHIN))
    for i, c in enumerate(centers):
        own = 1 - cosine[nearest == i, i]
        yield c, max(usual, float(np.quantile(own, WITHIN)) if len(own) else 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` from its whole text.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text without a model.
    ``rejected`` marks texts farther from their centroid than its radius. Repeated rows are predicted
    alike; ``lang``, ``source`` and all other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(texts: list[str | None]) -> list[tuple[str, float, bool]]:
        own = [t for t in texts if _has_letter(t)] if shared.value else []
        found = iter([shared.value.predict(g) for g in _grams(own)] if own else [])
        return [next(found) if shared.value and _has_letter(t) else (UNDETERMINED, 0.0, False) for t in texts]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[tuple[str, float, bool]] = []
            held: list[str | None] = []
            size = 0
            for text in batch.column(1):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size > _CHARS:
                    out += predicted(held)
                    held, size = [], 0
            out += predicted(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _, _ in out], pa.string()), pa.array([s for _, s, _ in out], pa.float64()), pa.array([r for _, _, r in out], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
