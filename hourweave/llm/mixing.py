"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a schedule, the density of its share over
training time. Its documents stand in a fixed pseudo-random order and are passed as often as the
target asks; a document's place in the source's stream is a cumulative token demand, which the
integral of the schedule, inverted, turns into a training position between 0 and 1.
Documents are finally range-sorted by position.

Cumulative sizes come from three levels (documents in small buckets, buckets in
groups, groups in the source), so no task orders a whole source, however large. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave.llm.expressions import word_count
from hourweave.session import written

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (1, 2, 3)
#: A source is passed at most so often.
PASSES = 3
#: Relative density of a source in equal stretches of training time, by its place in the order, repeating.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Documents in a bucket on average, and buckets in a group.
BUCKET, GROUP = 256, 256


def _cycled(values, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, place, n_docs, source_size, target) from rows (source, size).

    Targets share all words by weight. A source's target stops at ``passes`` times its size and
    the excess goes to the others by weight: sources are filled up to one common level of words per
    unit of weight, found from those sorted by the level at which they are full. One row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    listed = per.withColumn("place", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1).withColumns(
        {"weight": _cycled(weights, F.col("place")), "full": F.col("source_size") * passes}
    )
    by_level = W.orderBy(F.col("full") / F.col("weight"), "place")
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("full").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    levels = listed.withColumn("level", left.cast("double") / open_weight.cast("double"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("full") / F.col("weight"))
    level = F.min_by("level", F.when(fits.isNotNull(), F.struct(fits, "place"))).over(everything)
    return levels.select(
        "source", "place", "n_docs", "source_size",
        F.least(F.col("full").cast("double"), level * F.col("weight")).alias("target"),
    )


def _position(demand: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which the integral of the source's schedule reaches ``demand`` (both 0 to 1)."""
    out = None
    for i, steps in enumerate(schedules):
        done, time = 0.0, F.lit(1.0)
        pieces = []
        for j, s in enumerate(steps):
            share = s / sum(steps)
            pieces.append((done, share, j))
            done += share
        for start, share, j in reversed(pieces):
            if share > 0:
                inside = (F.lit(float(j)) + (demand - F.lit(start)) / F.lit(share)) / F.lit(float(len(steps)))
                time = F.when(demand < F.lit(start + share), inside).otherwise(time)
        here = F.pmod(place, F.lit(len(schedules))) == i
        out = F.when(here, time) if out is None else out.when(here, time)
    return out


def assign(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, schedules=SCHEDULES) -> DataFrame:
    """Per row of ``docs``: key, doc_id, source, size, source_size, target, taken and ``copies``.

    ``copies`` is an array of (pass, words, position): whole passes of the document, and
    possibly its first words in the source's last, partial pass, so a source's taken words are its
    target rounded. ``taken`` sums the words. Documents without words and those the mix leaves out have no
    copies. The order inside a source is that of the MD5 of the id as text (null: empty), then id, size and
    ``key``, so reruns agree; equal rows are interchangeable.
    """
    spread = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), row_key(docs).alias("key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
    )
    targets = source_targets(sized.select("source", "size"), weights, passes).withColumnRenamed("source", "_source")
    placed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_bucket", F.floor(spread * F.ceil(F.col("n_docs") / BUCKET)))
    )
    buckets = placed.groupBy("place", "_bucket").agg(F.sum("size").alias("_n"))
    buckets = buckets.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = buckets.groupBy("place", "_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("place", "_group", earlier(W.partitionBy("place").orderBy("_group")).alias("_before"))
    offsets = buckets.join(groups, ["place", "_group"]).select(
        "place", "_bucket",
        (F.col("_before") + earlier(W.partitionBy("place", "_group").orderBy("_bucket"))).alias("_before"),
    )
    inside = W.partitionBy("place", "_bucket").orderBy("_order", "doc_id", "size", "key")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    streamed = placed.join(offsets, ["place", "_bucket"]).withColumn("_start", F.col("_before") + before)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("_quota") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("_quota") - F.col("_whole") * F.col("source_size")
    streamed = (
        streamed.withColumn("_quota", F.round("target").cast("bigint"))
        .withColumn("_whole", whole.cast("int"))
        .withColumn("_part", F.least(F.greatest(rest - F.col("_start"), F.lit(0)), F.col("size")))
    )

    def copy(e: Column) -> Column:
        demand = (e * F.col("source_size") + F.col("_start")) / F.col("_quota")
        return F.struct(
            e.cast("int").alias("pass"),
            F.when(e < F.col("_whole"), F.col("size")).otherwise(F.col("_part")).alias("words"),
            _position(demand, F.col("place"), schedules).alias("position"),
        )

    passes_made = F.sequence(F.lit(0), F.col("_whole"))
    copies = F.filter(F.transform(passes_made, copy), lambda c: c["words"] > 0)
    return streamed.select(
        "key", "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + F.col("_part")).cast("bigint").alias("taken"),
        F.when(F.col("_quota") > 0, copies).otherwise(F.array().cast("array<struct<pass:int,words:bigint,position:double>>")).alias("copies"),
    )


def by_position(plan: DataFrame) -> DataFrame:
    """The rows of ``assign`` with the ``position`` of their first copy, range-sorted by it.

    Rows without copies have no position; they are spread behind the others by a hash of their id.
    """
    placed = plan.withColumn("position", F.get("copies", F.lit(0))["position"])
    spread = F.lit(1.0) + F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) / F.lit(float(1 << 32))
    # written, so that the sample that the ranges are drawn from does not make the plan run twice
    placed = written(placed.withColumn("_order", F.coalesce("position", spread)), "mix_positions")
    return placed.repartitionByRange("_order", "key").sortWithinPartitions("_order", "key").drop("_order")


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed; rows with an equal one are taken as equal."""
    usable = [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in usable])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position.

    A row of a partial pass keeps its first words only (joined by one space), and its ``n_chars``, if there is such a column,
    follows. Rows with the same position are ordered by key and pass.
    """
    plan = assign(docs, **options)
    # equal rows are told apart by a number on both sides; which of them gets which copies is all the same
    nth = F.row_number().over(W.partitionBy("key").orderBy("taken"))
    plan = plan.select("key", "size", "copies", nth.alias("nth"))
    plan = plan.where(F.size("copies") > 0)
    rows = docs.select(row_key(docs).alias("key"), F.struct("*").alias("row"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("key")))
    taken = rows.join(plan, ["key", "nth"]).select("key", "row", "size", F.explode("copies").alias("copy"))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.lit(1), F.col("copy.words").cast("int")))
    text = F.when(F.col("copy.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    out = taken.withColumn("_text", text)
    columns = []
    for f in docs.schema.fields:
        value = F.col("row").getField(f.name)
        if f.name == "text":
            value = F.col("_text")
        elif f.name == "n_chars":
            value = F.when(F.col("copy.words") < F.col("size"), F.length("_text").cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name))
    ordered = out.select(
        F.struct(*columns).alias("row"), F.col("copy.position").alias("position"), "key", F.col("copy.pass").alias("pass")
    )
    return ordered.repartitionByRange("position", "key", "pass").sortWithinPartitions("position", "key", "pass").select("row.*")
