"""Structured Streaming twin of the batch feature build.

Each micro-batch appends its readings to a log, recomputes the feature rows it
can change with the *batch* functions, and appends these to a second log; readers
take the row of the latest batch per key (``logs.DayLog``). A batch may run twice
without harm, and duplicates, late rows and corrections all come down to "last wins".

What a batch reopens is decided per station: the frontier table says how far each station had come, a
station's first open hour follows from its own earliest reading, and the stations that listen to it
are rewritten from that hour on. All other hours are settled and taken as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hourweave import model
from hourweave.functions.columns import finite
from hourweave.operators.clean import last_by
from hourweave.operators.impute import LONG_DAYS, MEDIAN_MAX
from hourweave.operators.spatial import elevation_difference, with_elevation_gap
from hourweave.plans.features import build_features
from hourweave.sources.messages import FILE_ORDER, to_message
from hourweave.streaming.logs import DayLog, latest

_REACH = MEDIAN_MAX + 1
LOOKBACK_HOURS = LONG_DAYS * 24 + 24
#: Hours before a rewritten one that trailing means and lags of its own and of its neighbours reach, with room.
TRAILING_HOURS = max(*model.ROLLS, *model.LAGS) * 2
#: A log's day with more finished segments than this is merged before a batch reads it.
MAX_SEGMENTS = 8

_FRONTIER = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("opens_at", T.TimestampType()),
    ]
)
_STATIC = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("spatial_elev_diff", T.DoubleType())])

Sink = Callable[[DataFrame], None]


class StreamState:
    """The logs of a stream under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.readings = DayLog(spark, f"{root}/readings_log", model.READING_SCHEMA, model.READING_KEY)
        self.features = DayLog(spark, f"{root}/features_log", model.FEATURE_SCHEMA, model.FEATURE_KEY)
        self.frontier = DayLog(spark, f"{root}/frontier_log", _FRONTIER, ("station_id",), dated=False)
        self.static = DayLog(spark, f"{root}/static_log", _STATIC, ("station_id",), dated=False)

    def all(self) -> tuple[DayLog, ...]:
        return self.readings, self.features, self.frontier, self.static


def current_readings(spark: SparkSession, root: str) -> DataFrame:
    return StreamState(spark, root).readings.read()


def current_features(spark: SparkSession, root: str) -> DataFrame:
    """The feature table as of the last finished batch.

    The elevation step to the neighbours with data is the same in all hours of a station and changes when a
    neighbour sends its first reading. It is kept apart and joined here, so that older hours have it too.
    """
    state = StreamState(spark, root)
    hours = state.features.read().drop("spatial_elev_diff")
    return hours.join(state.static.read(), "station_id", "left").select(*model.FEATURE_COLUMNS)


def merge_history(history: DataFrame, batch: DataFrame, key: tuple = model.READING_KEY) -> DataFrame:
    """History and batch as one table; the batch wins on equal keys."""
    both = history.withColumn("seq", F.lit(0)).unionByName(batch.withColumn("seq", F.lit(1)))
    return latest(both, key).select(*history.columns)


def history_lookup(history: DataFrame, stations: DataFrame, low, high) -> DataFrame:
    """Rows of the listed stations with low <= timestamp < high."""
    within = history.where((F.col("timestamp") >= low) & (F.col("timestamp") < high))
    return within.join(stations.select("station_id"), "station_id", "left_semi")


def only_batch_hours(features: DataFrame, batch: DataFrame) -> DataFrame:
    """Feature rows whose station-hour occurs in the batch."""
    return features.join(batch.select("station_id", "timestamp").distinct(), ["station_id", "timestamp"], "left_semi")


def _deduplicated(batch: DataFrame) -> DataFrame:
    """One row per key, the last to arrive: by the source's order columns, then by place in the batch.

    One key is always in one partition of a keyed topic, so offsets of different partitions need no order.
    """
    names = [f.name for f in model.READING_SCHEMA.fields]
    arrival = [c for c in (*FILE_ORDER, "offset") if c in batch.columns]
    clean = batch.withColumn("value", finite(F.col("value"))).withColumn("_nr", F.monotonically_increasing_id())
    values = [c for c in names if c not in model.READING_KEY]
    return last_by(clean, list(model.READING_KEY), [*arrival, "_nr"], values).select(*names)


def _frontier(arrived: DataFrame, before: DataFrame) -> DataFrame:
    """Per station of the batch its last hour and the first hour whose own values may still change.

    A reading changes at most a gap of 24 hours before it; hours up to 24 before the station's
    previous end were filled without knowing what follows.
    """
    seen = arrived.groupBy("station_id").agg(F.min("timestamp").alias("from_ts"), F.max("timestamp").alias("to_ts"))
    hour = F.expr("interval 1 hour")
    opens = F.least(F.col("from_ts"), F.coalesce(F.col("last_ts") + hour, F.col("from_ts"))) - hour * _REACH
    joined = seen.join(before.select("station_id", "last_ts"), "station_id", "left")
    return joined.select("station_id", F.greatest("to_ts", "last_ts").alias("last_ts"), opens.alias("opens_at"))


def _rewritten(opened: DataFrame, edges: DataFrame) -> DataFrame:
    """(station_id, emits_from): stations whose rows may change, from which hour on."""
    listeners = edges.join(
        opened.select(F.col("station_id").alias("neighbor_id"), "opens_at"), "neighbor_id"
    ).select("station_id", "opens_at")
    both = opened.select("station_id", "opens_at").unionByName(listeners)
    return both.groupBy("station_id").agg(F.min("opens_at").alias("emits_from"))


def _needed(opened: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(station_id, needs_from, opens_at): whose settled hours the batch reads, from where to where.

    Settled are the hours before ``opens_at``; all of them for stations without readings in the batch.
    """
    hour = F.expr("interval 1 hour")
    own = opened.select("station_id", (F.col("opens_at") - hour * LOOKBACK_HOURS).alias("needs_from"))
    back = (F.col("emits_from") - hour * TRAILING_HOURS).alias("needs_from")
    sources = edges.join(targets, "station_id").select(F.col("neighbor_id").alias("station_id"), back)
    wanted = own.unionByName(targets.select("station_id", back)).unionByName(sources)
    return (
        wanted.groupBy("station_id")
        .agg(F.min("needs_from").alias("needs_from"))
        .join(opened.select("station_id", "opens_at"), "station_id", "left")
    )


def process_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    stations: DataFrame,
    edges: DataFrame,
    train_end: date,
    val_end: date,
    sink: Sink | None = None,
) -> None:
    """One micro-batch; see the module text. Safe to repeat with the same id."""
    spark = batch.sparkSession
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    edges = with_elevation_gap(edges, stations)
    state = StreamState(spark, root)
    arrived = state.readings.write(_deduplicated(batch), batch_id)
    if arrived.isEmpty():
        return
    before = batch_id - 1
    for small in (state.frontier, state.static):
        small.compact(before, MAX_SEGMENTS)
    known = state.frontier.read(before)
    opened = state.frontier.write(_frontier(arrived, known), batch_id)
    targets = _rewritten(opened, edges)
    needed = _needed(opened, targets, edges)
    # one row: the first day whose files are opened
    first_day = needed.agg(F.date_format(F.min("needs_from"), "yyyy-MM-dd").alias("d")).first()["d"]
    for log in (state.readings, state.features):
        log.compact(before, MAX_SEGMENTS, first_day)

    ts, hour = F.col("timestamp"), F.expr("interval 1 hour")
    raw = state.readings.read(batch_id, first_day).join(opened.select("station_id", "opens_at"), "station_id")
    raw = raw.where(ts >= F.col("opens_at") - hour * _REACH).drop("opens_at")
    finished = state.features.read(before, first_day).join(needed, "station_id")
    settled = finished.where(
        (ts >= F.col("needs_from")) & (F.col("opens_at").isNull() | (ts < F.col("opens_at")))
    ).select("station_id", "timestamp", *model.PARAMETERS)
    active = known.select("station_id").union(arrived.select("station_id")).distinct()
    heard = edges.join(targets, "station_id", "left_semi")
    features = build_features(raw, stations, heard, train_end, val_end, settled, active)
    changed = features.join(targets, "station_id").where(ts >= F.col("emits_from")).select(*model.FEATURE_COLUMNS)
    emitted = state.features.write(changed, batch_id)

    newcomers = opened.join(known, "station_id", "left_anti").select(F.col("station_id").alias("neighbor_id"))
    met = edges.join(newcomers, "neighbor_id", "left_semi").select("station_id")
    met = met.union(newcomers).distinct()
    steps = elevation_difference(edges.join(met, "station_id", "left_semi"), active)
    state.static.write(steps, batch_id)
    if sink is not None:
        sink(to_message(emitted))


def distinct_messages(source: DataFrame, delay: str) -> DataFrame:
    """Readings without redelivered copies and without rows later than the watermark.

    A copy has the same key, value and flag; a correction differs and passes. What is remembered of a message is given
    up once the watermark, the latest timestamp seen less ``delay``, has passed it by ``delay``.
    """
    names = [f.name for f in model.READING_SCHEMA.fields]
    return source.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(names)


def stream_features(
    source: DataFrame,
    root: str,
    stations: DataFrame,
    edges: DataFrame,
    checkpoint: str,
    sink: Sink | None = None,
    train_end: date = model.TRAIN_END,
    val_end: date = model.VAL_END,
    trigger: dict | None = None,
    late: str | None = None,
) -> StreamingQuery:
    """Start the feature stream on typed readings (see ``messages.from_message``).

    With ``late``, such as "30 days", rows that come later than that after the newest one are dropped, which bounds how far
    back a batch can reach, and redelivered messages are dropped with state bounded by the same time.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, stations, edges, train_end, val_end, sink)

    rows = distinct_messages(source, late) if late else source
    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Write the logs' current rows under a fresh root, for a restart with a new checkpoint."""
    for old, new in zip(StreamState(spark, root).all(), StreamState(spark, target).all()):
        new.write(old.read(), -1)
