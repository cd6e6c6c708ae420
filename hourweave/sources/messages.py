"""Keyed JSON messages: key = station id bytes, value = one JSON object."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourweave import model
from hourweave.functions.columns import finite

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _wire(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return F.date_format(column, _ISO).alias(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return finite(column).alias(field.name)
    return column


def to_message(df: DataFrame) -> DataFrame:
    """(key, value); missing numbers, NaN and infinities are written as null."""
    body = F.to_json(F.struct(*[_wire(f) for f in df.schema.fields]), {"ignoreNullFields": "false"})
    return df.select(
        F.col("station_id").cast("binary").alias("key"), F.encode(body, "UTF-8").alias("value")
    )


def _parsed(df: DataFrame, table: T.StructType, beside: list[Column]) -> DataFrame:
    message = F.from_json(F.col("value").cast("string"), model.message_schema(table)).alias("_m")
    typed = [
        F.try_to_timestamp(F.col(f"_m.{f.name}")).alias(f.name)
        if isinstance(f.dataType, T.TimestampType)
        else F.col(f"_m.{f.name}")
        for f in table.fields
    ]
    read = df.select(message, F.struct(*beside).alias("_beside")) if beside else df.select(message)
    return read.select(*typed, *(["_beside"] if beside else []))


def _complete(table: T.StructType) -> Column:
    """Whether a message has all key fields of its table: station, hour and, for readings, parameter."""
    keys = [k for k in model.READING_KEY if k in table.names]
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def from_message(
    df: DataFrame, table: T.StructType = model.READING_SCHEMA, order: tuple[str, ...] = ()
) -> DataFrame:
    """Typed rows of ``table``; messages without all key fields are dropped (``rejected`` has them).

    ``order`` names columns of the source, such as partition and offset, that tell which of two messages
    came later; they are kept beside the fields.
    """
    kept = _parsed(df, table, [F.col(c) for c in order]).where(_complete(table))
    return kept.select(*table.names, *[F.col("_beside").getField(c).alias(c) for c in order])


def rejected(df: DataFrame, table: T.StructType = model.READING_SCHEMA) -> DataFrame:
    """The source rows ``from_message`` drops: text that does not parse, or a key field missing."""
    return _parsed(df, table, [F.col(c) for c in df.columns]).where(~_complete(table)).select("_beside.*")


def kafka_source(
    spark: SparkSession, servers: str, topic: str, offset: str = "latest"
) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offset)
        .option("failOnDataLoss", "false")
        .load()
    )


def kafka_sink(servers: str, topic: str):
    """A sink function for ``stream_features`` and ``replay``."""

    def send(messages: DataFrame) -> None:
        (
            messages.write.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("kafka.acks", "all")
            .option("kafka.retries", "5")
            .option("topic", topic)
            .save()
        )

    return send


#: What orders messages from files: later files are later messages.
FILE_ORDER = ("file_modification_time", "file_name")


def file_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Message files (one JSON object per line) as a stream with a ``value`` column and FILE_ORDER."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select("value", *[f"_metadata.{c}" for c in FILE_ORDER])
