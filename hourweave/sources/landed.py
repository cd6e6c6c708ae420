"""Landed provider documents: ``{"Data": [record, ...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourweave import model


def explode_data(documents: DataFrame) -> DataFrame:
    """The records of all documents, and ``landed_at``, which sorts in the provider's order.

    That is the document's place (file path, block of the file, row of the block; null where ``documents`` have no column
    ``document``) and then the record's place in ``Data``.
    """
    if "document" not in documents.columns:
        documents = documents.withColumn("document", F.lit(None).cast(_DOCUMENT))
    records = documents.select("document", F.posexplode("Data").alias("place", "record"))
    return records.select(F.struct("document", "place").alias("landed_at"), "record.*")


_DOCUMENT = "struct<file:string,block:bigint,row:bigint>"


def _read(spark: SparkSession, path: str, record: T.StructType, one_per_file: bool) -> DataFrame:
    documents = spark.read.schema(model.landed_schema(record)).json(path, multiLine=one_per_file)
    # row numbers rise inside a block of a file, whatever tasks the blocks are dealt to
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return explode_data(documents.select("Data", place.alias("document")))


def read_samples(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    return _read(spark, path, model.SAMPLE_RECORD, one_per_file)


def read_monitors(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    return _read(spark, path, model.MONITOR_RECORD, one_per_file)
