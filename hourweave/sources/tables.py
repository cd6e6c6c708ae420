"""Tables on shared storage: stations, edges, readings, features, small stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourweave import model
from hourweave.session import written

READINGS = "readings"
FEATURES = "features"


# --- readings and features -------------------------------------------------

def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The six reading columns; timestamps without zone become UTC instants."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in model.READING_SCHEMA.fields])


def table_schemas() -> dict[str, T.StructType]:
    ingested = T.StructField("ingested_at", T.TimestampType())
    return {READINGS: T.StructType([*model.READING_SCHEMA.fields, ingested]), FEATURES: model.FEATURE_SCHEMA}


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def ensure_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the two tables where absent; returns their paths."""
    paths = {name: f"{root}/{name}" for name in table_schemas()}
    for name, schema in table_schemas().items():
        if not path_exists(spark, paths[name]):
            spark.createDataFrame([], schema).write.parquet(paths[name])
    return paths


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read with the declared schema: columns that older files lack come back null."""
    return spark.read.schema(schema).parquet(path)


def new_rows(batch: DataFrame, target: DataFrame, pk: list[str] | tuple, order: list[str] | tuple = ()) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``target``; of equal keys the first by ``order``, then by place in the batch."""
    numbered = batch.select(F.struct("*").alias("_row"), *pk, F.struct(*order, F.monotonically_increasing_id().alias("_nr")).alias("_place"))
    first = numbered.groupBy(*pk).agg(F.min_by("_row", "_place").alias("_row")).select("_row.*")
    return first.join(target.select(*pk), list(pk), "left_anti").select(*batch.columns)


def insert_new(
    batch: DataFrame, target_path: str, pk: list[str] | tuple, schema: T.StructType, order: list[str] | tuple = ()
) -> DataFrame:
    """Append the rows with new keys and return exactly those rows.

    Of equal keys the first row by the batch's columns ``order`` (say partition and offset) stays, without them the one that
    stands first in the batch. The batch is evaluated once: its rows are numbered and written, then the
    inserted ones are, so the returned frame does not depend on the target that has just grown.
    """
    spark = batch.sparkSession
    shaped = batch
    if "quality_flag" in schema.names:
        flag = F.col("quality_flag") if "quality_flag" in batch.columns else F.lit(None)
        shaped = shaped.withColumn("quality_flag", F.coalesce(flag.cast("int"), F.lit(0)))
    if "ingested_at" in schema.names and "ingested_at" not in batch.columns:
        shaped = shaped.withColumn("ingested_at", F.current_timestamp())
    place = F.struct(*order, F.monotonically_increasing_id().alias("nr")).alias("_arrival")
    shaped = written(
        shaped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], place), "insert_batch"
    )
    # equal keys have equal timestamps: only that stretch of the target is read
    span = shaped.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    target = read_table(spark, target_path, schema)
    if span["a"] is not None:
        low, high = (F.lit(t).cast("timestamp") for t in (span["a"], span["b"]))
        target = target.where(F.col("timestamp").between(low, high))
    fresh = written(new_rows(shaped, target, pk, ["_arrival"]).select(*schema.names), "insert")
    fresh.write.mode("append").parquet(target_path)
    return fresh


def write_features(df: DataFrame, path: str) -> None:
    """Feature table partitioned by split, so a split scan opens only its own files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(
    spark: SparkSession, path: str, splits: list[str] | tuple, columns: list[str] | tuple = model.MODEL_INPUTS
) -> DataFrame:
    df = spark.read.schema(model.FEATURE_SCHEMA).parquet(path)
    return df.where(F.col("split").isin(*splits)).select("station_id", "timestamp", *columns, "split")


def exclude_stations(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop rows of the listed stations (say those with monitor_type FRM)."""
    return df.join(excluded.select("station_id"), "station_id", "left_anti")


def date_range(df: DataFrame, date_from: str | None = None, date_to: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Inclusive days; either side may be open."""
    if date_from:
        df = df.where(F.col(ts) >= F.lit(f"{date_from} 00:00:00").cast("timestamp"))
    if date_to:
        df = df.where(F.col(ts) <= F.lit(f"{date_to} 23:59:59").cast("timestamp"))
    return df


def encoder_context(df: DataFrame, test_start: Column, hours: int = model.CONTEXT_HOURS) -> DataFrame:
    return df.where(F.col("timestamp") >= test_start - F.make_dt_interval(hours=F.lit(hours)))


# --- stations and edges ----------------------------------------------------

def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.STATION_SCHEMA).csv(path, header=True)


def write_stations(stations: DataFrame, path: str) -> None:
    """One sorted CSV file; the station list is metadata."""
    names = [f.name for f in model.STATION_SCHEMA.fields]
    stations.select(*names).orderBy("station_id").coalesce(1).write.mode("overwrite").csv(path, header=True)


_INDEX = "map<string, array<array<string>>>"


def write_edges(stations: DataFrame, edges: DataFrame, path: str) -> None:
    """The neighbour index as JSON text, ``{"id": [["neighbour", weight], ...]}`` per line;
    stations without neighbours keep an empty list."""
    pair = F.concat(F.lit('["'), "neighbor_id", F.lit('",'), F.col("weight").cast("string"), F.lit("]"))
    ordered = F.array_sort(F.collect_list(F.struct("neighbor_id", pair.alias("text"))))
    lists = edges.groupBy("station_id").agg(ordered.alias("pairs"))
    listed = F.concat_ws(",", F.col("pairs.text"))
    text = F.concat(
        F.lit('{"'), F.col("station_id"), F.lit('":['), F.coalesce(listed, F.lit("")), F.lit("]}")
    )
    stations.select("station_id").join(lists, "station_id", "left").select(text.alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_edges(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Edges from index JSON: one object per line, or one object per file."""
    text = spark.read.text(path, wholetext=whole_file)
    entries = text.select(F.explode(F.from_json("value", _INDEX)).alias("station_id", "pairs"))
    pair = entries.select("station_id", F.explode("pairs").alias("pair"))
    return pair.select(
        "station_id",
        F.col("pair")[0].alias("neighbor_id"),
        F.col("pair")[1].cast("double").alias("weight"),
    )


# --- small stores ----------------------------------------------------------

def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


MARGIN_SCHEMA = "horizon int, n bigint, q_level double, upper double, lower double, coverage_before double, coverage_after double"
SCALER_SCHEMA = "feature string, mean double, std double"


def write_margins(margins: DataFrame, path: str) -> None:
    write_metrics(margins, path)


def read_margins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARGIN_SCHEMA).json(path)


def write_scaler(scaler: DataFrame, path: str) -> None:
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCALER_SCHEMA).parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Long form, clustered by forecast so that a forecast's draws compress together."""
    keys = ["station_id", "window_start", "horizon"]
    samples.repartition(*keys).sortWithinPartitions(*keys, "sample_id").write.mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
