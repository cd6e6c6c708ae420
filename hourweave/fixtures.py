"""Sensor data derived from the ``events`` table, for tests, checks and benchmarks.

Ten users make one station, so the network grows with the table: users
0-189 feed the 19 base stations, every further 190 users another copy of the
network at shifted coordinates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourweave import model
from hourweave.functions.columns import by_parameter
from hourweave.operators.clean import first_by
from hourweave.session import use_utc

# --- fixed values: base stations (id, lat, lon, elevation m, type) ----------
BASE_STATIONS = (
    ("06-037-1103", 34.06659, -118.22688, 87.0, "FEM"),
    ("06-037-1201", 34.19925, -118.53276, 226.0, "FRM"),
    ("06-037-1302", 33.901389, -118.205, 27.0, "FEM"),
    ("06-037-1602", 34.01029, -118.0685, 75.0, "FRM"),
    ("06-037-2005", 34.1326, -118.1272, 250.0, "FRM"),
    ("06-037-4008", 33.859662, -118.200707, 12.0, "FEM"),
    ("06-037-4009", 33.793713, -118.171019, 8.0, "FEM"),
    ("06-037-9035", 34.725389, -118.178601, 706.5, "FEM"),
    ("06-059-0007", 33.83062, -117.93845, 10.0, "FEM"),
    ("06-059-2022", 33.63003, -117.67593, 161.0, "FEM"),
    ("06-065-8001", 33.99958, -117.41601, 250.0, "FEM"),
    ("06-065-8005", 33.99636, -117.4924, 250.0, "FEM"),
    ("06-071-0027", 34.030833, -117.61722, 258.0, "FEM"),
    ("06-071-0306", 34.510961, -117.32554, 913.0, "FEM"),
    ("06-071-2002", 34.10002, -117.49201, 381.0, "FRM"),
    ("06-071-9004", 34.106678, -117.274063, 0.0, "FRM"),
    ("06-111-0007", 34.210169, -118.870509, 244.0, "FEM"),
    ("06-111-0009", 34.404281, -118.80998, 190.0, "FEM"),
    ("06-111-2002", 34.276316, -118.683685, 314.0, "FEM"),
)
# --- end of fixed values ----------------------------------------------------

USERS_PER_NETWORK = 190
TRAIN_END = date(2024, 1, 20)
VAL_END = date(2024, 1, 25)

_EVENT_PARAMETER = {"click": "pm25", "view": "no2", "signup": "o3", "error": "pm10", "purchase": "co"}
_SCALE = {"pm25": 1.0, "no2": 1.0, "o3": 0.001, "pm10": 1.0, "co": 0.02}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _network() -> Column:
    return F.floor(F.col("user_id") / USERS_PER_NETWORK)


def _site() -> Column:
    return F.pmod(F.col("user_id"), F.lit(len(BASE_STATIONS)))


def _station_name(base: Column, network: Column) -> Column:
    return F.when(network == 0, base).otherwise(F.concat_ws("-", base, network.cast("string")))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    networks = events(spark, sf_dir).select(_network().alias("net")).distinct()
    base = F.array(
        *[
            F.struct(
                F.lit(f"site-{i}").alias("name"),
                F.lit(sid).alias("sid"),
                F.lit(lat).alias("lat"),
                F.lit(lon).alias("lon"),
                F.lit(elev).alias("elevation_m"),
                F.lit(kind).alias("monitor_type"),
            )
            for i, (sid, lat, lon, elev, kind) in enumerate(BASE_STATIONS)
        ]
    )
    s = networks.withColumn("s", F.explode(base))
    net = F.col("net")
    lon = F.col("s.lon") + F.pmod(F.floor(net / 30), F.lit(120)) * 3
    return s.select(
        _station_name(F.col("s.sid"), net).alias("station_id"),
        "s.name",
        (F.col("s.lat") - F.pmod(net, F.lit(30)) * 2).alias("lat"),
        F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"),
        "s.elevation_m",
        F.split("s.sid", "-")[1].alias("county_code"),
        F.split("s.sid", "-")[0].alias("state_code"),
        "s.monitor_type",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, as a sensor reading before any deduplication."""
    ids = F.array(*[F.lit(s[0]) for s in BASE_STATIONS])
    k = F.get_json_object("props", "$.k").cast("int")
    kind = by_parameter(_EVENT_PARAMETER, F.col("event_type"))
    shaped = events(spark, sf_dir).select(
        "event_id",
        _station_name(F.get(ids, _site().cast("int")), _network()).alias("station_id"),
        kind.alias("parameter"),
        F.date_trunc("hour", F.col("ts")).alias("timestamp"),
        k.alias("k"),
        F.col("value").alias("measured"),
    )
    value = (
        F.when(F.col("k") < 3, -F.col("measured"))
        .when(F.col("k") == 3, F.col("measured") * 1000)
        .otherwise(F.col("measured") * by_parameter(_SCALE, F.col("parameter")))
    )
    return shaped.select(
        "event_id",
        "station_id",
        "parameter",
        value.alias("value"),
        by_parameter(model.UNITS, F.col("parameter")).alias("unit"),
        "timestamp",
        F.when(F.col("k") >= 95, 1).otherwise(0).alias("quality_flag"),
        (F.col("k") % 3 + 1).alias("poc"),
        "k",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest (poc, event_id) per (station, parameter, hour)."""
    best = first_by(
        raw_events(spark, sf_dir),
        list(model.READING_KEY),
        ["poc", "event_id"],
        ["value", "unit", "quality_flag"],
    )
    return best.select("station_id", "parameter", "value", "unit", "timestamp", "quality_flag")


def landed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider-shaped documents (``Data`` arrays of at most 500 sample rows), in the order of the events."""
    raw = raw_events(spark, sf_dir)
    part = F.split("station_id", "-", 3)
    k = F.col("k")
    row = F.struct(
        part[0].alias("state_code"),
        part[1].alias("county_code"),
        part[2].alias("site_number"),
        by_parameter(model.PARAMETER_CODES, F.col("parameter")).alias("parameter_code"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("poc")).cast("int").alias("poc"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("date_gmt"),
        F.date_format("timestamp", "HH:mm").alias("time_gmt"),
        F.when(k != 60, F.col("value")).alias("sample_measurement"),
        F.when(k == 50, "24 HOUR").otherwise("1 HOUR").alias("sample_duration"),
        F.when(k >= 95, "QX").when(k >= 90, "  ").when(k >= 85, "").alias("qualifier"),
    )
    return (
        raw.select(F.floor(F.col("event_id") / 500).alias("doc"), F.struct("event_id", row.alias("row")).alias("row"))
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list("row")).alias("Data"))
        .repartitionByRange("doc")
        .sortWithinPartitions("doc")
        .select(F.col("Data.row").alias("Data"))
    )


def landed_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instruments per station, one of them closed or out of the box at some sites."""
    site = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    number = F.split("station_id", "-", 3)
    instruments = stations(spark, sf_dir).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("poc"))
    fem = F.col("monitor_type") == "FEM"
    label = F.concat("name", F.when(F.col("poc") == 2, "-b").otherwise(""))
    row = F.struct(
        F.col("state_code"),
        F.col("county_code"),
        number[2].alias("site_number"),
        F.col("poc"),
        F.when((site == 9) & (F.col("poc") == 2), F.lit(None)).otherwise(F.col("lat")).alias("latitude"),
        F.col("lon").alias("longitude"),
        F.when(site != 15, F.col("elevation_m")).alias("elevation"),
        F.when((site == 5) & (F.col("poc") == 1), "2024-01-15").alias("close_date"),
        F.when(fem & (F.col("poc") == 2), "Continuous hourly").otherwise("DAILY").alias("collection_frequency"),
        F.when(site % 4 != 0, label).alias("local_site_name"),
        F.concat(F.lit("address "), label).alias("address"),
    )
    return (
        instruments.select("station_id", F.struct("poc", "station_id", row.alias("row")).alias("row"))
        .groupBy(F.substring("station_id", 1, 11).alias("doc"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("row.poc"), F.col("row.station_id"), F.col("row.row")))).alias("Data"))
        .select(F.col("Data.row").alias("Data"))
    )


def forecasts_from_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An independent set of forecast samples: 63 draws and an outcome per vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    horizon = F.get(F.array(*[F.lit(h) for h in model.HORIZONS]), (F.col("vec_id") % 4).cast("int"))
    base = vectors.select(
        F.lit("vector").alias("station_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("vec_id").cast("int"))).alias(
            "window_start"
        ),
        horizon.alias("horizon"),
        F.transform("embedding", lambda x: 20.0 + 40.0 * x.cast("double")).alias("xs"),
    )
    key = ["station_id", "window_start", "horizon"]
    samples = base.select(*key, F.posexplode(F.slice("xs", 1, 63)).alias("sample_id", "value"))
    actuals = base.select(*key, F.element_at("xs", 64).alias("actual"))
    return samples, actuals
