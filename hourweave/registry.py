"""Every query of the library on data derived from the driver tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourweave import fixtures, model
from hourweave.functions.columns import add_calendar, assign_split, finite, moment
from hourweave.operators import alerts, checks, drift
from hourweave.operators import forecasts as fc
from hourweave.operators.clean import build_stations, clean_samples
from hourweave.operators.conformal import apply_conformal, conformal_margins
from hourweave.operators.fill import fill_features, gap_runs
from hourweave.operators.grid import apply_validation, blocked_grid, hourly_grid, null_invalid, wide_readings
from hourweave.operators.impute import MEDIAN_MAX, linear_and_pending
from hourweave.operators.neighbors import neighbor_edges, neighbor_summary, top_neighbors
from hourweave.operators.ordered import dense_index
from hourweave.operators.rolling import add_rolling_lags
from hourweave.operators.spatial import add_spatial
from hourweave.operators.windows import (
    apply_scaler,
    fit_scaler,
    rolling_instances,
    series_dataset,
    training_windows,
    with_boundary,
)
from hourweave.plans.features import build_features, clean_values, imputed_grid
from hourweave.plans.forecasts import ensemble_tables, filled_target, split_bounds
from hourweave.plans.search import spatial_by_setting, spatial_param_search
from hourweave.session import scratch_path, use_utc, written
from hourweave.sources import landed, messages, tables
from hourweave.streaming import replay as replay_module
from hourweave.streaming import stream

NUDGE = 1.3e-8
FIRST_DAY, LAST_DAY = date(2024, 1, 1), date(2024, 1, 30)
SENSITIVITY = [(30.0, 55.4, 0.5), (40.0, 55.4, 0.5), (35.4, 50.0, 0.5), (35.4, 65.0, 0.5), (35.4, 55.4, 0.3)]
MEMBERS = 14


def tidy(df: DataFrame) -> DataFrame:
    """The comparable form: doubles to 6 places, naive timestamps.

    The nudge keeps exact decimal ties away from the rounding edge, where two
    engines may rightly differ.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c + NUDGE, 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- shared inputs ---------------------------------------------------------
# Readings, stations, edges and features are tables in the data model: written
# once per session and folder, then read by every query that starts from them.

_written: dict[tuple, DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        use_utc(spark)
        _written[key] = written(build(), name)
    return _written[key]


def readings(spark, d) -> DataFrame:
    return _table(spark, d, "readings", lambda: fixtures.readings(spark, d))


def stations(spark, d) -> DataFrame:
    return _table(spark, d, "stations", lambda: fixtures.stations(spark, d))


def edges(spark, d) -> DataFrame:
    return _table(spark, d, "edges", lambda: neighbor_edges(stations(spark, d)))


def processed(spark, d) -> DataFrame:
    return build_features(
        readings(spark, d), stations(spark, d), edges(spark, d), fixtures.TRAIN_END, fixtures.VAL_END
    )


def features(spark, d) -> DataFrame:
    return _table(spark, d, "features", lambda: processed(spark, d))


def filled(spark, d) -> DataFrame:
    return _table(spark, d, "filled", lambda: filled_target(features(spark, d)))


_last_hours: dict[tuple, datetime] = {}


def bounds(spark, d, period: str) -> tuple[datetime, datetime]:
    """First and last hour of a period; the test period ends where the feature table does."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _last_hours:
        text = features(spark, d).agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss")).head()[0]
        _last_hours[key] = datetime.fromisoformat(text)
    return split_bounds(fixtures.TRAIN_END, fixtures.VAL_END, _last_hours[key])[period]


def ensemble(spark, d, period: str) -> tuple[DataFrame, DataFrame]:
    return ensemble_tables(filled(spark, d), *bounds(spark, d, period), MEMBERS)


def scores(spark, d, period: str) -> DataFrame:
    return fc.sample_scores(*ensemble(spark, d, period))


def breaches(spark, d, period: str = "test") -> DataFrame:
    return alerts.breach_probability(ensemble(spark, d, period)[0])


# --- ingestion and validation ----------------------------------------------

def validated_readings(spark, d):
    return null_invalid(apply_validation(readings(spark, d)))


def q_clean_samples(spark, d):
    path = scratch_path(spark, "landed-samples")
    fixtures.landed_samples(spark, d).write.json(path)
    return clean_samples(landed.read_samples(spark, path), stations(spark, d))


def q_build_stations(spark, d):
    path = scratch_path(spark, "landed-monitors")
    fixtures.landed_monitors(spark, d).write.json(path)
    return build_stations(landed.read_monitors(spark, path))


def q_stations_csv(spark, d):
    path = scratch_path(spark, "stations-csv")
    tables.write_stations(stations(spark, d), path)
    return tables.read_stations(spark, path)


def q_insert_new(spark, d):
    """Readings with a flag meet a table that holds the unflagged ones."""
    path = tables.ensure_tables(spark, scratch_path(spark, "store"))[tables.READINGS]
    schema = tables.table_schemas()[tables.READINGS]
    r = readings(spark, d)
    tables.insert_new(r.where("quality_flag = 0"), path, model.READING_KEY, schema)
    return tables.insert_new(r, path, model.READING_KEY, schema).drop("ingested_at")


def q_insert_features(spark, d):
    """The feature table meets a table that holds its training rows."""
    path = tables.ensure_tables(spark, scratch_path(spark, "store"))[tables.FEATURES]
    f = features(spark, d)
    tables.insert_new(f.where("split = 'train'"), path, model.FEATURE_KEY, model.FEATURE_SCHEMA)
    return tables.insert_new(f, path, model.FEATURE_KEY, model.FEATURE_SCHEMA)


def q_readings_scan(spark, d):
    """A readings table with naive timestamps and further columns, as other writers leave it."""
    path = scratch_path(spark, "readings-table")
    stored = readings(spark, d).withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "ingested_at": F.current_timestamp()})
    stored.select("ingested_at", *reversed(model.READING_SCHEMA.names)).write.parquet(path)
    return tables.read_readings(spark, path)


def q_finite_values(spark, d):
    k, value = F.col("k"), F.col("value")
    bad = F.when(k == 7, float("nan")).when(k == 8, float("inf")).when(k == 9, float("-inf")).otherwise(value)
    return fixtures.raw_events(spark, d).select("event_id", finite(bad).alias("value"))


def q_sample_store(spark, d):
    path = scratch_path(spark, "samples")
    tables.write_samples(ensemble(spark, d, "test")[0], path)
    return tables.read_samples(spark, path)


def q_scaler_store(spark, d):
    path = scratch_path(spark, "scaler")
    tables.write_scaler(train_scaler(spark, d), path)
    return tables.read_scaler(spark, path)


def q_messages(spark, d):
    path = scratch_path(spark, "messages")
    sent = replay_module.replay_messages(apply_validation(readings(spark, d)))
    sent.select(F.col("value").cast("string")).write.text(path)
    return messages.from_message(spark.read.text(path))


def q_replay(spark, d):
    path = scratch_path(spark, "replay")

    def sink(batch):
        batch.select(F.col("key").cast("string"), F.col("value").cast("string")).write.mode("append").json(path)

    replay_module.replay(readings(spark, d), sink, "2024-01-05", "2024-01-24", slice_days=7)
    back = spark.read.schema("key string, value string").json(path)
    typed = messages.from_message(back)
    return typed


def q_date_range(spark, d):
    return tables.date_range(readings(spark, d), "2024-01-08", "2024-01-19")


# --- grid, imputation, features --------------------------------------------

def q_calendar_split(spark, d):
    hours = hourly_grid(clean_values(readings(spark, d))).select("station_id", "timestamp")
    return add_calendar(hours).withColumn(
        "split", assign_split(F.col("timestamp"), fixtures.TRAIN_END, fixtures.VAL_END)
    )


def q_impute_linear(spark, d):
    grid = blocked_grid(clean_values(readings(spark, d)), halo=MEDIAN_MAX)
    return linear_and_pending(grid)


def q_rolling_lags(spark, d):
    full = add_rolling_lags(imputed_grid(readings(spark, d)))
    return full.select("station_id", "timestamp", *model.ROLLING)


def q_spatial(spark, d):
    keep = [c for c in model.FEATURE_COLUMNS if c not in model.SPATIAL]
    base = features(spark, d).select(*keep)
    out = add_spatial(base, edges(spark, d), stations(spark, d))
    return out.select("station_id", "timestamp", *model.SPATIAL)


def q_neighbor_index(spark, d):
    return neighbor_edges(stations(spark, d)).select("station_id", "neighbor_id", "weight")


def q_neighbor_file(spark, d):
    path = scratch_path(spark, "neighbor-index")
    tables.write_edges(stations(spark, d), edges(spark, d), path)
    return tables.read_edges(spark, path)


# --- splits and windows ----------------------------------------------------

def q_split_scan(spark, d):
    path = scratch_path(spark, "features-by-split")
    tables.write_features(features(spark, d), path)
    return tables.read_split(spark, path, ["val", "test"], ["pm25", "pm25_roll6", "is_weekend"])


def val_with_boundary(spark, d):
    return with_boundary(features(spark, d), "val", "train", F.lit(fixtures.TRAIN_END))


def train_scaler(spark, d):
    return fit_scaler(features(spark, d).where("split = 'train'"))


def q_scaled(spark, d):
    rows = apply_scaler(val_with_boundary(spark, d), train_scaler(spark, d))
    return rows.select("station_id", "timestamp", *model.MODEL_INPUTS)


def q_training_windows(spark, d):
    wins = training_windows(val_with_boundary(spark, d), train_scaler(spark, d))
    flat = F.flatten("x")
    return wins.select(
        "station_id",
        "timestamp",
        F.size("x").alias("n_steps"),
        F.size(flat).alias("n_values"),
        F.aggregate(flat, F.lit(0.0), lambda a, v: a + v).alias("x_sum"),
        F.col("x")[0][0].alias("first_pm25"),
        F.element_at("x", -1)[0].alias("last_pm25"),
        F.element_at("x", -1)[20].alias("last_elev"),
        *[f"y{h}" for h in model.HORIZONS],
    )


FILL_COLUMNS = ("pm25", "no2", "pm25_lag24", "spatial_pm25_lag1", "is_weekend")


def q_filled_series(spark, d):
    base = features(spark, d).select("station_id", "timestamp", *FILL_COLUMNS, "split")
    return fill_features(base, list(FILL_COLUMNS))


def _filled_calendar(spark, d):
    return add_calendar(filled(spark, d))


def _total(c):
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)


def q_rolling_instances(spark, d):
    inst = rolling_instances(_filled_calendar(spark, d), *bounds(spark, d, "val"))
    return inst.select(
        "station_id",
        "station_ix",
        "window_start",
        "start",
        F.size("target").alias("n_target"),
        _total("target").alias("sum_target"),
        F.col("target")[0].alias("first_target"),
        F.col("target")[167].alias("last_target"),
        F.size("hour_of_day").alias("n_calendar"),
        _total("hour_of_day").alias("sum_hours"),
        _total("is_weekend").alias("sum_weekend"),
        _total("actuals").alias("sum_actuals"),
        *[F.col("actuals")[h - 1].alias(f"a{h}") for h in model.HORIZONS],
    )


def q_series_dataset(spark, d):
    until = datetime(2024, 1, 25, 23)
    parts = series_dataset(_filled_calendar(spark, d), until)
    return parts.groupBy("station_id", "station_ix").agg(
        F.min("start").alias("start"),
        F.sum(F.size("target")).alias("n"),
        F.sum(_total("target")).alias("sum_target"),
        F.sum(_total("day_of_week")).alias("sum_days"),
    )


def q_exclude_frm(spark, d):
    frm = stations(spark, d).where("monitor_type = 'FRM'")
    return tables.exclude_stations(features(spark, d).select("station_id", "timestamp", "pm25"), frm)


def q_encoder_context(spark, d):
    rows = features(spark, d).select("station_id", "timestamp", "pm25")
    return tables.encoder_context(rows, moment(bounds(spark, d, "test")[0]))


def q_history_merge(spark, d):
    r = readings(spark, d)
    late = r.where("quality_flag = 1").withColumn("value", F.col("value") + 1000.0)
    return stream.merge_history(r, late)


def q_history_lookup(spark, d):
    at = stations(spark, d).where("county_code = '071'")
    return stream.history_lookup(
        readings(spark, d), at, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    )


# --- forecasts -------------------------------------------------------------

def q_sample_quantiles(spark, d):
    return fc.sample_quantiles(ensemble(spark, d, "test")[0]).drop("xs")


def q_crps(spark, d):
    return fc.crps(*ensemble(spark, d, "test"))


def _median_forecast(spark, d):
    return fc.sample_quantiles(ensemble(spark, d, "test")[0]).select(*fc.KEY, F.col("p50").alias("predicted"))


def q_point_metrics(spark, d):
    return fc.evaluate_point(_median_forecast(spark, d), ensemble(spark, d, "test")[1])


def q_interval_metrics(spark, d):
    q = fc.sample_quantiles(ensemble(spark, d, "test")[0]).drop("xs")
    return fc.evaluate_quantiles(q, ensemble(spark, d, "test")[1])


def q_sample_metrics(spark, d):
    return fc.evaluate_samples(*ensemble(spark, d, "test"))


def q_vector_metrics(spark, d):
    return fc.evaluate_samples(*fixtures.forecasts_from_embeddings(spark, d))


def q_vector_margins(spark, d):
    return conformal_margins(fc.sample_scores(*fixtures.forecasts_from_embeddings(spark, d)))


def q_margins(spark, d):
    return conformal_margins(scores(spark, d, "val"))


def q_margins_file(spark, d):
    path = scratch_path(spark, "margins")
    tables.write_margins(q_margins(spark, d), path)
    return tables.read_margins(spark, path).select("horizon", "upper", "lower")


def q_conformal_metrics(spark, d):
    margins = written(q_margins(spark, d), "margins")
    return apply_conformal(*ensemble(spark, d, "test"), margins)


# --- alerts and drift ------------------------------------------------------

def q_risk_score(spark, d):
    return alerts.risk_score(breaches(spark, d))


def q_station_status(spark, d):
    return alerts.station_status(q_risk_score(spark, d))


def q_brier(spark, d):
    return alerts.brier(breaches(spark, d), ensemble(spark, d, "test")[1])


def q_alert_quality(spark, d):
    return alerts.alert_quality(breaches(spark, d), ensemble(spark, d, "test")[1])


def q_psi(spark, d):
    f = features(spark, d)
    return drift.psi(f.where("split = 'train'"), f.where("split = 'test'"))


def q_ks(spark, d):
    probs = drift.add_batch(breaches(spark, d), "window_start")
    return drift.ks_statistic(probs, "p_advisory")


def q_brier_drift(spark, d):
    test, outcomes = breaches(spark, d), ensemble(spark, d, "test")[1]
    per_batch = alerts.brier(drift.add_batch(test, "window_start"), outcomes, by=[F.col("batch")])
    val = alerts.brier(breaches(spark, d, "val"), ensemble(spark, d, "val")[1], by=[F.lit("val").alias("period")])
    return drift.brier_drift(per_batch, val)


def q_threshold_sensitivity(spark, d):
    return alerts.threshold_sensitivity(ensemble(spark, d, "test")[0], SENSITIVITY)


# --- quality checks --------------------------------------------------------

def _copies(df: DataFrame, days: list[int]) -> DataFrame:
    """The readings repeated at later dates, so that several months exist."""
    shift = F.explode(F.array(*[F.lit(n) for n in days])).alias("_days")
    moved = df.select("*", shift)
    return moved.withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(days="_days")).drop("_days")


def _raw(spark, d) -> DataFrame:
    names = [f.name for f in model.READING_SCHEMA.fields]
    return fixtures.raw_events(spark, d).select(*names)


QUALITY = {
    "qc_duplicate_keys": lambda s, d: checks.duplicate_keys(_raw(s, d)),
    "qc_key_counts": lambda s, d: checks.key_counts(_raw(s, d)),
    "qc_row_count": lambda s, d: checks.below_row_count(readings(s, d), 1_500_000),
    "qc_null_counts": lambda s, d: checks.null_counts(validated_readings(s, d)),
    "qc_unexpected_values": lambda s, d: checks.unexpected_values(
        _raw(s, d).withColumn("parameter", F.when(F.col("value") < 0, F.concat("parameter", F.lit("_neg"))).otherwise(F.col("parameter")))
    ),
    "qc_off_hour": lambda s, d: checks.off_hour_timestamps(
        fixtures.raw_events(s, d).select(
            "event_id", "station_id",
            (F.col("timestamp") + F.make_dt_interval(mins=F.when(F.col("k") == 7, 30).otherwise(0))).alias("timestamp"),
        )
    ),
    "qc_timestamp_range": lambda s, d: checks.timestamp_range(readings(s, d), FIRST_DAY, LAST_DAY),
    "qc_stations_missing": lambda s, d: checks.stations_without_readings(readings(s, d), stations(s, d)),
    "qc_stations_per_parameter": lambda s, d: checks.stations_per_parameter(readings(s, d)),
    "qc_too_few_stations": lambda s, d: checks.too_few_stations(readings(s, d), 1_000_000),
    "qc_incomplete": lambda s, d: checks.incomplete_stations(readings(s, d), "pm25", 95.0),
    "qc_low_coverage": lambda s, d: checks.low_coverage(readings(s, d), exclude=("06-059-2022",)),
    "qc_crowded_days": lambda s, d: checks.crowded_days(_raw(s, d), 6),
    "qc_low_months": lambda s, d: checks.low_months(
        _copies(readings(s, d), [0, 31, 60]), minimum=0.18, exclude=("06-059-2022",)
    ),
    "qc_silent_months": lambda s, d: checks.silent_months(_copies(readings(s, d), [0, 60])),
    "qc_implausible": lambda s, d: checks.implausible_values(readings(s, d)),
    "qc_implausible_counts": lambda s, d: checks.implausible_counts(readings(s, d)),
    "qc_percentile": lambda s, d: checks.high_percentile(readings(s, d)),
    "qc_parameter_max": lambda s, d: checks.parameter_maximum(readings(s, d)),
    "qc_wrong_units": lambda s, d: checks.wrong_units(
        readings(s, d).withColumn("unit", F.when(F.col("quality_flag") == 1, "ppb").otherwise(F.col("unit")))
    ),
    "qc_summary": lambda s, d: checks.check_summary(
        readings(s, d), stations(s, d), FIRST_DAY, LAST_DAY, 1_500_000, 14, ("06-059-2022",)
    ),
}


# --- streaming -------------------------------------------------------------

def _text(df: DataFrame) -> DataFrame:
    return messages.to_message(df).select(F.col("value").cast("string"))


def q_stream_features(spark, d):
    """Three stretches of messages, each read by a restarted stream, then the table.

    On the way are broken and incomplete messages, redelivered ones, values that are corrected by a later stretch, rows
    that come a stretch or two late, and stations that send nothing before the last stretch.
    """
    root, inbox = scratch_path(spark, "stream"), scratch_path(spark, "inbox")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    every = readings(spark, d)
    case = F.pmod(F.crc32(F.concat_ws("|", "station_id", "parameter", F.col("timestamp").cast("string"))), F.lit(40))
    new_station, value = F.col("station_id").like("06-111-%"), F.col("value")
    on_time, late, wrong, twice = ~new_station & (case != 0), ~new_station & (case == 0), case == 1, case == 2
    one, two, three = (tables.date_range(every, a, b) for a, b in (("2024-01-01", "2024-01-12"), ("2024-01-13", "2024-01-21"), ("2024-01-22", "2024-01-31")))
    sent = [
        one.where(on_time).withColumn("value", F.when(wrong, value + 50.0).otherwise(value)).unionByName(one.where(on_time & twice)),
        two.where(on_time).unionByName(one.where(on_time & (wrong | twice))),
        three.where(on_time).unionByName(every.where(late | new_station)),
    ]
    junk = spark.createDataFrame(
        [("{not json",), ('{"station_id": "06-037-1103", "parameter": "pm25", "value": 1.0}',), ('{"timestamp": "2024-01-02T03:00:00Z"}',)],
        "value string",
    )
    for part in sent:
        _text(part).unionByName(junk).write.mode("append").text(inbox)
        source = messages.from_message(messages.file_source(spark, inbox), order=messages.FILE_ORDER)
        query = stream.stream_features(
            source, root, stations(spark, d), edges(spark, d), checkpoint,
            train_end=fixtures.TRAIN_END, val_end=fixtures.VAL_END, trigger={"availableNow": True}, late="40 days",
        )
        query.awaitTermination()
    return stream.current_features(spark, root)


def q_distinct_messages(spark, d):
    """Two stretches of messages through the watermark: the second repeats rows of the first, and changes some of them;
    copies are dropped by their key or as too late, changed rows pass if they are not too late."""
    inbox, out, checkpoint = (scratch_path(spark, n) for n in ("inbox", "distinct", "distinct-checkpoint"))
    one, two = (tables.date_range(readings(spark, d), a, b) for a, b in (("2024-01-01", "2024-01-12"), ("2024-01-13", "2024-01-21")))
    some = one.where(F.hour("timestamp") % 5 == 0)
    sent = [one.unionByName(some), two.unionByName(some).unionByName(some.withColumn("value", F.col("value") + 1000.0))]
    for part in sent:
        _text(part).write.mode("append").text(inbox)
        rows = stream.distinct_messages(messages.from_message(messages.file_source(spark, inbox)), "48 hours")
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(model.READING_SCHEMA).parquet(out)


RAW_QUERIES = {
    "processed_features": processed,
    "validated_readings": validated_readings,
    "flag_counts": lambda s, d: checks.flag_counts(apply_validation(readings(s, d))),
    "completeness": lambda s, d: checks.completeness(readings(s, d)),
    "completeness_flagged": lambda s, d: checks.completeness_flagged(readings(s, d), threshold=95.0),
    "stage_counts": lambda s, d: checks.stage_counts(readings(s, d)),
    "extent": lambda s, d: checks.extent(readings(s, d)),
    "lowest_poc": fixtures.readings,
    "clean_samples": q_clean_samples,
    "build_stations": q_build_stations,
    "stations_csv": q_stations_csv,
    "insert_new": q_insert_new,
    "insert_features": q_insert_features,
    "readings_scan": q_readings_scan,
    "finite_values": q_finite_values,
    "sample_store": q_sample_store,
    "scaler_store": q_scaler_store,
    "distinct_messages": q_distinct_messages,
    "messages_roundtrip": q_messages,
    "replay": q_replay,
    "date_range": q_date_range,
    "wide_readings": lambda s, d: wide_readings(clean_values(readings(s, d))),
    "hourly_grid": lambda s, d: hourly_grid(clean_values(readings(s, d))),
    "calendar_split": q_calendar_split,
    "gap_runs": lambda s, d: gap_runs(hourly_grid(clean_values(readings(s, d)))),
    "impute_linear": q_impute_linear,
    "impute_full": lambda s, d: imputed_grid(readings(s, d)),
    "rolling_lags": q_rolling_lags,
    "neighbor_index": q_neighbor_index,
    "neighbor_index_file": q_neighbor_file,
    "neighbor_summary": lambda s, d: neighbor_summary(stations(s, d), edges(s, d)),
    "top_neighbors": lambda s, d: top_neighbors(edges(s, d)).drop("elev_gap"),
    "spatial_features": q_spatial,
    "spatial_by_setting": lambda s, d: spatial_by_setting(
        features(s, d), stations(s, d), [(0.0005, 30.0), (0.001, 50.0)]
    ).select("lam", "cutoff", "station_id", "timestamp", *model.SPATIAL),
    "param_search": lambda s, d: spatial_param_search(features(s, d), stations(s, d)),
    "split_scan": q_split_scan,
    "boundary_scan": lambda s, d: val_with_boundary(s, d).select("station_id", "timestamp", "pm25", "split"),
    "exclude_frm": q_exclude_frm,
    "encoder_context": q_encoder_context,
    "history_merge": q_history_merge,
    "history_lookup": q_history_lookup,
    "batch_hours": lambda s, d: stream.only_batch_hours(
        features(s, d).select("station_id", "timestamp", "pm25", "split"), readings(s, d).where("parameter = 'co'")
    ),
    "scaler": train_scaler,
    "scaled_features": q_scaled,
    "training_windows": q_training_windows,
    "filled_series": q_filled_series,
    "station_index": lambda s, d: dense_index(stations(s, d), "station_id"),
    "rolling_instances": q_rolling_instances,
    "series_dataset": q_series_dataset,
    "ensemble_samples": lambda s, d: ensemble(s, d, "test")[0],
    "window_actuals": lambda s, d: ensemble(s, d, "test")[1],
    "sample_quantiles": q_sample_quantiles,
    "crps": q_crps,
    "point_metrics": q_point_metrics,
    "interval_metrics": q_interval_metrics,
    "sample_metrics": q_sample_metrics,
    "vector_metrics": q_vector_metrics,
    "vector_margins": q_vector_margins,
    "conformal_margins": q_margins,
    "conformal_margins_file": q_margins_file,
    "conformal_metrics": q_conformal_metrics,
    "stream_features": q_stream_features,
    "breach_probability": breaches,
    "risk_score": q_risk_score,
    "station_status": q_station_status,
    "brier": q_brier,
    "alert_quality": q_alert_quality,
    "psi": q_psi,
    "ks": q_ks,
    "brier_drift": q_brier_drift,
    "threshold_sensitivity": q_threshold_sensitivity,
    **QUALITY,
}


def _comparable(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return tidy(build(spark, sf_dir))

    return run


QUERIES = {name: _comparable(build) for name, build in RAW_QUERIES.items()}
