from datetime import date

import pytest
from pyspark.sql import functions as F

from hourweave import fixtures, model
from hourweave.operators.neighbors import neighbor_edges
from hourweave.plans.features import build_features
from hourweave.sources import messages
from hourweave.streaming import stream
from hourweave.streaming.replay import replay
from tests.helpers import gappy, readings_frame
from tests.test_neighbors import station_frame

ENDS = (date(2024, 1, 20), date(2024, 1, 25))
NAMES = ["06-037-1103", "06-037-1302", "06-037-1602", "06-037-9035"]


@pytest.fixture(scope="module")
def world(spark):
    stations = station_frame(spark, [s[:4] for s in fixtures.BASE_STATIONS if s[0] in NAMES]).cache()
    edges = neighbor_edges(stations).cache()
    rows = []
    for i, s in enumerate(NAMES):
        for j, p in enumerate(("pm25", "no2", "o3")):
            scale = 0.001 if p == "o3" else 1.0
            rows += [(s, p, v * scale, h) for h, v in enumerate(gappy(10 * i + j, 24 * 24)) if v is not None]
    return stations, edges, rows


def as_rows(df):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[d.pop("station_id"), d.pop("timestamp")] = {
            k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in d.items()
        }
    return out


def run(spark, inbox, root, world, tmp):
    source = messages.from_message(messages.file_source(spark, str(inbox)), order=messages.FILE_ORDER)
    sent = str(tmp / "out")
    q = stream.stream_features(
        source, str(root), world[0], world[1], str(tmp / "ckpt"),
        sink=lambda m: m.select(F.col("key").cast("string"), F.col("value").cast("string")).write.mode("append").json(sent),
        train_end=ENDS[0], val_end=ENDS[1], trigger={"availableNow": True},
    )
    q.awaitTermination()
    return sent


def test_stream_equals_batch_with_gaps_duplicates_late_rows_and_junk(spark, world, tmp_path):
    stations, edges, rows = world
    inbox, root = tmp_path / "in", tmp_path / "state"
    late = [r for r in rows if r[0] == NAMES[1] and r[1] == "pm25" and 250 <= r[3] < 262]
    fixed = [(s, p, v + 1.0, h) for s, p, v, h in rows if s == NAMES[0] and p == "pm25" and 300 <= h < 304]
    silent = [r for r in rows if r[0] == NAMES[2] and 200 <= r[3] < 420]  # never arrives
    live = [r for r in rows if r not in late and r not in silent]
    batches = [
        [r for r in live if r[3] < 230],
        [r for r in live if 230 <= r[3] < 400],
        [r for r in live if r[3] >= 400] + late + fixed,
    ]
    for batch in batches:
        body = messages.to_message(readings_frame(spark, batch)).select(F.col("value").cast("string"))
        junk = spark.createDataFrame([("{broken",), ("[1, 2]",), ('{"value": 3}',)], "value string")
        body.union(junk).coalesce(2).write.mode("append").text(str(inbox))
        sent = run(spark, inbox, root, world, tmp_path)
    replaced = {(s, p, h): v for s, p, v, h in fixed}
    final = [(s, p, replaced.get((s, p, h), v), h) for s, p, v, h in rows if (s, p, v, h) not in silent]
    want = build_features(readings_frame(spark, final), stations, edges, *ENDS)
    got = stream.current_features(spark, str(root))
    a, b = as_rows(got), as_rows(want)
    assert a.keys() == b.keys()
    assert all(a[k] == {c: getattr(v, "expected", v) for c, v in b[k].items()} for k in b)
    # the emitted messages carry the same rows, keyed by station
    out = spark.read.schema("key string, value string").json(sent)
    typed = messages.from_message(out, model.FEATURE_SCHEMA)
    assert typed.select("station_id", "timestamp").distinct().count() == len(b)
    assert {r.key for r in out.select("key").distinct().collect()} == set(NAMES)
    assert spark.read.schema("key string, value string").json(sent).where("value like '%NaN%'").count() == 0

    # a retried batch overwrites itself
    again = readings_frame(spark, batches[2])
    stream.process_batch(again, 2, str(root), stations, edges, *ENDS)
    assert stream.current_features(spark, str(root)).count() == len(b)

    # compaction keeps the current rows
    stream.compact(spark, str(root), str(tmp_path / "compact"))
    assert stream.current_features(spark, str(tmp_path / "compact")).count() == len(b)


def test_empty_batch_is_a_no_op(spark, world, tmp_path):
    stream.process_batch(readings_frame(spark, []), 0, str(tmp_path), world[0], world[1], *ENDS)
    assert stream.current_features(spark, str(tmp_path)).count() == 0


def test_message_round_trip(spark):
    r = readings_frame(spark, [("a", "pm25", float("nan"), 0), ("a", "co", 1.5, 1, 2), ("b", "o3", None, 2)])
    sent = messages.to_message(r)
    assert {bytes(x.key) for x in sent.collect()} == {b"a", b"b"}
    text = [bytes(x.value).decode() for x in sent.collect()]
    assert '"value":null' in text[0] and '"timestamp":"2024-01-01T00:00:00Z"' in text[0]
    back = messages.from_message(sent).orderBy("timestamp").collect()
    assert [x.value for x in back] == [None, 1.5, None] and back[1].quality_flag == 2


def test_replay_sends_slices_in_order(spark, world):
    stations, edges, rows = world
    sent = []
    n = replay(readings_frame(spark, rows), lambda m: sent.append(m.select(F.col("value").cast("string")).collect()),
               "2024-01-03", "2024-01-12", slice_days=4)
    assert len(sent) == 3 and n == sum(map(len, sent))
    days = [sorted({r.value.split('"timestamp":"')[1][:10] for r in part}) for part in sent]
    assert days[0][0] == "2024-01-03" and days[-1][-1] == "2024-01-12"
    assert days[0][-1] < days[1][0] and days[1][-1] < days[2][0]
    per_station = {}
    for part in sent:
        for r in part:
            sid = r.value.split('"station_id":"')[1][:11]
            per_station.setdefault(sid, []).append(r.value.split('"timestamp":"')[1][:13])
    assert all(v == sorted(v) for v in per_station.values())


def test_incomplete_messages_are_rejected_and_do_not_stop_the_stream(spark, world, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "state"
    lines = [
        '{"station_id": "%s", "parameter": "pm25", "value": 1.0}' % NAMES[0],
        '{"station_id": "%s", "timestamp": "2024-01-02T03:00:00Z", "value": 1.0}' % NAMES[0],
        '{"station_id": "%s", "parameter": "pm25", "timestamp": "soon", "value": 1.0}' % NAMES[0],
        "{broken",
    ]
    sent = spark.createDataFrame([(x,) for x in lines], "value string")
    assert messages.from_message(sent).count() == 0
    assert sorted(r.value for r in messages.rejected(sent).collect()) == sorted(lines)
    sent.write.text(str(inbox))
    run(spark, inbox, root, world, tmp_path)
    assert stream.current_readings(spark, str(root)).count() == 0


def test_the_last_message_of_a_batch_wins(spark):
    sent = [(f'{{"station_id": "s", "parameter": "pm25", "timestamp": "2024-01-02T03:00:00Z", "value": {v}}}', n) for n, v in enumerate((7.0, 10.0, 4.0))]
    source = spark.createDataFrame(sent, "value string, offset bigint")
    typed = messages.from_message(source.orderBy(F.desc("offset")), order=("offset",))
    assert [r.value for r in stream._deduplicated(typed).collect()] == [4.0]
    in_place = messages.from_message(spark.createDataFrame([(v,) for v, _ in sent], "value string").coalesce(1))
    assert [r.value for r in stream._deduplicated(in_place).collect()] == [4.0]


def test_one_late_row_reopens_only_its_neighbourhood(spark, tmp_path):
    """Stations far apart: a row that comes weeks late rewrites its own station and those that listen to it."""
    places = [("near-a", 34.0, -118.0, 0.0), ("near-b", 34.05, -118.0, 50.0), ("far-c", 36.0, -120.0, 0.0), ("far-d", 36.05, -120.0, 9.0)]
    stations = station_frame(spark, places).cache()
    edges = neighbor_edges(stations).cache()
    rows = [(s[0], "pm25", float(h % 24 + i), h) for i, s in enumerate(places) for h in range(24 * 40)]
    late = ("near-a", "pm25", 99.0, 50)
    root = str(tmp_path)
    stream.process_batch(readings_frame(spark, [r for r in rows if r[3] < 900 and (r[0], r[3]) != ("near-a", 50)]), 0, root, stations, edges, *ENDS)
    stream.process_batch(readings_frame(spark, [r for r in rows if r[3] >= 900] + [late]), 1, root, stations, edges, *ENDS)
    sent = stream.StreamState(spark, root).features
    rewritten = sent._open([(2, d) for d, n in sent.segments().items() if 2 in n])
    hours = {r.station_id: r.n for r in rewritten.groupBy("station_id").agg(F.count("*").alias("n")).collect()}
    assert hours == {"near-a": 24 * 40 - 25, "near-b": 24 * 40 - 25, "far-c": 60 + 25, "far-d": 60 + 25}
    final = [r for r in rows if (r[0], r[3]) != ("near-a", 50)] + [late]
    want = as_rows(build_features(readings_frame(spark, final), stations, edges, *ENDS))
    got = as_rows(stream.current_features(spark, root))
    assert got.keys() == want.keys()
    assert all(got[k] == {c: getattr(v, "expected", v) for c, v in want[k].items()} for k in want)


def test_a_station_that_starts_last_reaches_all_hours_of_its_listeners(spark, world, tmp_path):
    stations, edges, rows = world
    newcomer = NAMES[2]
    root = str(tmp_path)
    stream.process_batch(readings_frame(spark, [r for r in rows if r[0] != newcomer and r[3] < 300]), 0, root, stations, edges, *ENDS)
    last = [r for r in rows if r[3] >= 300]
    stream.process_batch(readings_frame(spark, last), 1, root, stations, edges, *ENDS)
    final = [r for r in rows if r[0] != newcomer or r[3] >= 300]
    want = as_rows(build_features(readings_frame(spark, final), stations, edges, *ENDS))
    got = as_rows(stream.current_features(spark, root))
    assert got.keys() == want.keys()
    assert all(got[k] == {c: getattr(v, "expected", v) for c, v in want[k].items()} for k in want)


def test_logs_open_only_days_in_reach_and_merge_themselves(spark, world, tmp_path):
    stations, edges, rows = world
    root = str(tmp_path)
    part = lambda nr: readings_frame(spark, [r for r in rows if r[3] % 4 == nr % 4 and r[3] < 24 * 18])
    for nr in range(4):  # every batch has rows of all days
        stream.process_batch(part(nr), nr, root, stations, edges, *ENDS)
    state = stream.StreamState(spark, root)
    before = as_rows(stream.current_features(spark, root))
    opened = state.features.read(3, "2024-01-15").inputFiles()
    assert opened and all(f.split("day=")[1][:10] >= "2024-01-15" for f in opened)
    most = max(map(len, state.features.segments().values()))
    assert most > 2
    assert state.features.compact(3, 2) > 0 and state.features.compact(3, 2) == 0
    assert as_rows(stream.current_features(spark, root)) == {
        k: {c: getattr(v, "expected", v) for c, v in r.items()} for k, r in before.items()
    }
    assert all(n[-1] == 7 for n in state.features._live(None, None).values() if len(n) == 1)
    # a torn segment is not read
    (tmp_path / "features_log" / "segment=9" / "day=2024-01-03").mkdir(parents=True)
    assert 9 not in state.features.segments()["2024-01-03"]
    # a further merge deletes what the first one replaced
    stream.process_batch(part(0), 5, root, stations, edges, *ENDS)
    assert state.features.compact(5, 1) > 0
    assert min(state.features.segments()["2024-01-05"]) == 7


def test_redelivered_and_too_late_messages(spark, tmp_path):
    def send(name, rows):
        messages.to_message(readings_frame(spark, rows)).select(F.col("value").cast("string")).coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        source = messages.from_message(messages.file_source(spark, str(tmp_path / "in")))
        query = stream.distinct_messages(source, "48 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()

    send(0, [("a", "pm25", 1.0, 100), ("a", "pm25", 1.0, 100), ("a", "pm25", 1.0, 70)])
    send(1, [("a", "pm25", 1.0, 100), ("a", "pm25", 2.0, 100), ("a", "pm25", 1.0, 60), ("a", "pm25", 1.0, 51), ("b", "o3", 1.0, 140)])
    send(2, [("a", "pm25", 1.0, 100), ("a", "pm25", 5.0, 95), ("a", "pm25", 5.0, 91), ("b", "o3", 1.0, 140)])
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    first = min(r.timestamp for r in got)
    # hours 51 (before 100 - 48) and 91 (before 140 - 48) came too late
    assert sorted((r.station_id, (r.timestamp - first).total_seconds() / 3600 + 60, r.value) for r in got) == [
        ("a", 60, 1.0), ("a", 70, 1.0), ("a", 95, 5.0), ("a", 100, 1.0), ("a", 100, 2.0), ("b", 140, 1.0)
    ]
