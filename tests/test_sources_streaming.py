"""Sources, sinks and the streaming forms against their batch results."""

import hashlib
import json
import math

from pyspark.sql import functions as F

from cantus.plans import q_story
from cantus.plans import views as V
from cantus.sources import files
from cantus.streaming import live

SF = "/root/testdata/sf0.001"


def test_json_and_frames(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"song_id": "x", "duration_s": 2.0}, "envelopes": {"hop_s": 0.5, "times_s": [0, 0.5], "loudness": [0.1, 0.2], "onset_strength": [1, 2]}, "extra": 1}, indent=2))
    df = files.read_json(spark, str(tmp_path / "a.json"), files.ANALYSIS)
    assert [tuple(r) for r in files.frames_of(df).collect()] == [("x", 0, 0.0, 0.1, 1.0), ("x", 1, 0.5, 0.2, 2.0)]
    (tmp_path / "b.json").write_text("{ broken")
    assert files.read_json(spark, str(tmp_path / "b.json"), files.ANALYSIS).first()["meta"] is None


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.MP3", "sub/a.wav", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = files.scan(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["b.MP3", "a.wav"]
    assert got[0]["song_id"] == hashlib.sha256(b"b.MP3").hexdigest()[:16]


def test_layer_overwrite(spark, tmp_path):
    path = str(tmp_path / "layers")
    make = lambda rows: spark.createDataFrame(rows, "track long, layer string, midi double")
    files.write_layer(make([(1, "bass", 40.0), (1, "vocals", 60.0)]), path)
    files.write_layer(make([(1, "bass", 41.0)]), path)
    assert sorted((r["layer"], r["midi"]) for r in spark.read.parquet(path).collect()) == [("bass", 41.0), ("vocals", 60.0)]


def test_names_and_cache(spark):
    df = spark.createDataFrame([("1", "Café / Été"), ("2", " Cafe \\ Ete "), ("3", ""), ("4", "x" * 200), ("5", "ﬁne №1 [live] (a):b?"), ("6", "Ơ Ǻ ß")], "song_id string, title string")
    got = dict(map(tuple, files.output_names(df).collect()))
    assert got == {"1": "Cafe - Ete__1", "2": "Cafe - Ete__2", "3": "song", "4": "x" * 96, "5": "fine No1 [live] (a)_b_", "6": "O A _"}
    r = spark.range(1).select(files.cache_compatible(F.lit(7), 7, (F.lit(None), F.lit(None))), files.cache_compatible(F.lit(6), 7), files.cache_compatible(F.lit(None).cast("int"), 7)).first()
    assert tuple(r) == (True, False, False)
    order = spark.range(1).select(files.backend_order(F.lit("auto"), F.array(F.lit("whisper"), F.lit("whisperx"))), files.backend_order(F.lit("auto"), F.array().cast("array<string>")), files.backend_order(F.lit("mine"), F.array(F.lit("whisper")))).first()
    assert [list(x) for x in order] == [["whisperx", "whisper"], ["whisper"], ["mine"]]


def test_cache_by_size_and_time(spark):
    work = spark.createDataFrame([("a", 5, 1.0), ("b", 5, 1.0), ("c", 5, 1.0), ("d", 5, 1.0)], "path string, size_bytes long, mtime double")
    done = spark.createDataFrame([("a", 5, 1.0, 9), ("b", 6, 1.0, 9), ("c", 5, 2.0, 9), ("d", 5, 1.0, 0)], "path string, size_bytes long, mtime double, n_bytes long")
    assert sorted(r["path"] for r in files.stale(work, done, ["path", "size_bytes", "mtime"]).collect()) == ["b", "c", "d"]


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_streams_equal_batches(spark):
    batch = V.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = live.read_events(spark, SF)
    assert same(live.drain(live.tumbling(stream), "s1", "complete"), live.tumbling(batch))
    assert same(live.drain(live.sliding(stream), "s2", "complete"), live.sliding(batch))
    assert same(live.drain(live.sessions(stream), "s3", "complete"), live.sessions(batch))


def test_stream_decay_equals_as_of(spark):
    got = {r["event_id"]: r["pulse"] for r in live.drain(live.decay(live.read_events(spark, SF)), "s4").collect()}
    rows = V.table(spark, SF, "events").select("user_id", "event_id", V.micros(F.col("ts")).alias("us"), "event_type").orderBy("user_id", "us").collect()
    last, track = None, None
    for r in rows:
        if r["user_id"] != track:
            last, track = None, r["user_id"]
        if r["event_type"] == "error":
            last = r["us"]
        want = 0.0 if last is None else math.exp(-(r["us"] - last) / 1e6 / 43200)
        assert abs(got[r["event_id"]] - want) < 2e-6
    assert len(got) == len(rows)


def test_stream_decay_keeps_its_rows_off_the_driver(spark, tmp_path):
    """The result is read from files, and a table of several files is read whole."""
    V.table(spark, SF, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    out = q_story.stream_decay(spark, str(tmp_path))
    assert out.inputFiles()
    assert same(out, q_story.stream_decay(spark, SF)) and out.count() == V.table(spark, SF, "events").count()


def test_tap_stream_equals_batch(spark):
    schema = "track long, event_id long, t double, key string"
    rows = [(1, 1, -1.0, " "), (1, 2, 0.5, " "), (1, 3, 1.0, "x"), (1, 4, 2.0, " "), (1, 5, 3.0, " "), (2, 1, 1.0, " "), (2, 2, 2.0, "q"), (2, 3, 3.0, " "), (3, 1, 9.0, " "), (3, 2, 11.0, " "), (4, 1, 1.0, " ")]
    songs = spark.createDataFrame([(1, 2, 10.0), (2, 9, 10.0), (3, 9, 10.0)], "track long, n_words int, duration_s double")
    keys = spark.createDataFrame(rows, schema)
    batch = live.capture_taps(keys, songs, 0.25)
    assert sorted(map(tuple, batch.collect())) == [(1, 1, 0.75), (1, 2, 2.25), (2, 1, 1.25), (3, 1, 9.25)]
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        keys.coalesce(1).write.mode("append").parquet(f"{d}/keys")
        stream = spark.readStream.schema(schema).parquet(f"{d}/keys")
        assert same(live.drain(live.tap_stream(stream, songs, 0.25), "taps"), batch)
