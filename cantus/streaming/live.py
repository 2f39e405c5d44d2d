"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Counts and value sums by event type in tumbling windows; events later than ``late`` are left out in a stream."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "1 hour", width: str = "12 hours", step: str = "6 hours") -> DataFrame:
    """The largest value in sliding windows by track."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), F.col("user_id").alias("track"))
    return g.agg(F.max("value").alias("peak")).select(F.col("window.start").alias("start"), "track", "peak")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "8 hours") -> DataFrame:
    """Sessions of each track: runs of events with less than ``gap`` between them."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col("user_id").alias("track"))
    return g.agg(F.count("*").alias("n")).select("track", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def decay(events: DataFrame, seconds: float = 43200.0) -> DataFrame:
    """For each event of a track the decay since its last error event; state is the time of that event.

    The stream's form of the backward as-of join: rows of a batch are taken
    in time order, and state lasts over batches.
    """
    schema = "track long, event_id long, pulse double"

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for i, us, kind in rows[["event_id", "us", "event_type"]].itertuples(index=False):
            if kind == "error":
                last = int(us)
            out.append((key[0], i, 0.0 if last is None else round(float(2.718281828459045 ** (-(us - last) / 1e6 / seconds)), 6)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["track", "event_id", "pulse"])

    rows = events.select(F.col("user_id").alias("track"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    return rows.groupBy("track").applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def capture_taps(keys: DataFrame, songs: DataFrame, offset: float = 0.0) -> DataFrame:
    """Taps of each song's session: track, i (from 1), t with ``offset`` added.

    keys: track, event_id, t (seconds since the song began to play), key.  songs:
    track, n_words, duration_s.  A space is a tap; ``q`` ends the session, as do
    the song's end and a tap for each of its words.  Other keys do nothing.
    """
    order = Window.partitionBy("track").orderBy("t", "event_id")
    k = keys.join(songs, "track").filter((F.col("t") >= 0) & (F.col("t") < F.col("duration_s")))
    k = k.withColumn("quit", F.max((F.col("key") == "q").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taps = k.filter("quit = 0 AND key = ' '").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= F.col("n_words"))
    return taps.select("track", "i", (F.col("t") + offset).alias("t"))


def tap_stream(keys: DataFrame, songs: DataFrame, offset: float = 0.0) -> DataFrame:
    """capture_taps over a stream of keys: a tap is emitted in the batch in which it comes.

    State is how many taps a session has and whether it has ended; keys of a
    batch are taken in the order of t.
    """
    kind = keys.schema["track"].dataType.simpleString()

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ended = state.get if state.exists else (0, False)
        rows, out = pd.concat(list(batches)).sort_values(["t", "event_id"]), []
        for t, pressed, words, duration in rows[["t", "key", "n_words", "duration_s"]].itertuples(index=False):
            ended = ended or pressed == "q" or n >= words or t >= duration
            if not ended and t >= 0 and pressed == " ":
                n += 1
                out.append((key[0], n, t + offset))
        state.update((n, bool(ended)))
        yield pd.DataFrame(out, columns=["track", "i", "t"])

    return keys.join(songs, "track").groupBy("track").applyInPandasWithState(run, f"track {kind}, i int, t double", "n int, ended boolean", "append", GroupStateTimeout.NoTimeout)


def _shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, else in the warehouse; a folder of its own with a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="cantus-stream-")
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def drain_to_table(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is available and returns its result as files in a shared folder, which no driver holds; for results of any size."""
    spark = stream.sparkSession
    folder = _shared_dir(spark)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available and returns its result as a table of the session; for tests and small results."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def read_events(spark, sf_dir: str) -> DataFrame:
    """The event table, a file or a folder of files, as a stream, its times as UTC timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the path of one file isn't taken
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
