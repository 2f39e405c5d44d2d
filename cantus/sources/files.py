"""Sources and sinks: nested JSON, content identities, name rules, manifests and layered tables."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANALYSIS = T.StructType([
    T.StructField("meta", T.StructType([T.StructField("song_id", T.StringType()), T.StructField("duration_s", T.DoubleType())])),
    T.StructField("beats", T.StructType([T.StructField("tempo_bpm", T.DoubleType()), T.StructField("beat_times_s", T.ArrayType(T.DoubleType()))])),
    T.StructField("envelopes", T.StructType([T.StructField("hop_s", T.DoubleType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("times_s", "loudness", "onset_strength")]])),
])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON under an explicit schema; a broken file gives nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def frames_of(analysis: DataFrame) -> DataFrame:
    """song_id, frame_idx, t, loudness, onset_strength from the parallel lists of analysis files."""
    e = F.arrays_zip("envelopes.times_s", "envelopes.loudness", "envelopes.onset_strength")
    return analysis.select("meta.song_id", F.posexplode(e).alias("frame_idx", "e")).select("song_id", "frame_idx", F.col("e.times_s").alias("t"), "e.loudness", "e.onset_strength")


def content_id(content: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a file's bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


# Extensions of films.
FILMS = [".mp4", ".mov", ".mkv", ".avi", ".webm"]
AUDIO = ["mp3", "wav", "flac", "ogg", "m4a", "aac"]


def scan(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """path, length and song_id of the files with one of the extensions, recursively, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(ext.isin(extensions or AUDIO)).select("path", "length", content_id(F.col("content")).alias("song_id")).orderBy("path")


# Drum notes of the General MIDI map by component.
GM_DRUMS = {35: "kick", 36: "kick", 38: "snare", 40: "snare", 42: "hh", 44: "hh", 46: "hh", 41: "toms", 43: "toms", 45: "toms", 47: "toms", 48: "toms", 51: "ride", 59: "ride", 49: "crash", 57: "crash"}


def gm_component(note: Column) -> Column:
    """Drum component of a General MIDI note, kick for unknown ones."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in GM_DRUMS.items() for x in kv])[note], F.lit("kick"))


@F.arrow_udf(T.StringType())
def unaccented(names: pa.Array) -> pa.Array:
    """Texts in compatibility decomposition without combining marks."""
    plain = lambda s: s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return pa.array([plain(s) for s in names.to_pylist()], pa.string())


def safe_name(name: Column, longest: int = 96) -> Column:
    """A folder name: letters, digits, underscores, dots, dashes, brackets and spaces; slashes are dashes, runs of anything else one underscore.

    Letters lose their accents by compatibility decomposition, which Spark has
    no function for, so an Arrow function does it.  An empty name is ``song``.
    """
    dashed = F.regexp_replace(unaccented(F.trim(F.coalesce(name, F.lit("")))), r"[/\\]", "-")
    clean = F.trim(F.regexp_replace(F.regexp_replace(dashed, r"[^A-Za-z0-9_ .()\[\]-]+", "_"), r"\s+", " "))
    cut = F.rtrim(F.substring(clean, 1, longest))
    return F.when(cut == "", F.lit("song")).otherwise(cut)


def output_names(songs: DataFrame) -> DataFrame:
    """song_id, title -> song_id, dir: the safe name, with the id behind it where songs share one."""
    from pyspark.sql import Window

    named = songs.withColumn("base", safe_name(F.col("title")))
    shared = F.count("*").over(Window.partitionBy("base"))
    return named.select("song_id", F.when(shared > 1, F.concat("base", F.lit("__"), "song_id")).otherwise(F.col("base")).alias("dir"))


def stale(work: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without an entry in the manifest that agrees in all of ``keys`` and isn't empty."""
    good = manifest.filter("n_bytes > 0").select(*keys).distinct()
    return work.join(good, keys, "left_anti")


def cache_compatible(version: Column, least: int, *equal: tuple[Column, Column]) -> Column:
    """Whether a cached result may be used: recent enough, and the same in each pair (null equals null)."""
    ok = F.coalesce(version >= least, F.lit(False))
    for a, b in equal:
        ok = ok & a.eqNullSafe(b)
    return ok


def tidy_plan(listing: DataFrame) -> DataFrame:
    """Where each entry (path, name, is_dir, has_analysis) of an output folder goes: skip (it stays), legacy, export or scratch.

    Dot entries stay.  Folders are legacy if named by a content id or if they
    hold an analysis file themselves (has_analysis), else they stay.  Films are
    exports, all other files scratch.
    """
    old = F.col("name").rlike(r"^[0-9a-f]{16}$") | F.coalesce("has_analysis", F.lit(False))
    film = F.lower(F.regexp_extract("name", r".(\.[^.]*)$", 1)).isin(FILMS)
    kind = F.when(F.col("name").startswith("."), "skip").when(F.col("is_dir"), F.when(old, "legacy").otherwise("skip")).when(film, "export").otherwise("scratch")
    return listing.select("path", "name", kind.alias("action"))


def write_layer(rows: DataFrame, path: str) -> None:
    """Writes rows of (track, layer, ...) and replaces just the partitions that they touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track", "layer").parquet(path)


def backend_order(requested: Column, available: Column) -> Column:
    """Backends to try: the one that is asked for, or for ``auto`` the available of the known ones, else whisper."""
    known = F.filter(F.array(F.lit("whisperx"), F.lit("stable_whisper"), F.lit("whisper")), lambda b: F.array_contains(available, b))
    auto = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("whisper")))
    return F.when(requested == "auto", auto).otherwise(F.array(requested))
