"""Views of notes, hits, frames, sections, words and beats over the star-schema tables.

Each view exists twice: as a DataFrame builder here, and as DuckDB SQL in
``SQL`` for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


EPOCH_2024 = 1704067200000000
SECTIONS, SECTION_S = 12, 60.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, event_id, onset_s, k, event_type, value."""
    e = table(spark, sf_dir, "events")
    onset = (micros(F.col("ts")) - F.lit(EPOCH_2024)) / F.lit(3.6e9)
    return e.select(F.col("user_id").alias("track"), "event_id", onset.alias("onset_s"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", "value")


def layer_of(event_type: Column) -> Column:
    return F.when(event_type.isin("click", "view"), "vocals").when(event_type.isin("purchase", "signup"), "bass").otherwise("drums")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, note_id, onset_s, offset_s, midi, velocity, layer."""
    e = events(spark, sf_dir)
    cap = e.groupBy("track").agg(quantile("value", 0.99).alias("cap"))
    return e.join(cap, "track").select(
        "track", F.col("event_id").alias("note_id"), "onset_s", (F.col("onset_s") + 0.5 + F.col("k") % 10).alias("offset_s"), (F.lit(28.0) + F.col("k") % 60).alias("midi"),
        F.least(F.lit(1.0), F.col("value") / F.col("cap")).alias("velocity"), layer_of(F.col("event_type")).alias("layer"),
    )


# Which event stands for which drum component.
COMPONENTS = {"click": "kick", "view": "snare", "error": "hh", "purchase": "toms", "signup": "ride"}


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, hit_id, t, component, velocity."""
    e = events(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv])
    return e.select("track", F.col("event_id").alias("hit_id"), F.col("onset_s").alias("t"), names[F.col("event_type")].alias("component"), F.col("value").alias("velocity"))


def activity(tracks: DataFrame) -> DataFrame:
    """Twelve half-open sections of 60 s for each track: track, idx, start_s, end_s, active, label."""
    idx = F.col("idx")
    return tracks.select("track").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS - 1)))).select(
        "track", "idx", (idx * SECTION_S).alias("start_s"), (idx * SECTION_S + SECTION_S).alias("end_s"), (idx % 4 != 0).alias("active"), F.char(F.lit(65) + idx).alias("label")
    )


HOP_S = 0.5


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame_idx, t, rms, onset, centroid: line items of a supplier in time order."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    f = table(spark, sf_dir, "lineitem").withColumn("frame_idx", F.row_number().over(order) - 1)
    return f.select(F.col("l_suppkey").alias("track"), "frame_idx", (F.col("frame_idx") * HOP_S).alias("t"), F.col("l_extendedprice").alias("rms"), F.col("l_quantity").alias("onset"), F.col("l_discount").alias("centroid"))


def beats(tracks: DataFrame, n: int = 720) -> DataFrame:
    """One beat a second: track, beat_idx, t."""
    return tracks.select("track").distinct().withColumn("beat_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("beat_idx").cast("double"))


def beat_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beat_idx, vec (34 doubles): MFCC 0-19, chroma 20-31, energy 32-33."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("beat_idx"), F.slice(F.col("embedding").cast("array<double>"), 1, 34).alias("vec"))


def lyric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song, line_idx, text, start_s, end_s."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("song"), F.col("turn").alias("line_idx"), "text", (F.col("turn") * 5.0).alias("start_s"), (F.col("turn") * 5.0 + 5.0).alias("end_s"))


_P = "'2024-01-01'"
SQL = {
    "ev": f"""SELECT user_id AS track, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP {_P})) / 3.6e9::DOUBLE AS onset_s,
        CAST(props->>'$.k' AS INTEGER) AS k, event_type, value FROM events""",
    "notes": """SELECT track, event_id AS note_id, onset_s, onset_s + 0.5::DOUBLE + (k % 10) AS offset_s, 28.0::DOUBLE + (k % 60) AS midi,
        least(1.0::DOUBLE, value / quantile_cont(value, 0.99) OVER (PARTITION BY track)) AS velocity,
        CASE WHEN event_type IN ('click', 'view') THEN 'vocals' WHEN event_type IN ('purchase', 'signup') THEN 'bass' ELSE 'drums' END AS layer FROM ev""",
    "hits": """SELECT track, event_id AS hit_id, onset_s AS t, CASE event_type WHEN 'click' THEN 'kick' WHEN 'view' THEN 'snare' WHEN 'error' THEN 'hh'
        WHEN 'purchase' THEN 'toms' ELSE 'ride' END AS component, value AS velocity FROM ev""",
    "activity": """SELECT track, idx::INTEGER AS idx, idx * 60.0::DOUBLE AS start_s, idx * 60.0::DOUBLE + 60.0::DOUBLE AS end_s, idx % 4 <> 0 AS active, chr((65 + idx)::INTEGER) AS label
        FROM (SELECT DISTINCT track FROM ev), range(12) r(idx)""",
    "frames": """SELECT l_suppkey AS track, frame_idx, frame_idx * 0.5::DOUBLE AS t, l_extendedprice AS rms, l_quantity AS onset, l_discount AS centroid FROM (
        SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1)::INTEGER AS frame_idx FROM lineitem)""",
    "beats": "SELECT track, i::INTEGER AS beat_idx, i::DOUBLE AS t FROM (SELECT DISTINCT track FROM ev), range(720) r(i)",
    "beat_vectors": "SELECT vec_id AS beat_idx, list_transform(embedding[1:34], lambda x: x::DOUBLE) AS vec FROM embeddings",
    "lines": "SELECT conv_id AS song, turn AS line_idx, text, turn * 5.0::DOUBLE AS start_s, turn * 5.0::DOUBLE + 5.0::DOUBLE AS end_s FROM conversations",
}
_NEEDS = {"notes": ["ev"], "hits": ["ev"], "activity": ["ev"], "beats": ["ev"]}


def with_views(body: str, *names: str, more: str = "") -> str:
    """DuckDB SQL with the named views, and those that they need, in front; ``more``: further CTEs."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + ([more] if more else [])
    joint = ", " if body.startswith("WITH ") else ""  # a body may go on with CTEs of its own
    return "WITH " + ",\n".join(ctes) + "\n" + joint + body.removeprefix("WITH ")
