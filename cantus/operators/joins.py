"""Interval, as-of and nearest joins as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, t: str, bucket_s: float, how: str = "inner", lo: str = "start_s", hi: str = "end_s") -> DataFrame:
    """Rows of ``points`` with each half-open interval of their track that holds them.

    Intervals are exploded to the buckets that they touch and joined on track
    and bucket; a point is in just one bucket, so no pair comes twice.
    """
    bucket = lambda c: F.floor(c / bucket_s).cast("long")
    spread = intervals.filter(F.col(lo) < F.col(hi)).withColumn("__b", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    p, i = points.withColumn("__b", bucket(F.col(t))).alias("p"), spread.alias("i")
    on = (F.col("p.track") == F.col("i.track")) & (F.col("p.__b") == F.col("i.__b")) & (F.col(f"p.{t}") >= F.col(f"i.{lo}")) & (F.col(f"p.{t}") < F.col(f"i.{hi}"))
    joined = p.join(i, on, how)
    mine = [F.col(f"p.{c}") for c in points.columns]
    return joined.select(*mine, *[F.col(f"i.{c}") for c in intervals.columns if c not in points.columns])


def count_in(intervals: DataFrame, points: DataFrame, t: str, bucket_s: float) -> DataFrame:
    """Every interval with the number of points in it, ``n``, also where that is 0; keyed by track and idx."""
    inside = interval_join(points.select("track", F.col(t).alias("__t")), intervals, "__t", bucket_s)
    n = inside.groupBy("track", "idx").agg(F.count("*").alias("n"))
    return intervals.join(n, ["track", "idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def as_of(points: DataFrame, refs: DataFrame, t: str, ref_t: str, out: str = "ref", forward: bool = False, inclusive: bool = True) -> DataFrame:
    """Adds the last reference at or before each point (or the first at or after it): column ``out``, null if none."""
    side = 0 if inclusive != forward else 2
    both = points.select("*", F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__ref")).unionByName(
        refs.select("track", F.col(ref_t).alias("__t"), F.lit(side).alias("__side"), F.col(ref_t).alias("__ref")), allowMissingColumns=True
    )
    w = Window.partitionBy("track").orderBy("__t", "__side")
    if forward:  # from the end: a frame that begins at the current row would be read anew for each row
        w = Window.partitionBy("track").orderBy(F.desc("__t"), F.desc("__side"))
    found = F.last("__ref", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(out, found).filter("__side = 1").drop("__t", "__side", "__ref")


def around(points: DataFrame, refs: DataFrame, t: str, ref_t: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``before`` and ``after``: the last reference at or before each point and the first at or after it, as structs of t and the columns ``keep``.

    Null where there is none.  Of references at one time the greatest counts, so
    repeats don't multiply points.  Both directions are windows over one union:
    references are shuffled once and nothing is joined again.
    """
    kind = F.struct(F.col(ref_t).alias("t"), *keep)
    marks = refs.select("track", F.col(ref_t).alias("__t"), F.lit(0).alias("__side"), kind.alias("__ref"))
    both = marks.unionByName(points.select("*", F.col(t).alias("__t"), F.lit(1).alias("__side")), allowMissingColumns=True)
    so_far = lambda order: F.last("__ref", ignorenulls=True).over(Window.partitionBy("track").orderBy(order, "__side", "__ref").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"before": so_far(F.asc("__t")), "after": so_far(F.desc("__t"))})
    return found.filter("__side = 1").select(*points.columns, "before", "after")


def nearest(points: DataFrame, refs: DataFrame, t: str, ref_t: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``near``: the nearer of the references around each point, as a struct of t and the columns ``keep``; the earlier one on a tie."""
    p = around(points, refs, t, ref_t, keep)
    closer = F.col("after").isNull() | (F.col(t) - F.col("before.t") <= F.col("after.t") - F.col(t))
    return p.withColumn("near", F.when(F.col("before").isNotNull() & closer, F.col("before")).otherwise(F.col("after"))).drop("before", "after")


def beat_align(points: DataFrame, beats: DataFrame, t: str) -> DataFrame:
    """Adds beat_idx of the nearest beat and beat_phase: the part of a beat since it, modulo 1, 4 decimals.

    Beats at one time count as one, with the least number.  Null without beats;
    the phase is null with a single beat.
    """
    single = beats.groupBy("track", "t").agg(F.min("beat_idx").alias("beat_idx"))
    w = Window.partitionBy("track").orderBy("t")
    gap = F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w))
    found = nearest(points, single.withColumn("gap", gap), t, "t", ("beat_idx", "gap"))
    x = (F.col(t) - F.col("near.t")) / F.col("near.gap")
    return found.withColumns({"beat_idx": F.col("near.beat_idx"), "beat_phase": F.round(x - F.floor(x), 4)}).drop("near")


def interpolate(points: DataFrame, series: DataFrame, t: str, x: str) -> DataFrame:
    """Adds ``value``: the series (track, t, x) at each point by linear interpolation, clamped at its ends; null without a series."""
    p = around(points, series.select("track", F.col("t").alias("__at"), F.col(x).alias("x")), t, "__at", ("x",))
    a, b = F.col("before"), F.col("after")
    part = F.when(b["t"] > a["t"], (F.col(t) - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    return p.withColumn("value", F.coalesce(a["x"] + (b["x"] - a["x"]) * part, a["x"], b["x"])).drop("before", "after")
