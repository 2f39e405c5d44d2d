"""Drum hits: peak picking by component, levels and band classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Peaks:
    """Frames before and after for the maximum and the mean, the height above the mean, and the least distance."""

    pre_max: int = 3
    post_max: int = 3
    pre_avg: int = 10
    post_avg: int = 10
    delta: float = 0.05
    wait: int = 5


# Peak settings by component.
_LOW, _HIGH = Peaks(3, 3, 7, 7, 0.07, 7), Peaks(2, 2, 5, 5, 0.05, 3)
COMPONENT_PEAKS = {"kick": _LOW, "snare": _LOW, "toms": _LOW, "hh": _HIGH, "ride": _HIGH, "crash": Peaks(3, 3, 7, 7, 0.06, 5)}


def _taken(candidates: DataFrame, keys: tuple[str, ...], wait: str, fields: list) -> DataFrame:
    """Candidates (keys, frame_idx, ..) of which each taken one is more than ``wait`` (SQL over x) frames after the one taken before: a fold in the JVM."""
    g = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "t", *fields))).alias("cs"))
    fold = f"aggregate(cs, slice(cs, 1, 0), (acc, x) -> if(size(acc) = 0 OR x.frame_idx > element_at(acc, -1).frame_idx + {wait}, array_append(acc, x), acc))"
    return g.select(*keys, F.explode(F.expr(fold)).alias("h")).select(*keys, "h.*")


def _is_peak(x: Column, p: Peaks, w: WindowSpec) -> Column:
    """Whether a frame is the maximum around it and high enough above the mean around it."""
    return (x == F.max(x).over(w.rowsBetween(-p.pre_max, p.post_max - 1))) & (x >= F.avg(x).over(w.rowsBetween(-p.pre_avg, p.post_avg - 1)) + p.delta)


def pick_peaks(f: DataFrame, value: str, p: Peaks) -> DataFrame:
    """Local maxima above the local mean that are more than ``wait`` frames after the peak taken before: track, frame_idx, t, value."""
    x = F.col(value)
    c = f.withColumn("__peak", _is_peak(x, p, Window.partitionBy("track").orderBy("frame_idx"))).filter("__peak")
    return _taken(c, ("track",), str(p.wait), [x.alias("value")])


def levels(hits: DataFrame) -> DataFrame:
    """Adds velocity: value over the 99th percentile of its component in the track, clipped, 4 decimals."""
    cap = hits.groupBy("track", "component").agg(F.percentile("value", F.lit(0.99)).alias("cap"))
    v = F.col("value") / F.when(F.col("cap") < 1e-10, 1.0).otherwise(F.col("cap"))
    return hits.join(cap, ["track", "component"]).withColumn("velocity", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 4)).drop("cap")


def drum_hits(frames: DataFrame) -> DataFrame:
    """Hits of separated drum components: track, component, frame_idx, t, velocity (velocity_raw: the level).

    frames: track, component, frame_idx, t, strength (onset strength) and
    level.  Each component has its own peak settings; unknown ones and those
    whose level stays below 1e-7 give nothing.  Velocities are levels at the
    hits over the component's 99th percentile.
    """
    keys = ("track", "component")
    w, x, name = Window.partitionBy(*keys).orderBy("frame_idx"), F.col("strength"), F.col("component")
    peak, wait = F.lit(False), F.lit(0)
    for p in sorted(set(COMPONENT_PEAKS.values()), key=str):
        mine = name.isin([c for c, q in COMPONENT_PEAKS.items() if q == p])
        peak, wait = F.when(mine, _is_peak(x, p, w)).otherwise(peak), F.when(mine, p.wait).otherwise(wait)
    known = frames.filter(name.isin(list(COMPONENT_PEAKS)))
    c = known.withColumns({"__peak": peak, "wait": wait, "__top": F.max("level").over(Window.partitionBy(*keys))}).filter("__peak AND __top >= 1e-7")
    picked = _taken(c, keys, "x.wait", ["level", "wait"]).drop("wait").withColumnRenamed("level", "value")
    return levels(picked).withColumnRenamed("value", "velocity_raw")


def drum_hits_from_bands(onsets: DataFrame) -> DataFrame:
    """Hits of an unseparated drum track: each onset (track, t, level, kick, snare, hh: band energies) goes to its loudest band.

    Velocities are levels over the 99th percentile of all of the track's onsets.
    """
    from ..functions.scalars import band_of

    cap = onsets.groupBy("track").agg(F.percentile("level", F.lit(0.99)).alias("cap"))
    v = F.col("level") / F.when(F.col("cap") < 1e-10, 1.0).otherwise(F.col("cap"))
    j = onsets.join(cap, "track")
    return j.select("track", "t", band_of(F.col("kick"), F.col("snare"), F.col("hh")).alias("component"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 4).alias("velocity"), F.col("level").alias("velocity_raw"))
