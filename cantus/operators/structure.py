"""Boundaries of a song from frames and beats, and the vectors of its sections, over the steps of ``story`` and ``series``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import story
from .joins import interval_join

# Shares of the novelty of chroma and of timbre, and the least spread of a curve that has structure.
CHROMA_SHARE, TIMBRE_SHARE, LEAST_SPREAD = 0.55, 0.45, 0.08


def novelty_curve(vectors: np.ndarray, half: int) -> np.ndarray:
    """Checkerboard novelty of the cosine matrix of the rows, 0..1; 0 within ``half`` of both ends.

    For rows of unit length the checkerboard sum around a place is the squared
    length of the difference of the sums on both sides.
    """
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    total = np.vstack([np.zeros(unit.shape[1]), np.cumsum(unit, axis=0)])
    out = np.zeros(len(unit))
    at = np.arange(half, len(unit) - half)
    apart = total[at + half] - 2 * total[at] + total[at - half]
    out[at] = np.round((apart * apart).sum(axis=1), 9)
    return out / out.max() if len(out) and out.max() > 1e-8 else out


def _with_memory(x: np.ndarray, steps: int = 3) -> np.ndarray:
    """Each row with the rows before it, zeros where there is none."""
    return np.hstack([np.vstack([np.zeros((k, x.shape[1])), x[: len(x) - k]]) for k in range(min(steps, len(x)))]) if len(x) else x


def pick_novelty(novelty: np.ndarray, t: np.ndarray, min_len: float = 12.0) -> np.ndarray:
    """Times of the novelty's peaks; all windows and the least height go by the number of beats and the curve's spread."""
    n = len(novelty)
    if n < 2:
        return t[:0]
    padded = np.concatenate([novelty[:1], novelty, novelty[-1:]])
    x = np.median(np.stack([padded[:-2], padded[1:-1], padded[2:]]), axis=0)
    around, mean_of = max(2, n // 40), max(4, n // 20)
    wait, delta = max(4, int(min_len / max(float(np.median(np.diff(t))), 1e-6))), max(0.05, 0.5 * float(x.std()))
    taken: list[int] = []
    for i in range(n):
        high = x[max(0, i - around) : i + around].max()
        mean = x[max(0, i - mean_of) : i + mean_of].mean()
        if x[i] >= high and x[i] >= mean + delta and (not taken or i > taken[-1] + wait):
            taken.append(i)
    return t[taken]


def novelty_boundaries(beats: DataFrame) -> DataFrame:
    """Boundaries (track, t) where chroma and timbre change.

    beats: track, beat_idx, t, chroma, mfcc (arrays of one length each).  The
    kernel is a twentieth of the beats wide, 4 to 32.  A track's beats are
    gathered: they are a song's, some hundreds.
    """
    kind = beats.schema["track"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("beat_idx")
        t = rows.column("t").to_numpy()
        half = int(np.clip(len(t) // 20, 4, 32))
        curve = sum(share * novelty_curve(_with_memory(np.array(rows.column(c).to_pylist(), float)), half) for c, share in (("chroma", CHROMA_SHARE), ("mfcc", TIMBRE_SHARE)))
        found = pick_novelty(curve, t)
        return pa.table({"track": pa.array([key[0].as_py()] * len(found), rows.schema.field("track").type), "t": pa.array(found, pa.float64())})

    return beats.select("track", "beat_idx", "t", "chroma", "mfcc").groupBy("track").applyInArrow(run, f"track {kind}, t double")


def _mean_vector(c: str, size: int) -> Column:
    """The mean of arrays of one length, element by element; zeros without any."""
    return F.array(*[F.coalesce(F.avg(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(size)])


def boundaries(tense: DataFrame, beats: DataFrame, duration: DataFrame, hop_s: float = 0.5, min_len: float = 12.0) -> DataFrame:
    """track, t: the ends of a song and, between them, changes of harmony and timbre and the deepest valleys of tension, thinned.

    tense: series.tension of the frames.  Changes count only in tracks whose
    loudness or onsets vary.
    """
    varied = tense.groupBy("track").agg((F.greatest(F.stddev_pop("onset01"), F.stddev_pop("rms01")) > LEAST_SPREAD).alias("v")).filter("v").select("track")
    changes = novelty_boundaries(beats.join(varied, "track", "left_semi"))
    valleys = story.valley_boundaries(tense, duration, "tension", min_len, 35.0, 3, hop_s=hop_s)
    return story.cluster_boundaries(changes.unionByName(valleys), duration, min_len)


def section_vectors(sections: DataFrame, beats: DataFrame, features: DataFrame, n_mfcc: int = 20, n_chroma: int = 12) -> DataFrame:
    """track, idx, vec: mean timbre, mean chroma, and the scaled loudness and onset density of each section."""
    inside = interval_join(beats.select("track", "t", "chroma", "mfcc"), sections.select("track", "idx", "start_s", "end_s"), "t", 30.0)
    means = inside.groupBy("track", "idx").agg(_mean_vector("mfcc", n_mfcc).alias("m"), _mean_vector("chroma", n_chroma).alias("c"))
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    j = features.join(means, ["track", "idx"], "left")
    return j.select("track", "idx", F.concat(F.coalesce("m", zeros(n_mfcc)), F.coalesce("c", zeros(n_chroma)), F.array("mean_rms", "onset_density")).alias("vec"))
