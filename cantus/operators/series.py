"""Time-series operators over rows keyed by track and ordered by a unique frame index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, ratio


def by_track(*order: str) -> WindowSpec:
    return Window.partitionBy("track").orderBy(*(order or ("frame_idx",)))


def whole() -> WindowSpec:
    return Window.partitionBy("track")


def minmax01(x: Column, over: WindowSpec | None = None) -> Column:
    """Min-max within a track; a constant track gives 0."""
    over = over if over is not None else whole()
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return ratio(x - lo, hi - lo)


def box_smooth(x: Column, win: int, order: WindowSpec | None = None) -> Column:
    """Centred box of ``win`` rows that always divides by ``win``: outside counts as zero."""
    order = order if order is not None else by_track()
    first, last = (-(win - 1) // 2, (win - 1) // 2) if win % 2 else (-win // 2, win // 2 - 1)
    return F.sum(x).over(order.rowsBetween(first, last)) / win


def percentile_of(df: DataFrame, value: str, ps: dict[str, float], key: str = "track") -> DataFrame:
    """Joins exact percentiles of a column within each key; the grouped side has one row a key."""
    wanted = df.groupBy(key).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in ps.items()])
    return df.join(wanted, key)


def robust01(df: DataFrame, value: str, out: str, key: str = "track") -> DataFrame:
    """Divided by the 99th percentile (1 if that is next to 0), clipped, 4 decimals."""
    capped = percentile_of(df, value, {"__cap": 0.99}, key)
    cap = F.when(F.col("__cap") < 1e-10, 1.0).otherwise(F.col("__cap"))
    return capped.withColumn(out, F.round(clamp01(F.col(value) / cap), 4)).drop("__cap")


def band01(df: DataFrame, value: str, out: str) -> DataFrame:
    """Scaled between the 5th and the 95th percentile, then zero below its own 60th."""
    scaled = percentile_of(df, value, {"__lo": 0.05, "__hi": 0.95}).withColumn(out, clamp01(ratio(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")
    return percentile_of(scaled, out, {"__gate": 0.60}).withColumn(out, F.when(F.col(out) >= F.col("__gate"), F.col(out)).otherwise(0.0)).drop("__gate")


def difference(x: Column, order: WindowSpec) -> Column:
    """First difference, 0 at the first row."""
    return x - F.coalesce(F.lag(x).over(order), x)


def median_smooth(x: Column, win: int, order: WindowSpec) -> Column:
    """Centred median of an odd window that shrinks at the edges and skips nulls; null stays null."""
    half = win // 2
    return F.when(x.isNotNull(), F.percentile(x, F.lit(0.5)).over(order.rowsBetween(-half, half)))


def median3(x: Column, order: WindowSpec) -> Column:
    """Median of three with mirrored edges."""
    a, c = F.coalesce(F.lag(x).over(order), x), F.coalesce(F.lead(x).over(order), x)
    return F.greatest(F.least(a, x), F.least(F.greatest(a, x), c))


def tension(frames: DataFrame, hop_s: float = 0.5) -> DataFrame:
    """frames with rms01, onset01, cent01 and tension.

    Adds ``tension``: a mix of loudness, onsets and brightness, smoothed over
    about 0.35 s (at least five frames) and scaled to 0..1 within the track.
    """
    f = frames.withColumns({"rms01": minmax01(F.col("rms")), "onset01": minmax01(F.col("onset")), "cent01": minmax01(F.col("centroid"))})
    raw = F.lit(0.48) * F.pow("rms01", F.lit(0.8)) + F.lit(0.34) * F.pow("onset01", F.lit(0.7)) + F.lit(0.18) * F.pow("cent01", F.lit(0.9))
    f = f.withColumn("raw_tension", raw).withColumn("smooth", box_smooth(F.col("raw_tension"), max(5, round(0.35 / hop_s))))
    return f.withColumn("tension", minmax01(F.col("smooth")))


def slopes(f: DataFrame, hop_s: float = 0.5) -> DataFrame:
    return f.withColumn("slope", difference(F.col("tension"), by_track()) / hop_s)


def drops(f: DataFrame, hop_s: float = 0.5, fall: float = -0.65, before_s: float = 2.0, top: int = 25, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first ``top`` frames of each track where tension falls fast after a tense stretch: track, frame_idx, t, slope, rank.

    Tense: the smoothed mix, unscaled, reaches 0.60 within ``before_s``.  A
    track whose loudness never reaches 0.05 has none.
    """
    w = by_track()
    back = w.rowsBetween(-int(before_s / hop_s), 0)
    g = slopes(f, hop_s).withColumns({"pre": F.max("smooth").over(back), "loud": F.max("rms").over(whole())})
    hit = g.filter((F.col("slope") < fall) & (F.col("pre") >= 0.60) & (F.col("loud") >= 0.05))
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("track", "frame_idx", "t", "slope", "rank", *keep)


def buildups(f: DataFrame, hop_s: float = 0.5, look_s: float = 20.0, rise: float = 0.30) -> DataFrame:
    """For each drop with a rise in the ``look_s`` before it: track, drop_t, start_t (the first rising frame), peak_t (the frame before the drop).

    At least three frames must lie between.  One window over the frames, no join.
    """
    w = by_track()
    back = w.rowsBetween(-int(look_s / hop_s), 0)
    g = slopes(f, hop_s).withColumns({"start_t": F.min(F.when(F.col("slope") > rise, F.col("t"))).over(back), "peak_t": F.lag("t").over(w), "between": F.count("*").over(back)})
    d = drops(g, hop_s, keep=("start_t", "peak_t", "between"))
    return d.filter(F.col("start_t").isNotNull() & (F.col("between") > 3)).select("track", F.col("t").alias("drop_t"), "start_t", "peak_t")


def valleys(f: DataFrame, value: str, win: int) -> DataFrame:
    """Local minima with their depth below the highest of ``win`` frames before and of ``win`` frames from there on: track, frame_idx, t, depth."""
    w = by_track()
    d = difference(F.col(value), w)
    g = f.withColumn("d", d).withColumns({"prev": F.lag("d").over(w), "left": F.max(value).over(w.rowsBetween(-win, -1)), "right": F.max(value).over(w.rowsBetween(0, win - 1))})
    depth = (F.col("left") + F.col("right")) / 2 - F.col(value)
    return g.filter((F.col("prev") < 0) & (F.col("d") >= 0)).select("track", "frame_idx", "t", depth.alias("depth"))


def boundary_pulse(points: DataFrame, boundaries: DataFrame, out: str, width: float, peak: float) -> DataFrame:
    """Adds ``out``: a raised cosine of height ``peak`` around the nearest boundary (track, t), 0 from ``width`` seconds on."""
    from .joins import nearest

    near = nearest(points, boundaries, "t", "t")
    apart = F.abs(F.col("t") - F.col("near.t"))
    bell = F.lit(peak * 0.5) * (1 + F.cos(F.lit(math.pi) * apart / width))
    return near.withColumn(out, F.when(apart < width, bell).otherwise(0.0)).drop("near")


def quarter_means(f: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Mean, first and last quarter mean of a value within each group; a quarter has at least one row."""
    w = Window.partitionBy(*keys)
    g = f.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})
    q = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return g.groupBy(*keys).agg(F.avg(value).alias("mean"), F.avg(F.when(F.col("rn") <= q, F.col(value))).alias("first_q"), F.avg(F.when(F.col("rn") > F.col("n") - q, F.col(value))).alias("last_q"))


def average_rank01(x: Column, over: WindowSpec, ties: WindowSpec) -> Column:
    """(average rank - 1) / (n - 1), and 0.5 for a single row."""
    n = F.count("*").over(over)
    rank = F.rank().over(over.orderBy(x)) + (F.count("*").over(ties) - 1) / 2
    return F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.5)


def forward_fill(x: Column, order: WindowSpec, default: float = 0.5) -> Column:
    return F.coalesce(F.last(x, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(default))


def pitch_runs(f: DataFrame, midi: str, min_frames: int = 3, max_gap: int = 0) -> DataFrame:
    """Runs of equal rounded pitch of at least ``min_frames`` frames: track, first, last, midi.

    Runs of one pitch with at most ``max_gap`` frames between them are one.
    """
    voiced = f.filter(F.col(midi).isNotNull()).withColumn("m", F.bround(midi).cast("int"))
    island = voiced.withColumn("g", F.col("frame_idx") - F.row_number().over(Window.partitionBy("track", "m").orderBy("frame_idx")))
    runs = island.groupBy("track", "m", "g").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last")).filter(F.col("last") - F.col("first") + 1 >= min_frames)
    w = by_track("first")
    same = (F.lag("m").over(w) == F.col("m")) & (F.col("first") - F.lag("last").over(w) - 1 <= max_gap)
    joined = runs.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return joined.groupBy("track", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("m").alias("midi")).drop("run")


def delay_embedding(x: Column, order: WindowSpec, steps: int = 3) -> Column:
    """The value and its predecessors as one array, 0 where there is none."""
    return F.array(x, *[F.coalesce(F.lag(x, k).over(order), F.lit(0.0)) for k in range(1, steps)])


def history(x: Column, order: WindowSpec, size: int) -> Column:
    return F.collect_list(x).over(order.rowsBetween(-(size - 1), 0))


def lag_correlation(a: DataFrame, b: DataFrame, max_lag: int, smooth: int = 1) -> DataFrame:
    """Best lag between two series (track, frame_idx, x), smoothed by a box and z-scored: track, lag, corr, corr0.

    ``corr`` is the sum of a[i] * b[i + lag] over the number of frames; what
    lies outside counts as zero.  Of equal correlations lag 0 wins, then the
    lowest.  Both series meet in one row a frame, and each row sees the frames
    around it by a window, so no series is copied for each lag.
    """
    rows = a.select("track", "frame_idx", F.col("x").cast("double").alias("x"), F.lit(None).cast("double").alias("y")).union(b.select("track", "frame_idx", F.lit(None).cast("double"), F.col("x").cast("double")))
    j = rows.groupBy("track", "frame_idx").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    flat = lambda c: box_smooth(F.coalesce(c, F.lit(0.0)), smooth) if smooth > 1 else F.coalesce(c, F.lit(0.0))
    z = lambda c: (F.col(c) - F.avg(c).over(whole())) / F.greatest(F.stddev_pop(c).over(whole()), F.lit(1e-9))
    j = j.withColumns({"x": flat("x"), "y": flat("y")}).withColumns({"x": z("x"), "y": z("y"), "n": F.count("*").over(whole())})
    near = F.collect_list(F.struct((F.col("frame_idx")).alias("f"), "y")).over(by_track().rangeBetween(-max_lag, max_lag))
    each = j.withColumn("near", near).select("track", "n", "x", "frame_idx", F.explode("near").alias("e"))
    corr = each.groupBy("track", (F.col("e.f") - F.col("frame_idx")).cast("int").alias("lag")).agg(F.round(F.sum(F.col("x") * F.col("e.y")) / F.first("n"), 9).alias("corr"))
    best = Window.partitionBy("track").orderBy(F.desc("corr"), F.when(F.col("lag") == 0, 0).otherwise(1), "lag")
    zero = F.max(F.when(F.col("lag") == 0, F.col("corr"))).over(whole())
    return corr.withColumns({"corr0": zero, "r": F.row_number().over(best)}).filter("r = 1").select("track", "lag", "corr", "corr0")


def voiced(f: DataFrame, level: str, flag: str, probability: str, least: float) -> DataFrame:
    """Adds ``voiced``: loud enough against the track, flagged and probable enough; null counts as no.

    Loud enough: 0.8 of the 25th percentile, 0.08 of the maximum and 1e-6.
    """
    g = percentile_of(f, level, {"__p25": 0.25})
    floor = F.greatest(F.col("__p25") * 0.8, F.max(level).over(whole()) * 0.08, F.lit(1e-6))
    return g.withColumn("voiced", F.coalesce((F.col(level) >= floor) & F.col(flag) & (F.col(probability) >= least), F.lit(False))).drop("__p25")


def checkerboard_novelty(beats: DataFrame, half: int) -> DataFrame:
    """Novelty of a cosine self-similarity matrix without the matrix: track, beat_idx, novelty in 0..1.

    For unit vectors the checkerboard sum around a beat is the squared length
    of (sum on the right - sum on the left), so it is two windowed sums a
    dimension.
    """
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v * v))
    dims = beats.select("track", "beat_idx", F.posexplode(F.transform("vec", lambda v: ratio(v, length))).alias("dim", "u"))
    w = Window.partitionBy("track", "dim").orderBy("beat_idx")
    d = dims.withColumn("d", F.sum("u").over(w.rowsBetween(0, half - 1)) - F.sum("u").over(w.rowsBetween(-half, -1)))
    n = F.max("beat_idx").over(whole()) + 1
    raw = d.groupBy("track", "beat_idx").agg(F.sum(F.col("d") * F.col("d")).alias("raw")).withColumn("n", n)
    raw = raw.withColumn("raw", F.when((F.col("beat_idx") >= half) & (F.col("beat_idx") < F.col("n") - half), F.col("raw")).otherwise(0.0))
    return raw.select("track", "beat_idx", ratio(F.col("raw"), F.max("raw").over(whole())).alias("novelty"))
