"""Registered queries over frames, notes and beats: normalisation, smoothing, tension, rolling operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import notes as N
from ..operators import series as T
from . import views as V

R = F.round
QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_SM = "sum(x) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
_MM = "CASE WHEN max({x}) OVER t > min({x}) OVER t THEN ({x} - min({x}) OVER t) / (max({x}) OVER t - min({x}) OVER t) ELSE 0 END"
_N01 = "n01 AS (SELECT *, " + ", ".join(f"{_MM.format(x=x)} AS {y}" for x, y in (("rms", "rms01"), ("onset", "onset01"), ("centroid", "cent01"))) + " FROM frames WINDOW t AS (PARTITION BY track))"
_TEN = (
    _N01
    + ", raw AS (SELECT *, 0.48::DOUBLE * pow(rms01, 0.8::DOUBLE) + 0.34::DOUBLE * pow(onset01, 0.7::DOUBLE) + 0.18::DOUBLE * pow(cent01, 0.9::DOUBLE) AS raw_tension FROM n01)"
    + ", sm AS (SELECT *, sum(raw_tension) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM raw)"
    + f", ten AS (SELECT *, {_MM.format(x='smooth')} AS tension FROM sm WINDOW t AS (PARTITION BY track))"
    + ", slo AS (SELECT *, (tension - coalesce(lag(tension) OVER w, tension)) / 0.5::DOUBLE AS slope FROM ten WINDOW w AS (PARTITION BY track ORDER BY frame_idx))"
)
_DROPS = (
    _TEN
    + ", pre AS (SELECT *, max(smooth) OVER w AS pre, max(rms) OVER (PARTITION BY track) AS loud FROM slo WINDOW w AS (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
    + ", dr AS (SELECT track, frame_idx, t, slope, row_number() OVER (PARTITION BY track ORDER BY frame_idx)::INTEGER AS rank FROM pre WHERE slope < -0.65 AND pre >= 0.60 AND loud >= 0.05)"
)
_BUILD = (
    _DROPS
    + ", bu AS (SELECT d.track, d.t AS drop_t, min(CASE WHEN s.slope > 0.30 THEN s.t END) AS start_t, max(s.t) AS peak_t FROM dr d JOIN slo s ON s.track = d.track AND s.frame_idx < d.frame_idx AND s.t >= d.t - 20"
    + " WHERE d.rank <= 25 GROUP BY d.track, d.t HAVING count(*) >= 3 AND min(CASE WHEN s.slope > 0.30 THEN s.t END) IS NOT NULL)"
)


@query("minmax_norm", V.with_views("SELECT track, frame_idx, round(rms01, 6) AS rms01, round(onset01, 6) AS onset01, round(cent01, 6) AS cent01 FROM n01", "frames", more=_N01))
def minmax_norm(spark, sf):
    f = V.frames(spark, sf)
    return f.select("track", "frame_idx", *[R(T.minmax01(F.col(x)), 6).alias(y) for x, y in (("rms", "rms01"), ("onset", "onset01"), ("centroid", "cent01"))])


@query("robust_norm", V.with_views(
    "SELECT track, event_id, round(least(1, greatest(0, value / CASE WHEN cap < 1e-10 THEN 1 ELSE cap END)), 4) AS velocity FROM (SELECT *, quantile_cont(value, 0.99) OVER (PARTITION BY track) AS cap FROM ev)", "ev"))
def robust_norm(spark, sf):
    return T.robust01(V.events(spark, sf), "value", "velocity").select("track", "event_id", "velocity")


@query("band_gate", V.with_views(
    """SELECT track, frame_idx, round(CASE WHEN x >= quantile_cont(x, 0.6) OVER (PARTITION BY track) THEN x ELSE 0 END, 6) AS gated FROM (
       SELECT track, frame_idx, least(1, greatest(0, CASE WHEN hi > lo THEN (rms - lo) / (hi - lo) ELSE 0 END)) AS x FROM (
       SELECT *, quantile_cont(rms, 0.05) OVER (PARTITION BY track) AS lo, quantile_cont(rms, 0.95) OVER (PARTITION BY track) AS hi FROM frames))""", "frames"))
def band_gate(spark, sf):
    return T.band01(V.frames(spark, sf), "rms", "gated").select("track", "frame_idx", R("gated", 6).alias("gated"))


@query("box_smooth", V.with_views(
    f"SELECT track, frame_idx, round({_SM.format(a=2, b=2)} / 5, 6) AS odd, round({_SM.format(a=4, b=3)} / 8, 6) AS even FROM (SELECT *, rms AS x FROM frames)", "frames"))
def box_smooth(spark, sf):
    return V.frames(spark, sf).select("track", "frame_idx", R(T.box_smooth(F.col("rms"), 5), 6).alias("odd"), R(T.box_smooth(F.col("rms"), 8), 6).alias("even"))


@query("tension_curve", V.with_views("SELECT track, frame_idx, round(tension, 6) AS tension, round(slope, 6) AS slope FROM slo", "frames", more=_TEN))
def tension_curve(spark, sf):
    return T.slopes(T.tension(V.frames(spark, sf))).select("track", "frame_idx", R("tension", 6).alias("tension"), R("slope", 6).alias("slope"))


@query("drops_topk", V.with_views("SELECT track, frame_idx, t, round(slope, 6) AS slope, rank FROM dr WHERE rank <= 25", "frames", more=_DROPS))
def drops_topk(spark, sf):
    return T.drops(T.tension(V.frames(spark, sf))).withColumn("slope", R("slope", 6))


@query("buildups", V.with_views(
    "SELECT track, drop_t, start_t, peak_t FROM bu", "frames", more=_BUILD))
def buildups(spark, sf):
    return T.buildups(T.tension(V.frames(spark, sf)))


@query("active_buildup", V.with_views(
    """SELECT f.track, f.frame_idx, round(arg_min(CASE WHEN b.peak_t > b.start_t THEN (f.t - b.start_t) / (b.peak_t - b.start_t) ELSE 1 END, b.drop_t), 6) AS progress
       FROM frames f JOIN bu b ON f.track = b.track AND f.t >= b.start_t AND f.t <= b.peak_t GROUP BY f.track, f.frame_idx""", "frames", more=_BUILD))
def active_buildup(spark, sf):
    """Progress within the first build-up that holds a frame, both ends included."""
    f = V.frames(spark, sf)
    b = T.buildups(T.tension(f)).withColumn("end_s", F.col("peak_t") + 1e-6).withColumnRenamed("start_t", "start_s")
    held = J.interval_join(f.select("track", "frame_idx", "t"), b, "t", 10.0)
    part = F.when(F.col("peak_t") > F.col("start_s"), (F.col("t") - F.col("start_s")) / (F.col("peak_t") - F.col("start_s"))).otherwise(1.0)
    return held.groupBy("track", "frame_idx").agg(R(F.min_by(part, "drop_t"), 6).alias("progress"))


@query("median_smooth", V.with_views(
    """SELECT track, frame_idx, CASE WHEN x IS NOT NULL THEN quantile_cont(x, 0.5) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS med7,
       CASE WHEN y IS NOT NULL THEN round_even(quantile_cont(y, 0.5) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) END AS midi
       FROM (SELECT *, CASE WHEN centroid > 0.02 THEN onset END AS x, CASE WHEN centroid > 0.02 THEN 30 + onset END AS y FROM frames)""", "frames"))
def median_smooth(spark, sf):
    """Null-aware median of a pitch track with gaps, and the pitch quantised after it."""
    w = T.by_track()
    f = V.frames(spark, sf).withColumn("x", F.when(F.col("centroid") > 0.02, F.col("onset")))
    return f.select("track", "frame_idx", T.median_smooth(F.col("x"), 7, w).alias("med7"), F.bround(T.median_smooth(F.col("x") + 30, 7, w)).alias("midi"))


@query("median3", V.with_views(
    """SELECT track, frame_idx, greatest(least(a, x), least(greatest(a, x), c)) AS med3 FROM (SELECT track, frame_idx, rms AS x, coalesce(lag(rms) OVER w, rms) AS a, coalesce(lead(rms) OVER w, rms) AS c
       FROM frames WINDOW w AS (PARTITION BY track ORDER BY frame_idx))""", "frames"))
def median3(spark, sf):
    return V.frames(spark, sf).select("track", "frame_idx", T.median3(F.col("rms"), T.by_track()).alias("med3"))


@query("valleys", V.with_views(
    """WITH d AS (SELECT *, tension - coalesce(lag(tension) OVER w, tension) AS d FROM ten WINDOW w AS (PARTITION BY track ORDER BY frame_idx)),
       g AS (SELECT *, lag(d) OVER w AS prev, max(tension) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l,
       max(tension) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS r FROM d WINDOW w AS (PARTITION BY track ORDER BY frame_idx))
       SELECT track, frame_idx, t, round((l + r) / 2 - tension, 6) AS depth FROM g WHERE prev < 0 AND d >= 0""", "frames", more=_TEN))
def valleys(spark, sf):
    return T.valleys(T.tension(V.frames(spark, sf)), "tension", 24).withColumn("depth", R("depth", 6))


@query("quarter_trend", V.with_views(
    """SELECT track, sec, round(avg(rms01), 6) AS mean, round(avg(rms01) FILTER (rn <= q), 6) AS first_q, round(avg(rms01) FILTER (rn > n - q), 6) AS last_q,
       CASE WHEN round(avg(rms01) FILTER (rn > n - q), 6) - round(avg(rms01) FILTER (rn <= q), 6) > 0.12 THEN 'rising' WHEN round(avg(rms01) FILTER (rn > n - q), 6) - round(avg(rms01) FILTER (rn <= q), 6) < -0.12 THEN 'falling'
       WHEN round(avg(rms01), 6) < 0.35 THEN 'low' WHEN round(avg(rms01), 6) > 0.65 THEN 'high' ELSE 'mid' END AS energy FROM (
       SELECT track, sec, rms01, row_number() OVER (PARTITION BY track, sec ORDER BY frame_idx) AS rn, count(*) OVER (PARTITION BY track, sec) AS n, greatest(1, count(*) OVER (PARTITION BY track, sec) // 4) AS q
       FROM (SELECT *, floor(t / 30)::INTEGER AS sec FROM n01)) GROUP BY track, sec""", "frames", more=_N01))
def quarter_trend(spark, sf):
    f = V.frames(spark, sf).withColumn("rms01", T.minmax01(F.col("rms"))).withColumn("sec", F.floor(F.col("t") / 30).cast("int"))
    q = T.quarter_means(f, "rms01", ["track", "sec"], ["frame_idx"]).select("track", "sec", *[R(c, 6).alias(c) for c in ("mean", "first_q", "last_q")])
    return q.withColumn("energy", S.energy_word(F.col("first_q"), F.col("last_q"), F.col("mean")))


@query("intensity_rank", V.with_views(
    """SELECT track, sec, round(CASE WHEN n > 1 THEN (rk + (ties - 1) / 2.0::DOUBLE - 1) / (n - 1) ELSE 0.5 END, 6) AS intensity FROM (
       SELECT track, sec, rank() OVER (PARTITION BY track ORDER BY x) AS rk, count(*) OVER (PARTITION BY track, x) AS ties, count(*) OVER (PARTITION BY track) AS n FROM (
       SELECT track, floor(t / 30)::INTEGER AS sec, max(onset) AS x FROM frames GROUP BY track, sec))""", "frames"))
def intensity_rank(spark, sf):
    s = V.frames(spark, sf).groupBy("track", F.floor(F.col("t") / 30).cast("int").alias("sec")).agg(F.max("onset").alias("x"))
    return s.select("track", "sec", R(T.average_rank01(F.col("x"), T.whole(), Window.partitionBy("track", "x")), 6).alias("intensity"))


@query("forward_fill", V.with_views(
    "SELECT track, frame_idx, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.5) AS filled FROM (SELECT *, CASE WHEN centroid > 0.05 THEN onset END AS x FROM frames)", "frames"))
def forward_fill(spark, sf):
    f = V.frames(spark, sf).withColumn("x", F.when(F.col("centroid") > 0.05, F.col("onset")))
    return f.select("track", "frame_idx", T.forward_fill(F.col("x"), T.by_track()).alias("filled"))


_W = "WINDOW w AS (PARTITION BY track ORDER BY onset_s, note_id)"


@query("note_gaps", V.with_views(
    f"SELECT track, note_id, round(coalesce(onset_s - lag(offset_s) OVER w, 1e9), 4) AS gap_before, round(coalesce(lead(onset_s) OVER w - offset_s, 1e9), 4) AS gap_after FROM notes {_W}", "notes"))
def note_gaps(spark, sf):
    """Silence before and after each note; 1e9 stands for no neighbour."""
    w = T.by_track("onset_s", "note_id")
    none = F.lit(1e9)
    before, after = F.coalesce(F.col("onset_s") - F.lag("offset_s").over(w), none), F.coalesce(F.lead("onset_s").over(w) - F.col("offset_s"), none)
    return V.notes(spark, sf).select("track", "note_id", R(before, 4).alias("gap_before"), R(after, 4).alias("gap_after"))


@query("extend_notes", V.with_views(
    f"SELECT track, note_id, round(greatest(offset_s, least(offset_s + 0.5, coalesce(lead(onset_s) OVER w - 0.01, offset_s + 0.5))), 4) AS offset_s FROM notes {_W}", "notes"))
def extend_notes(spark, sf):
    """Notes held into the silence behind them, up to just before the next onset, never shortened."""
    w = T.by_track("onset_s", "note_id")
    end = F.col("offset_s")
    held = F.least(end + 0.5, F.coalesce(F.lead("onset_s").over(w) - 0.01, end + 0.5))
    return V.notes(spark, sf).select("track", "note_id", R(F.greatest(end, held), 4).alias("offset_s"))


@query("pitch_runs", V.with_views(
    """WITH v AS (SELECT track, frame_idx, floor(onset / 10)::INTEGER AS m FROM frames WHERE centroid > 0.01),
       r AS (SELECT track, m, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY track, m ORDER BY frame_idx) AS g FROM v) GROUP BY track, m, g HAVING max(frame_idx) - min(frame_idx) + 1 >= 3),
       n AS (SELECT *, CASE WHEN lag(m) OVER w = m AND f0 - lag(f1) OVER w - 1 <= 3 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY track ORDER BY f0)),
       s AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY f0) AS run FROM n)
       SELECT track, min(f0) AS "first", max(f1) AS "last", min(m) AS midi FROM s GROUP BY track, run""", "frames"))
def pitch_runs(spark, sf):
    f = V.frames(spark, sf).withColumn("midi", F.when(F.col("centroid") > 0.01, F.floor(F.col("onset") / 10)).cast("double"))
    return T.pitch_runs(f, "midi", 3, 3)


@query("delay_embedding", V.with_views(
    "SELECT track, frame_idx, onset AS x0, coalesce(lag(onset, 1) OVER w, 0) AS x1, coalesce(lag(onset, 2) OVER w, 0) AS x2 FROM frames WINDOW w AS (PARTITION BY track ORDER BY frame_idx)", "frames"))
def delay_embedding(spark, sf):
    e = V.frames(spark, sf).withColumn("e", T.delay_embedding(F.col("onset"), T.by_track()))
    return e.select("track", "frame_idx", *[F.col("e")[k].alias(f"x{k}") for k in range(3)])


@query("onset_history", V.with_views(
    "SELECT track, frame_idx, round(sum(onset) OVER w, 4) AS total, count(*) OVER w AS n, min(onset) OVER w AS least FROM frames WINDOW w AS (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", "frames"))
def onset_history(spark, sf):
    """The last 24 onsets as a list, and sums of the list."""
    h = V.frames(spark, sf).withColumn("h", T.history(F.col("onset"), T.by_track(), 24))
    total = F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x)
    return h.select("track", "frame_idx", R(total, 4).alias("total"), F.size("h").cast("long").alias("n"), F.array_min("h").alias("least"))


@query("note_names", V.with_views(
    """SELECT note_id, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][(midi::INTEGER % 12) + 1] || ((midi::INTEGER // 12) - 1)::VARCHAR AS name, midi::INTEGER % 12 AS pc,
       least(abs(midi::INTEGER % 12 - 7), 12 - abs(midi::INTEGER % 12 - 7)) AS from_g, round(440 * pow(2, (midi - 69) / 12), 4) AS hz,
       CASE WHEN midi < 41 THEN midi + 12 * ceil((41 - midi) / 12) WHEN midi > 65 THEN midi - 12 * ceil((midi - 65) / 12) ELSE midi END AS folded FROM notes""", "notes"))
def note_names(spark, sf):
    m = F.col("midi")
    return V.notes(spark, sf).select("note_id", S.note_name(m).alias("name"), S.pitch_class(m).alias("pc"), S.octave_distance(S.pitch_class(m), F.lit(7)).alias("from_g"), R(S.midi_to_hz(m), 4).alias("hz"), S.fold_register(m).alias("folded"))


@query("hz_to_midi", V.with_views("SELECT track, frame_idx, round(69 + 12 * log2(greatest(rms, 1e-6) / 440), 2) AS midi FROM frames", "frames"))
def hz_to_midi(spark, sf):
    return V.frames(spark, sf).select("track", "frame_idx", R(S.hz_to_midi(F.col("rms")), 2).alias("midi"))


@query("smooth_gate", V.with_views(
    "SELECT track, frame_idx, round(CASE WHEN rms01 <= 0.3 THEN 0 ELSE k * k * (3 - 2 * k) END, 6) AS gate FROM (SELECT *, least(1, greatest(0, (rms01 - 0.3) / 0.4)) AS k FROM n01)", "frames", more=_N01))
def smooth_gate(spark, sf):
    f = V.frames(spark, sf).withColumn("rms01", T.minmax01(F.col("rms")))
    return f.select("track", "frame_idx", R(S.smooth_gate(F.col("rms01"), 0.3, 0.4), 6).alias("gate"))


@query("voiced_gate", V.with_views(
    """SELECT track, frame_idx, rms >= greatest(0.8 * quantile_cont(rms, 0.25) OVER (PARTITION BY track), 0.08 * max(rms) OVER (PARTITION BY track), 1e-6) AND onset > 5 AND centroid >= 0.02 AS voiced FROM frames""", "frames"))
def voiced_gate(spark, sf):
    """onset and centroid stand for the tracker's flag and probability."""
    f = V.frames(spark, sf).withColumn("flag", F.col("onset") > 5)
    return T.voiced(f, "rms", "flag", "centroid", 0.02).select("track", "frame_idx", "voiced")


@query("midi_events", V.with_views(
    """WITH e AS (SELECT note_id, layer, NULL AS component, onset_s AS s, offset_s AS e, round(velocity, 4) AS v FROM notes WHERE layer <> 'drums' UNION ALL
         SELECT hit_id, 'drums', component, t, t + CASE component WHEN 'kick' THEN 0.06::DOUBLE WHEN 'snare' THEN 0.04 WHEN 'toms' THEN 0.05 WHEN 'hh' THEN 0.015 WHEN 'ride' THEN 0.025 ELSE 0.08 END, greatest(0.25, round(least(1, velocity / 100), 4)) FROM hits)
       SELECT note_id, layer, greatest(1, least(127, floor(v * 127)))::INTEGER AS velocity, round(s, 4) AS start_s, round(e, 4) AS end_s FROM e WHERE e > s""", "notes", "hits"))
def midi_events(spark, sf):
    """Notes and hits as MIDI events."""
    n = V.notes(spark, sf).filter("layer <> 'drums'").select("note_id", "layer", F.lit(None).cast("string").alias("component"), "onset_s", "offset_s", R("velocity", 4).alias("velocity"))
    h = V.hits(spark, sf).select(F.col("hit_id").alias("note_id"), F.lit("drums").alias("layer"), "component", F.col("t").alias("onset_s"), F.lit(None).cast("double").alias("offset_s"), R(F.least(F.lit(1.0), F.col("velocity") / 100), 4).alias("velocity"))
    return N.midi_events(n.unionByName(h)).select("note_id", "layer", "velocity", R("start_s", 4).alias("start_s"), R("end_s", 4).alias("end_s"))


@query("lag_correlation", V.with_views(
    """WITH s AS (SELECT track, frame_idx, sum(onset) OVER w / 9 AS x, sum(rms) OVER w / 9 AS y FROM frames WINDOW w AS (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
       z AS (SELECT track, frame_idx, (x - avg(x) OVER t) / greatest(stddev_pop(x) OVER t, 1e-9) AS x, (y - avg(y) OVER t) / greatest(stddev_pop(y) OVER t, 1e-9) AS y, count(*) OVER t AS n FROM s WINDOW t AS (PARTITION BY track)),
       c AS (SELECT a.track, (b.frame_idx - a.frame_idx)::INTEGER AS lag, round(sum(a.x * b.y) / any_value(a.n), 9) AS corr FROM z a JOIN z b ON b.track = a.track AND b.frame_idx BETWEEN a.frame_idx - 80 AND a.frame_idx + 80 GROUP BY 1, 2)
       SELECT track, lag, round(corr, 6) AS corr, round(corr0, 6) AS corr0 FROM (SELECT *, max(CASE WHEN lag = 0 THEN corr END) OVER (PARTITION BY track) AS corr0,
       row_number() OVER (PARTITION BY track ORDER BY corr DESC, CASE WHEN lag = 0 THEN 0 ELSE 1 END, lag) AS r FROM c) WHERE r = 1""", "frames"))
def lag_correlation(spark, sf):
    f = V.frames(spark, sf)
    out = T.lag_correlation(f.select("track", "frame_idx", F.col("onset").alias("x")), f.select("track", "frame_idx", F.col("rms").alias("x")), 80, 9)
    return out.select("track", "lag", R("corr", 6).alias("corr"), R("corr0", 6).alias("corr0"))


@query("novelty", V.with_views(
    """WITH u AS (SELECT beat_idx, i, vec[i] / sqrt(list_sum(list_transform(vec, lambda v: v * v))) AS u FROM beat_vectors, range(1, 35) r(i)),
       d AS (SELECT beat_idx, i, sum(u) OVER (PARTITION BY i ORDER BY beat_idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) - sum(u) OVER (PARTITION BY i ORDER BY beat_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS d FROM u),
       r AS (SELECT beat_idx, sum(d * d) AS raw FROM d GROUP BY beat_idx),
       k AS (SELECT beat_idx, CASE WHEN beat_idx >= 8 AND beat_idx < (SELECT max(beat_idx) + 1 FROM r) - 8 THEN raw ELSE 0 END AS raw FROM r)
       SELECT 0::BIGINT AS track, beat_idx, round(raw / max(raw) OVER (), 6) AS novelty FROM k""", "beat_vectors"))
def novelty(spark, sf):
    b = V.beat_vectors(spark, sf).withColumn("track", F.lit(0).cast("long"))
    return T.checkerboard_novelty(b, 8).withColumn("novelty", R("novelty", 6))
