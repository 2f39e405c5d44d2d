"""Registered queries of note matching, energy snapping, pitch tracks, drum hits and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import hits as H
from ..operators import joins as J
from ..operators import lyrics as L
from ..operators import notes as N
from ..operators import series as T
from ..operators import story as ST
from ..operators import structure as STR
from ..sources import files
from . import views as V
from .q_series import _N01, _TEN
from .q_story import _pick_sql

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _match_sql(cond: str, tol: float) -> str:
    fit = f"list_filter(range(1, len(det) + 1), lambda i: abs(det[i].t - b.r.t) <= {tol} AND ({cond}) AND NOT list_contains(list_transform(coalesce(a.u, []), lambda z: z.i), i))"
    best = f"list_sort(list_transform({fit}, lambda i: {{'e': abs(det[i].t - b.r.t), 'i': i, 'p': abs(det[i].m - b.r.m)}}))[1]"
    return (
        "list_reduce(list_prepend(NULL, list_transform(ref, lambda x: {'r': x, 'u': CAST([] AS STRUCT(e DOUBLE, i BIGINT, p DOUBLE)[])})), "
        f"lambda a, b: {{'r': b.r, 'u': CASE WHEN {best} IS NULL THEN coalesce(a.u, []) ELSE list_append(coalesce(a.u, []), {best}) END}}).u"
    )


_DM = "abs(det[i].m - b.r.m)"
_NM = """dn AS (SELECT track % 20 AS track, list_sort(list({'t': onset_s, 'n': note_id, 'm': midi})) AS det FROM notes WHERE layer = 'vocals' GROUP BY 1), rn AS (SELECT track % 20 AS track, list_sort(list({'t': onset_s, 'n': note_id, 'm': midi})) AS ref FROM notes WHERE layer = 'bass' GROUP BY 1)"""
_F1 = "round(CASE WHEN {m} / nd + {m} / nr > 0 THEN 2 * ({m} / nd) * ({m} / nr) / ({m} / nd + {m} / nr) ELSE 0 END, 4)"


@query("note_match", V.with_views(
    f"""WITH f AS (SELECT track, len(det)::DOUBLE AS nd, len(ref)::DOUBLE AS nr, {_match_sql("true", 0.5)} AS u0, {_match_sql(_DM + " <= 1.0", 0.5)} AS u1, {_match_sql(f"least(round({_DM}) % 12, 12 - round({_DM}) % 12) <= 1", 0.5)} AS u2 FROM dn JOIN rn USING (track))
        SELECT track, round(nd / nr, 4) AS fragmentation, round(CASE WHEN len(u0) > 0 THEN len(list_filter(u0, lambda x: x.p <= 1.0)) / len(u0)::DOUBLE ELSE 0 END, 4) AS pitch_accuracy, round(CASE WHEN len(u0) > 0 THEN list_sum(list_transform(u0, lambda x: x.e)) / len(u0) ELSE 0 END, 4) AS mean_error,
        {_F1.format(m="len(u0)")} AS f1_onset, {_F1.format(m="len(u1)")} AS f1_pitch, {_F1.format(m="len(u2)")} AS f1_class FROM f""", "notes", more=_NM))
def note_match(spark, sf):
    n = V.notes(spark, sf).withColumn("track", F.col("track") % 20)
    return E.transcription_summary(n.filter("layer = 'vocals'"), n.filter("layer = 'bass'"), 0.5)


@query("energy_snap", V.with_views(
    """WITH j AS (SELECT n.track, n.note_id AS word_id, n.onset_s AS s, f.t, f.rms, max(f.rms) OVER (PARTITION BY n.track, n.note_id) AS peak FROM notes n JOIN frames f ON f.track = n.track AND f.t >= n.onset_s AND f.t < n.offset_s),
       g AS (SELECT track, word_id, s, arg_min(rms, t) AS fst, max(peak) AS peak, min(t) FILTER (rms >= 0.15 * peak) AS loud FROM j GROUP BY ALL), h AS (SELECT *, greatest(s, loud - 0.05::DOUBLE) AS ns FROM g)
       SELECT track, word_id, round(CASE WHEN coalesce(fst <= 0.10 * peak AND ns - s >= 0.03, false) THEN ns ELSE s END, 6) AS start_s, coalesce(fst <= 0.10 * peak AND ns - s >= 0.03, false) AS snapped FROM h""", "notes", "frames"))
def energy_snap(spark, sf):
    w = V.notes(spark, sf).select("track", F.col("note_id").alias("word_id"), F.col("onset_s").alias("start_s"), F.col("offset_s").alias("end_s"))
    return L.snap_to_energy(w, V.frames(spark, sf)).withColumn("start_s", F.round("start_s", 6))


@query("sample_at_onsets", V.with_views(
    """WITH a AS (SELECT h.hit_id, h.track, h.t, f.t AS t0, f.onset AS x0 FROM hits h ASOF LEFT JOIN frames f ON f.track = h.track AND h.t >= f.t WHERE h.track IN (SELECT track FROM frames)), b AS (SELECT a.*, f.t AS t1, f.onset AS x1 FROM a ASOF LEFT JOIN frames f ON f.track = a.track AND a.t <= f.t)
       SELECT hit_id, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN x0 ELSE x1 END AS onset FROM b""", "hits", "frames"))
def sample_at_onsets(spark, sf):
    """The frame nearest each hit, the earlier one on a tie."""
    f = V.frames(spark, sf)
    h = V.hits(spark, sf).join(f.select("track").distinct(), "track", "left_semi").select("track", "hit_id", "t")
    return J.nearest(h, f, "t", "t", ("onset",)).select("hit_id", F.col("near.onset").alias("onset"))


@query("notes_from_pitch", None)
def notes_from_pitch(spark, sf):
    """Notes of a stand-in pitch track with gaps."""
    f = V.frames(spark, sf).withColumn("midi", F.when(F.col("centroid") > 0.01, F.lit(40.0) + F.floor(F.col("onset") / 10)))
    return N.from_pitch(f, V.beats(f))


def _peaks_sql(name: str, x: str, c: str, pre: int, avg: int, delta: float, wait: int) -> str:
    """Peaks of one component: window maxima and means, then a list fold for the least distance."""
    return (
        f"c_{name} AS (SELECT track, frame_idx, t, '{c}' AS component, rms AS level, {x} AS x, max({x}) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN {pre} PRECEDING AND {pre - 1} FOLLOWING) AS mx, "
        f"avg({x}) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN {avg} PRECEDING AND {avg - 1} FOLLOWING) AS av FROM n01), "
        f"k_{name} AS (SELECT track, unnest(list_reduce(list_prepend(NULL, list_transform(list_sort(list(frame_idx)), lambda i: [i])), lambda a, b: CASE WHEN a IS NULL THEN b WHEN b[1] > a[-1] + {wait} THEN list_concat(a, b) ELSE a END)) AS frame_idx FROM c_{name} WHERE x = mx AND x >= av + {delta} GROUP BY track), "
        f"h_{name} AS (SELECT c.track, c.component, c.frame_idx, c.t, c.level FROM k_{name} k JOIN c_{name} c USING (track, frame_idx))"
    )


_HITS = _N01 + ", " + ", ".join(_peaks_sql(*x) for x in (("a", "rms01", "kick", 3, 7, 0.07, 7), ("b", "onset01", "hh", 2, 5, 0.05, 3), ("c", "cent01", "crash", 3, 7, 0.06, 5)))
_HITS += ", hx AS (SELECT *, round(least(1, level / quantile_cont(level, 0.99) OVER (PARTITION BY track, component)), 4) AS velocity FROM (SELECT * FROM h_a UNION ALL SELECT * FROM h_b UNION ALL SELECT * FROM h_c))"


@query("drum_hits", V.with_views(
    """SELECT track, frame_idx, component, velocity, beat_idx::INTEGER AS beat_idx, round((t - beat_idx) - floor(t - beat_idx), 4) AS beat_phase
       FROM (SELECT *, least(719, CASE WHEN t - floor(t) <= 0.5 THEN floor(t) ELSE floor(t) + 1 END) AS beat_idx FROM hx)""", "frames", more=_HITS))
def drum_hits(spark, sf):
    """Hits of three components whose onset strengths are the frames' columns, with a silent and an unknown one beside them, and their beats."""
    f = V.frames(spark, sf).withColumns({f"{c}01": T.minmax01(F.col(c)) for c in ("rms", "onset", "centroid")})
    parts = [("rms", "kick", 1.0), ("onset", "hh", 1.0), ("centroid", "crash", 1.0), ("rms", "toms", 0.0), ("rms", "cowbell", 1.0)]
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("component"), F.col(f"{c}01").alias("strength"), (F.col("rms") * loud).alias("level")) for c, name, loud in parts]))
    each = f.select("track", "frame_idx", "t", stacked.alias("p")).select("track", "frame_idx", "t", "p.*")
    return J.beat_align(H.drum_hits(each), V.beats(f), "t").select("track", "frame_idx", "component", "velocity", "beat_idx", "beat_phase")


@query("drum_fallback", V.with_views(
    """SELECT track, frame_idx, CASE WHEN rms01 >= onset01 AND rms01 >= cent01 THEN 'kick' WHEN onset01 >= cent01 THEN 'snare' ELSE 'hh' END AS component, round(least(1, rms / quantile_cont(rms, 0.99) OVER (PARTITION BY track)), 4) AS velocity
       FROM n01 WHERE onset > 40""", "frames", more=_N01))
def drum_fallback(spark, sf):
    """Strong frames as onsets of an unseparated drum track, with stand-in band energies."""
    f = V.frames(spark, sf).withColumns({n: T.minmax01(F.col(c)) for n, c in (("kick", "rms"), ("snare", "onset"), ("hh", "centroid"))})
    on = f.filter("onset > 40").withColumn("level", F.col("rms"))
    return H.drum_hits_from_bands(on).select("track", (F.col("t") * 2).cast("int").alias("frame_idx"), "component", "velocity")


_SUB = """si AS (SELECT f.track, a.idx, a.start_s, a.end_s, f.frame_idx, f.t, f.tension, count(*) OVER (PARTITION BY f.track, a.idx) AS n FROM ten f JOIN (SELECT DISTINCT track FROM frames) USING (track) JOIN sec a ON a.track = f.track AND f.t >= a.start_s AND f.t < a.end_s),
  sx AS (SELECT *, round(sum(tension) OVER (PARTITION BY track, idx ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8, 9) AS x FROM si WHERE n >= 10 AND end_s - start_s >= 20),
  sd AS (SELECT *, x - coalesce(lag(x) OVER w, x) AS d FROM sx WINDOW w AS (PARTITION BY track, idx ORDER BY frame_idx)),
  sp AS (SELECT *, lag(d) OVER w AS prev, max(x) OVER (PARTITION BY track, idx ORDER BY frame_idx ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS bm, max(x) OVER (PARTITION BY track, idx ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS am, max(x) OVER (PARTITION BY track, idx) - min(x) OVER (PARTITION BY track, idx) AS spread FROM sd WINDOW w AS (PARTITION BY track, idx ORDER BY frame_idx)),
  sv AS (SELECT *, round((bm + am) / 2 - x, 9) AS depth, start_s AS lo, end_s AS hi FROM sp WHERE prev < 0 AND d >= 0),
  pk AS (""" + _pick_sql("sv", "track, idx", "t", "lo", "hi", "greatest(1, round_even((hi - lo) / 25.0, 0))", 8.0, "depth >= round(spread * 0.15::DOUBLE, 9)") + """),
  sb AS (SELECT s.track, s.idx, list_concat(list_concat([s.start_s], list_sort(coalesce(ts, []))), [s.end_s]) AS b FROM sec s LEFT JOIN pk ON pk.track = s.track AND pk.idx = s.idx),
  ss AS (SELECT track, idx, k - 1 AS sub, b[k] AS start_s, b[k + 1] AS end_s FROM (SELECT *, unnest(range(1, len(b))) AS k FROM sb)),
  sq AS (SELECT s.track, s.idx, s.sub, f.tension, row_number() OVER w AS rn, count(*) OVER (PARTITION BY s.track, s.idx, s.sub) AS n FROM ss s JOIN ten f ON f.track = s.track AND f.t >= s.start_s AND f.t < s.end_s WINDOW w AS (PARTITION BY s.track, s.idx, s.sub ORDER BY f.frame_idx)),
  se AS (SELECT track, idx, sub, avg(tension) AS m, avg(tension) FILTER (rn > n - greatest(1, n // 4)) - avg(tension) FILTER (rn <= greatest(1, n // 4)) AS d FROM sq GROUP BY ALL)"""


@query("subsections", V.with_views(
    "WITH sec AS (SELECT track, r.i::INTEGER AS idx, r.i * 60.0::DOUBLE AS start_s, r.i * 60.0::DOUBLE + 60 AS end_s FROM (SELECT DISTINCT track FROM frames), range(12) r(i)), " + _SUB + "\n"
    "SELECT ss.track, ss.idx, ss.sub::INTEGER AS sub, ss.start_s, ss.end_s, CASE WHEN m IS NULL THEN 'mid' WHEN d > 0.12 THEN 'rising' WHEN d < -0.12 THEN 'falling' WHEN m < 0.35 THEN 'low' WHEN m > 0.65 THEN 'high' ELSE 'mid' END AS energy FROM ss LEFT JOIN se USING (track, idx, sub)", "frames", more=_TEN))
def subsections(spark, sf):
    f = T.tension(V.frames(spark, sf))
    return ST.subsections(f, V.activity(f).select("track", "idx", "start_s", "end_s"))


@query("line_merge", None)
def line_merge(spark, sf):
    """Lines timed by heard words: a damaged and shifted copy of their own."""
    lines = V.lyric_lines(spark, sf).select(F.col("song").alias("track"), F.col("line_idx").cast("int").alias("idx"), "text", "start_s", "end_s")
    w = L.time_words(lines, ["track", "idx"])
    heard = w.filter("word_idx % 5 <> 2").select("track", F.when(F.col("word_idx") % 7 == 3, F.concat("word", F.lit("s"))).otherwise(F.col("word")).alias("word"), (F.col("start_s") + 0.02).alias("start_s"), (F.col("end_s") + 0.02).alias("end_s"))
    return L.merge_lines(lines, heard)


@query("asr_normalise", V.with_views(
    """SELECT song, line_idx, len(ws) AS n, round(list_sum(list_transform(ws, lambda w: w.c)), 4) AS confidence FROM (SELECT song, line_idx, list_filter(list_transform(string_split(text, ' '), lambda w, i: {'w': trim(w), 'c': CASE WHEN i % 3 = 1 THEN 0.5::DOUBLE WHEN i % 3 = 2 THEN 0.25::DOUBLE ELSE 0 END}), lambda w: w.w <> '') AS ws FROM lines)""", "lines"))
def asr_normalise(spark, sf):
    none = F.lit(None).cast("double")
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), none.alias("start_s"), none.alias("end_s"), F.when(i % 3 == 0, 0.5).alias("probability"), F.when(i % 3 == 1, 0.25).alias("score")))
    out = L.normalise_segments(V.lyric_lines(spark, sf).withColumn("words", words))
    return out.select("song", "line_idx", F.size("words").cast("long").alias("n"), F.round(F.aggregate("words", F.lit(0.0), lambda a, w: a + w["confidence"]), 4).alias("confidence"))


@query("time_shift", V.with_views(
    "SELECT note_id, floor(round(greatest(0, onset_s - 30.5::DOUBLE), 6) * 1000) / 1000 AS start_s, floor(greatest(round(greatest(0, onset_s - 30.5::DOUBLE), 6), round(offset_s - 30.5::DOUBLE, 6)) * 1000) / 1000 AS end_s FROM notes", "notes"))
def time_shift(spark, sf):
    s, e = S.shifted(F.col("onset_s"), F.col("offset_s"), F.lit(-30.5))
    return V.notes(spark, sf).select("note_id", (F.floor(s * 1000) / 1000.0).alias("start_s"), (F.floor(e * 1000) / 1000.0).alias("end_s"))


@query("cache_compatible", "SELECT p_partkey, p_size % 10 >= 7 AND (p_partkey % 4 = 0 OR p_partkey % 4 = 1) AS usable FROM part")
def cache_compatible(spark, sf):
    p = V.table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    a, b = F.when(k == 0, F.lit("x")).when(k == 2, F.lit("y")), F.when(k == 0, F.lit("x")).when(k == 3, F.lit("z"))
    return p.select("p_partkey", files.cache_compatible(F.col("p_size") % 10, 7, (a, b)).alias("usable"))


@query("backend_order", """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'whisperx' ELSE 'own' END AS asked, list_filter([CASE WHEN p_size % 2 = 0 THEN 'whisper' END, CASE WHEN p_size % 3 = 0 THEN 'whisperx' END, CASE WHEN p_size % 5 = 0 THEN 'stable_whisper' END, 'other'], lambda x: x IS NOT NULL) AS have FROM part),
  k AS (SELECT *, list_filter(['whisperx', 'stable_whisper', 'whisper'], lambda b: list_contains(have, b)) AS known FROM p)
  SELECT p_partkey, array_to_string(CASE WHEN asked <> 'auto' THEN [asked] WHEN len(known) > 0 THEN known ELSE ['whisper'] END, ',') AS tried FROM k""")
def backend_order(spark, sf):
    """Which back ends each part would try: it asks for any or for one, and some are there."""
    p = V.table(spark, sf, "part")
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    have = F.array_compact(F.array(F.when(n % 2 == 0, "whisper"), F.when(n % 3 == 0, "whisperx"), F.when(n % 5 == 0, "stable_whisper"), F.lit("other")))
    return p.select("p_partkey", F.array_join(files.backend_order(F.when(k == 0, "auto").when(k == 1, "whisperx").otherwise("own"), have), ",").alias("tried"))


@query("json_paths", "SELECT event_id, coalesce(CAST(props->>'$.k' AS BIGINT), -1) AS k, coalesce(props->>'$.layer.name', 'none') AS layer FROM events")
def json_paths(spark, sf):
    """Paths into JSON with defaults for what is missing."""
    e = V.table(spark, sf, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.layer.name"), F.lit("none")).alias("layer"))


@query("lookup_metadata", "SELECT o_orderkey AS song_id, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN 'given' END, c_name) AS artist, c_mktsegment AS lyrics FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def lookup_metadata(spark, sf):
    """Artist from an override, else from the tag; lyrics from a lookup table, null where it has none."""
    c = V.table(spark, sf, "customer").filter("c_custkey % 3 <> 0")
    o = V.table(spark, sf, "orders").withColumn("given", F.when(F.col("o_orderkey") % 10 == 0, "given"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(F.col("o_orderkey").alias("song_id"), F.coalesce("given", "c_name").alias("artist"), F.col("c_mktsegment").alias("lyrics"))


@query("boundary_union", V.with_views(
    "SELECT DISTINCT track, t FROM (SELECT track, start_s AS t FROM activity UNION ALL SELECT track, end_s FROM activity UNION ALL SELECT track, floor(onset_s / 60) * 60 FROM notes)", "notes", "activity"))
def boundary_union(spark, sf):
    """Distinct boundaries of several sources."""
    n = V.notes(spark, sf)
    a = V.activity(n)
    return a.select("track", F.col("start_s").alias("t")).union(a.select("track", "end_s")).union(n.select("track", (F.floor(F.col("onset_s") / 60) * 60).cast("double"))).distinct()


@query("songs_with_references", "SELECT o_custkey AS song_id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def songs_with_references(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("song_id"))
    return o.intersect(V.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("song_id")))


@query("metric_rollup", "SELECT layer, metric, song, round(avg(v), 4) AS mean, count(*) AS n FROM (SELECT l_linestatus AS layer, l_returnflag AS metric, l_suppkey AS song, l_quantity AS v FROM lineitem) GROUP BY GROUPING SETS ((layer, metric), (layer, metric, song))")
def metric_rollup(spark, sf):
    """Means of metrics over all songs and of each song, in one pass."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("layer"), F.col("l_returnflag").alias("metric"), F.col("l_suppkey").alias("song"), F.col("l_quantity").alias("v"))
    layer, metric, song = F.col("layer"), F.col("metric"), F.col("song")
    return li.groupingSets([[layer, metric], [layer, metric, song]], layer, metric, song).agg(F.round(F.avg("v"), 4).alias("mean"), F.count("*").alias("n"))


@query("song_boundaries", None)
def song_boundaries(spark, sf):
    """Boundaries of the frames with stand-in beats, one a second, whose vectors change every 40 s."""
    f = T.tension(V.frames(spark, sf))
    duration = f.groupBy("track").agg((F.max("t") + 0.5).alias("duration"))
    one = lambda k: F.array(*[(((F.col("track") + F.floor(F.col("beat_idx") / 40)) * (i + k) % 7) / 7.0) for i in range(12)])
    beats = duration.select("track", F.explode(F.sequence(F.lit(0), F.floor("duration").cast("int"))).alias("beat_idx"))
    beats = beats.select("track", "beat_idx", F.col("beat_idx").cast("double").alias("t"), one(1).alias("chroma"), one(3).alias("mfcc"))
    return STR.boundaries(f, beats, duration)
