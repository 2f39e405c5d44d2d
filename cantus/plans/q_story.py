"""Registered queries of note clean-up, drum hits, song structure, sources and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import hits as H
from ..operators import notes as N
from ..operators import series as T
from ..operators import story as ST
from ..sources import files
from ..streaming import live
from . import views as V
from .q_series import _BUILD, _N01, _TEN

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_SR = "list_sort(list({'onset_s': onset_s, 'note_id': note_id, 'offset_s': offset_s, 'midi': midi, 'velocity': velocity}))"


@query("merge_notes", V.with_views(
    f"""WITH g AS (SELECT track, {_SR} AS ns FROM notes GROUP BY track),
       f AS (SELECT track, list_reduce(list_prepend(NULL, list_transform(ns, lambda x: [{{'s': x.onset_s, 'e': x.offset_s, 'm': x.midi, 'v': x.velocity}}])), lambda a, b: CASE WHEN a IS NULL THEN b
         WHEN b[1].s - a[-1].e <= 0.08 AND abs(b[1].m - a[-1].m) <= 1 THEN list_append(a[:-2], {{'s': a[-1].s, 'e': greatest(a[-1].e, b[1].e), 'm': a[-1].m, 'v': greatest(a[-1].v, b[1].v)}}) ELSE list_concat(a, b) END) AS m FROM g)
       SELECT track, round(x.s, 6) AS onset_s, round(x.e, 6) AS offset_s, x.m AS midi, round(x.v, 6) AS velocity FROM (SELECT track, unnest(m) AS x FROM f)""", "notes"))
def merge_notes(spark, sf):
    m = N.merge_adjacent(V.notes(spark, sf), ["track"])
    return m.select("track", *[F.round(c, 6).alias(c) for c in ("onset_s", "offset_s")], "midi", F.round("velocity", 6).alias("velocity"))


_NG = "list_sort(list({'o': onset_s, 'i': note_id, 'e': offset_s, 'm': midi, 'v': velocity}))"
_MONO = f"""mo AS (SELECT track, layer, unnest(list_reduce(list_prepend(NULL, list_transform({_NG}, lambda x: [x])), lambda a, b: CASE WHEN a IS NULL THEN b WHEN b[1].o >= a[-1].e THEN list_concat(a, b)
  WHEN b[1].v > a[-1].v THEN list_concat(CASE WHEN round(b[1].o, 4) > a[-1].o THEN list_append(a[:-2], {{'o': a[-1].o, 'i': a[-1].i, 'e': round(b[1].o, 4), 'm': a[-1].m, 'v': a[-1].v}}) ELSE a[:-2] END, b) ELSE a END)) AS x FROM notes GROUP BY track, layer)"""


def _octave_sql(best: str, keep: str) -> str:
    """Pitches of a group folded from left to right; ``best``: candidates as a list of (c, k, m), ``keep``: when the best replaces ms[j]."""
    move = f"list_transform([list_sort({best})[1]], lambda z: CASE WHEN {keep} THEN round(z.m, 2) ELSE ms[b.j] END)[1]"
    return (
        f"og AS (SELECT track, layer, {_NG} AS ns FROM notes GROUP BY track, layer), om AS (SELECT *, list_transform(ns, lambda x: x.m) AS ms FROM og), "
        f"oc AS (SELECT track, layer, ns, list_reduce(list_prepend({{'j': 0, 'acc': CAST([] AS DOUBLE[])}}, list_transform(range(1, len(ms) + 1), lambda j: {{'j': j::INTEGER, 'acc': CAST([] AS DOUBLE[])}})), lambda a, b: {{'j': b.j, 'acc': list_append(a.acc, {move})}}).acc AS done FROM om)"
    )


def _shifts(cost: str, lo: int, hi: int) -> str:
    at = lambda k, m: f"{{'c': CASE WHEN {k} = 0 OR {m} BETWEEN {lo} AND {hi} THEN {cost.format(m=m)} ELSE 1e300::DOUBLE END, 'k': {k}, 'm': {m}}}"
    return f"[{at(0, 'ms[b.j]')}, {at(1, '(ms[b.j] - 12)')}, {at(2, '(ms[b.j] + 12)')}]"


_NEAR = "list_sort(list_concat(a.acc[greatest(len(a.acc) - 4, 1):], ms[b.j + 1:b.j + 5]))"
_MEDIAN = f"({_NEAR}[(len({_NEAR}) + 1) // 2] + {_NEAR}[len({_NEAR}) // 2 + 1]) / 2"
_CONTEXT = _octave_sql(_shifts(f"abs({{m}} - {_MEDIAN})", 20, 80), f"len({_NEAR}) >= 2 AND z.k > 0 AND abs(ms[b.j] - {_MEDIAN}) - z.c >= 6")
_SMOOTH = _octave_sql(_shifts("abs({m} - a.acc[-1]) + abs({m} - ms[b.j + 1])", 36, 96), "b.j > 1 AND b.j < len(ms) AND abs(ms[b.j] - a.acc[-1]) >= 10 AND abs(ms[b.j] - ms[b.j + 1]) >= 10 AND z.k > 0")
_TWIN = "list_filter(range(1, len(ns) + 1), lambda j: j > b.i AND a.k[j] AND ns[j].o < ns[b.i].e AND round_even(ns[j].m, 0)::INTEGER % 12 = round_even(ns[b.i].m, 0)::INTEGER % 12 AND round_even(ns[j].m, 0) <> round_even(ns[b.i].m, 0))"
_DEDUP = f"""ng AS (SELECT *, sum(nw) OVER (PARTITION BY track ORDER BY onset_s, note_id) AS isl FROM (SELECT *, CASE WHEN onset_s < max(offset_s) OVER (PARTITION BY track ORDER BY onset_s, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM notes)),
  nl AS (SELECT track, isl, {_NG} AS ns FROM ng GROUP BY track, isl),
  nk AS (SELECT track, ns, list_reduce(list_prepend({{'i': 0::BIGINT, 'k': list_transform(ns, lambda x: true)}}, list_transform(range(1, len(ns) + 1), lambda i: {{'i': i, 'k': CAST([] AS BOOLEAN[])}})), lambda a, b: {{'i': b.i, 'k': CASE WHEN NOT a.k[b.i] THEN a.k ELSE
    list_transform([{{'t': {_TWIN}, 'l': list_filter({_TWIN}, lambda j: ns[j].v > ns[b.i].v)[1]}}], lambda w: list_transform(a.k, lambda k, j: CASE WHEN j = b.i THEN w.l IS NULL WHEN list_contains(w.t, j) AND (w.l IS NULL OR j < w.l) THEN false ELSE k END))[1] END}}).k AS kept FROM nl)"""
_PARTS = "x.i AS note_id, x.o AS onset_s, x.e AS offset_s, x.m AS midi, x.v AS velocity"


@query("monophonic", V.with_views(f"SELECT track, layer, {_PARTS} FROM mo", "notes", more=_MONO))
def monophonic(spark, sf):
    return N.monophonic(V.notes(spark, sf), ["track", "layer"])


@query("octave_context", V.with_views("SELECT track, layer, x.i AS note_id, y AS midi FROM (SELECT track, layer, unnest(ns) AS x, unnest(done) AS y FROM oc)", "notes", more=_CONTEXT))
def octave_context(spark, sf):
    return N.octave_context(V.notes(spark, sf), ["track", "layer"]).select("track", "layer", "note_id", "midi")


@query("octave_smooth", V.with_views("SELECT track, layer, x.i AS note_id, y AS midi FROM (SELECT track, layer, unnest(ns) AS x, unnest(done) AS y FROM oc)", "notes", more=_SMOOTH))
def octave_smooth(spark, sf):
    return N.octave_smooth(V.notes(spark, sf), ["track", "layer"]).select("track", "layer", "note_id", "midi")


@query("octave_dedup", V.with_views(f"SELECT track, {_PARTS} FROM (SELECT track, unnest(ns) AS x, unnest(kept) AS k FROM nk) WHERE k", "notes", more=_DEDUP))
def octave_dedup(spark, sf):
    return N.octave_dedup(V.notes(spark, sf), ["track"]).select("track", "note_id", "onset_s", "offset_s", "midi", "velocity")


@query("vocal_chain", None)
def vocal_chain(spark, sf):
    return N.clean_vocals(V.notes(spark, sf).filter("layer = 'vocals'"))


@query("bass_chain", None)
def bass_chain(spark, sf):
    n = V.notes(spark, sf)
    return N.clean_bass(n.filter("layer = 'bass'"), N.estimate_key(E.pc_histogram(n, ["track"])))


@query("tracked_chains", None)
def tracked_chains(spark, sf):
    """Vocals and bass from a stand-in pitch track with gaps."""
    f = V.frames(spark, sf).withColumn("midi", F.when(F.col("centroid") > 0.01, F.lit(40.0) + F.floor(F.col("onset") / 10)))
    raw = N.from_pitch(f, V.beats(f)).withColumn("note_id", F.row_number().over(Window.partitionBy("track").orderBy("onset_s")).cast("long"))
    raw = raw.select("track", "note_id", "onset_s", "offset_s", "midi", "velocity")
    return N.clean_vocals(raw, True).withColumn("layer", F.lit("vocals")).unionByName(N.clean_bass(raw, tracked=True).withColumn("layer", F.lit("bass")))


_KEY = """hist AS (SELECT s.track, s.pc, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.track)::DOUBLE AS share FROM (SELECT DISTINCT track, pc::INTEGER AS pc FROM notes, range(12) r(pc)) s
  LEFT JOIN (SELECT track, midi::INTEGER % 12 AS pc, count(*) AS n FROM notes GROUP BY ALL) c ON c.track = s.track AND c.pc = s.pc),
  tp AS (SELECT mode, degrees, root::INTEGER AS root FROM (VALUES ('major', [0,2,4,5,7,9,11]), ('minor', [0,2,3,5,7,8,10])) m(mode, degrees), range(12) r(root)),
  sc AS (SELECT h.track, t.root, t.mode, any_value(t.degrees) AS degrees, round(corr(h.share, CASE WHEN list_contains(t.degrees, ((h.pc - t.root + 12) % 12)::INTEGER) THEN 1.0::DOUBLE ELSE 0 END), 9) AS score FROM hist h, tp t GROUP BY h.track, t.root, t.mode),
  ky AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, root, mode) AS r FROM sc) WHERE r = 1)"""


@query("scale_snap", V.with_views(
    "SELECT n.note_id, n.midi + coalesce(list_filter([0, -1, 1, -2, 2], lambda d: list_contains(k.degrees, ((n.midi::INTEGER + d - k.root + 24) % 12)::INTEGER))[1], 0) AS midi FROM notes n JOIN ky k USING (track)", "notes", more=_KEY))
def scale_snap(spark, sf):
    n = V.notes(spark, sf)
    return N.snap_to_scale(n, N.estimate_key(E.pc_histogram(n, ["track"]))).select("note_id", "midi")


@query("register_fix", V.with_views(
    """SELECT note_id, CASE WHEN midi + sh BETWEEN 28 AND 60 THEN midi + sh ELSE midi END AS midi FROM (SELECT n.*, CASE WHEN md < 34 THEN 12 WHEN md > 55 THEN -12 ELSE 0 END AS sh FROM (SELECT *, quantile_cont(midi, 0.5) OVER (PARTITION BY track) AS md FROM notes) n)""", "notes"))
def register_fix(spark, sf):
    return N.fix_register(V.notes(spark, sf)).select("note_id", "midi")


@query("octave_rule", V.with_views(
    "SELECT note_id, CASE WHEN d < 0.06 OR a < 0.4 THEN midi WHEN u > 1.2 * a AND midi + 12 <= 60 THEN midi + 12 WHEN w > 1.5 * a AND midi - 12 >= 28 THEN midi - 12 ELSE midi END AS midi FROM (SELECT *, velocity AS a, (note_id % 7) / 5.0::DOUBLE AS u, (note_id % 11) / 7.0::DOUBLE AS w, offset_s - onset_s AS d FROM notes)", "notes"))
def octave_rule(spark, sf):
    """The octave decision with stand-in energies."""
    n = V.notes(spark, sf)
    i = F.col("note_id")
    return n.select("note_id", N.octave_by_energy(F.col("midi"), F.col("velocity"), (i % 7) / 5.0, (i % 11) / 7.0, F.col("offset_s") - F.col("onset_s"), F.lit(0.2)).alias("midi"))


@query("gate_prune", V.with_views(
    """WITH p AS (SELECT track, quantile_cont(velocity, 0.05) AS p5 FROM notes WHERE velocity > 0 GROUP BY track), l AS (SELECT n.* FROM notes n LEFT JOIN p USING (track) WHERE p5 IS NULL OR velocity >= 0.3::DOUBLE * p5),
       g AS (SELECT *, coalesce(onset_s - lag(offset_s) OVER w, 1e9) AS b, coalesce(lead(onset_s) OVER w - offset_s, 1e9) AS a FROM l WINDOW w AS (PARTITION BY track ORDER BY onset_s, note_id)) SELECT note_id FROM g WHERE NOT (b > 4 AND a > 4 AND velocity < 0.25)""", "notes"))
def gate_prune(spark, sf):
    return N.gate_and_prune(V.notes(spark, sf), "velocity").select("note_id")


@query("velocity_rescale", V.with_views(
    "SELECT note_id, round(CASE WHEN p >= 1e-8 THEN least(1, greatest(0, (offset_s - onset_s) / p)) ELSE velocity END, 6) AS velocity FROM (SELECT *, quantile_cont(offset_s - onset_s, 0.99) OVER (PARTITION BY track) AS p FROM notes)", "notes"))
def velocity_rescale(spark, sf):
    n = V.notes(spark, sf).withColumn("rms", F.col("offset_s") - F.col("onset_s"))
    return N.rescale_velocity(n, "rms").select("note_id", F.round("velocity", 6).alias("velocity"))


@query("peak_pick", V.with_views(
    """WITH c AS (SELECT track, frame_idx, t, rms01 AS x, max(rms01) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS mx, avg(rms01) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS av FROM n01),
       g AS (SELECT track, list_sort(list(frame_idx)) AS cs FROM c WHERE x = mx AND x >= av + 0.05 GROUP BY track),
       f AS (SELECT track, list_reduce(list_prepend(NULL, list_transform(cs, lambda x: [x])), lambda a, b: CASE WHEN a IS NULL THEN b WHEN b[1] > a[-1] + 5 THEN list_concat(a, b) ELSE a END) AS ks FROM g)
       SELECT k.track, k.frame_idx, c.t, round(c.x, 6) AS value FROM (SELECT track, unnest(ks) AS frame_idx FROM f) k JOIN c USING (track, frame_idx)""", "frames", more=_N01))
def peak_pick(spark, sf):
    f = V.frames(spark, sf).withColumn("rms01", T.minmax01(F.col("rms")))
    return H.pick_peaks(f, "rms01", H.Peaks()).withColumn("value", F.round("value", 6))


@query("hit_levels", V.with_views(
    "SELECT hit_id, component, round(least(1, greatest(0, velocity / CASE WHEN c < 1e-10 THEN 1 ELSE c END)), 4) AS velocity FROM (SELECT *, quantile_cont(velocity, 0.99) OVER (PARTITION BY track, component) AS c FROM hits)", "hits"))
def hit_levels(spark, sf):
    return H.levels(V.hits(spark, sf).withColumnRenamed("velocity", "value")).select("hit_id", "component", "velocity")


@query("band_class", V.with_views(
    "SELECT track, frame_idx, CASE WHEN a >= b AND a >= c THEN 'kick' WHEN b >= c THEN 'snare' ELSE 'hh' END AS component FROM (SELECT *, rms01 AS a, onset01 AS b, cent01 AS c FROM n01)", "frames", more=_N01))
def band_class(spark, sf):
    f = V.frames(spark, sf)
    return f.select("track", "frame_idx", S.band_of(*[T.minmax01(F.col(c)) for c in ("rms", "onset", "centroid")]).alias("component"))


_VALLEYS = (
    _TEN
    + """, vx AS (SELECT *, round(sum(tension) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) / 24, 9) AS x FROM ten), vd AS (SELECT *, x - coalesce(lag(x) OVER w, x) AS d FROM vx WINDOW w AS (PARTITION BY track ORDER BY frame_idx)),
  vp AS (SELECT *, lag(d) OVER w AS prev, max(x) OVER b AS back_max, avg(x) OVER b AS back_mean, max(x) OVER a AS ahead_max, avg(x) OVER a AS ahead_mean FROM vd WINDOW w AS (PARTITION BY track ORDER BY frame_idx),
    b AS (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
  vv0 AS (SELECT *, round((back_max + ahead_max) / 2 - x, 9) AS depth, round(ahead_mean, 9) >= round(back_mean, 9) AS up, CASE WHEN round(ahead_mean, 9) >= round(back_mean, 9) THEN x + 0.4::DOUBLE * (ahead_max - x) ELSE x + 0.4::DOUBLE * (back_max - x) END AS thr FROM vp WHERE prev < 0 AND d >= 0),
  vedge AS (SELECT v.track, v.frame_idx, v.t, v.depth, coalesce(CASE WHEN v.up THEN min(f.t) FILTER (f.frame_idx >= v.frame_idx AND f.frame_idx < v.frame_idx + 24 AND f.x >= v.thr) ELSE max(f.t) FILTER (f.frame_idx <= v.frame_idx AND f.x >= v.thr) END, v.t) AS edge_t
    FROM vv0 v JOIN vx f ON f.track = v.track AND f.frame_idx BETWEEN v.frame_idx - 24 AND v.frame_idx + 23 GROUP BY v.track, v.frame_idx, v.t, v.depth, v.up),
  dur AS (SELECT track, max(t) + 0.5::DOUBLE AS dur FROM frames GROUP BY track)"""
)


def _pick_sql(src: str, group: str, at: str, lo: str, hi: str, most: str, apart: float, where: str) -> str:
    """Greedy choice of the deepest valleys as a list fold: group, ts."""
    fit = f"len(coalesce(a, [])) < {most} AND b[1].t - {lo} >= {apart} AND {hi} - b[1].t >= {apart} AND len(list_filter(coalesce(a, []), lambda s: abs(s.t - b[1].t) < {apart})) = 0"
    return (
        f"SELECT {group}, {lo}, {hi}, list_transform(list_reduce(list_prepend(NULL, list_transform(vs, lambda x: [x])), lambda a, b: CASE WHEN {fit} THEN list_concat(coalesce(a, []), b) ELSE coalesce(a, []) END), lambda s: s.t) AS ts "
        f"FROM (SELECT {group}, {lo}, {hi}, list_sort(list({{'d': -depth, 'i': frame_idx, 't': {at}}})) AS vs FROM {src} WHERE {where} GROUP BY {group}, {lo}, {hi})"
    )


def _duration(f):
    return f.groupBy("track").agg((F.max("t") + 0.5).alias("duration"))


@query("valley_pick", V.with_views(
    "WITH src AS (SELECT v.*, 0.0::DOUBLE AS lo, dur AS hi FROM vedge v JOIN dur USING (track)), pk AS (" + _pick_sql("src", "track", "edge_t", "lo", "hi", "greatest(2, round_even(hi / 55.0, 0))", 12.0, "depth >= 0.05") + ")\n"
    "SELECT dur.track, unnest(list_concat(list_concat([0.0::DOUBLE], list_sort(coalesce(ts, []))), [dur])) AS t FROM dur LEFT JOIN pk USING (track)", "frames", more=_VALLEYS))
def valley_pick(spark, sf):
    """Boundaries at the deepest valleys of the tension curve, with both ends."""
    f = T.tension(V.frames(spark, sf))
    return ST.valley_boundaries(f, _duration(f))


_CLUSTER = """bc0 AS (SELECT track, t FROM slo WHERE abs(slope) > 0.5 UNION SELECT track, edge_t FROM vedge WHERE depth > 0.1), bc1 AS (SELECT bc0.track, bc0.t, dur FROM bc0 JOIN dur USING (track) WHERE t > 0 AND t < dur),
  bc2 AS (SELECT *, sum(nw) OVER (PARTITION BY track ORDER BY t) AS c FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY t) < 12 THEN 0 ELSE 1 END AS nw FROM bc1)),
  bc3 AS (SELECT track, c, dur, list_sort(list(t)) AS ts, coalesce(lead(min(t)) OVER (PARTITION BY track ORDER BY c), dur) AS nx FROM bc2 GROUP BY track, c, dur),
  bc4 AS (SELECT track, list_sort(list({'c': c, 'ts': ts, 'nx': nx, 'kept': [0.0::DOUBLE]})) AS cs FROM bc3 GROUP BY track),
  bc5 AS (SELECT track, list_reduce(list_prepend({'c': 0, 'ts': [0.0::DOUBLE], 'nx': 0.0::DOUBLE, 'kept': [0.0::DOUBLE]}, cs), lambda a, b: {'c': b.c, 'ts': b.ts, 'nx': b.nx, 'kept': CASE WHEN list_max(list_transform(b.ts, lambda t: least(t - a.kept[-1], b.nx - t))) >= 12
    THEN list_append(a.kept, list_filter(b.ts, lambda t: least(t - a.kept[-1], b.nx - t) = list_max(list_transform(b.ts, lambda u: least(u - a.kept[-1], b.nx - u))))[1]) ELSE a.kept END}).kept AS kept FROM bc4)"""


@query("boundary_clusters", V.with_views(
    "SELECT dur.track, unnest(list_append(coalesce(kept, [0.0::DOUBLE]), dur)) AS t FROM dur LEFT JOIN bc5 USING (track)", "frames", more=_VALLEYS + ", " + _CLUSTER))
def boundary_clusters(spark, sf):
    """Steep frames and valleys as candidates, thinned between both ends of the song."""
    f = T.slopes(T.tension(V.frames(spark, sf)))
    steep = f.filter(F.abs("slope") > 0.5).select("track", "t")
    v = ST.valley_candidates(f, "tension", 12.0, 12.0).filter("depth > 0.1").select("track", F.col("edge_t").alias("t"))
    return ST.cluster_boundaries(steep.union(v), _duration(f), 12.0)


def _sections(spark, sf):
    f = V.frames(spark, sf)
    return f, f.groupBy("track").agg((F.max("t") + 0.5).alias("m")).withColumn("idx", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 0.5) / 60).cast("int")))).select("track", "idx", (F.col("idx") * 60.0).alias("start_s"), (F.col("idx") * 60.0 + 60.0).alias("end_s"))


def _vectors(spark, sf):
    b = V.beat_vectors(spark, sf)
    return b.select((F.col("beat_idx") / 10).cast("int").cast("long").alias("track"), (F.col("beat_idx") % 10).cast("int").alias("idx"), "vec")


_SIM = """vv AS (SELECT beat_idx // 10 AS track, (beat_idx % 10)::INTEGER AS idx, vec FROM beat_vectors),
  sim AS (SELECT a.track, a.idx AS i, b.idx AS j, least(1, greatest(0, 0.4::DOUBLE * (list_cosine_similarity(a.vec[1:20], b.vec[1:20]) + 1) / 2 + 0.2::DOUBLE * (list_cosine_similarity(a.vec[21:32], b.vec[21:32]) + 1) / 2
    + 0.4::DOUBLE * greatest(0, 1 - (abs(a.vec[33] - b.vec[33]) + abs(a.vec[34] - b.vec[34])) / 2))) AS sim FROM vv a JOIN vv b ON a.track = b.track AND a.idx < b.idx)"""


@query("section_pairs", V.with_views("SELECT track, i, j, round(sim, 6) AS sim FROM sim", "beat_vectors", more=_SIM))
def section_pairs(spark, sf):
    return ST.section_pairs(_vectors(spark, sf)).withColumn("sim", F.round("sim", 6))


@query("repetition", V.with_views(
    """WITH b AS (SELECT track, i AS idx, j AS o, sim FROM sim UNION ALL SELECT track, j, i, sim FROM sim) SELECT v.track, v.idx, round(coalesce(max(sim) FILTER (abs(o - v.idx) > 1), 0), 6) AS repetition, round(coalesce(1 - max(sim) FILTER (o = v.idx - 1), 1), 6) AS novelty_prev,
       round(coalesce(1 - max(sim) FILTER (o = v.idx + 1), 1), 6) AS novelty_next FROM vv v LEFT JOIN b ON b.track = v.track AND b.idx = v.idx GROUP BY v.track, v.idx""", "beat_vectors", more=_SIM))
def repetition(spark, sf):
    return ST.repetition(_vectors(spark, sf)).select("track", "idx", *[F.round(c, 6).alias(c) for c in ("repetition", "novelty_prev", "novelty_next")])


@query("motif_labels", V.with_views(
    """WITH nr AS (SELECT track, list({'i': i, 'j': j}) AS near FROM sim WHERE sim >= 0.6 GROUP BY track), g AS (SELECT track, list_sort(list(DISTINCT idx)) AS ids FROM vv GROUP BY track), h AS (SELECT g.track, ids, coalesce(near, []) AS near FROM g LEFT JOIN nr USING (track)),
       f AS (SELECT track, list_reduce(list_prepend(NULL, list_transform(ids, lambda x: [{'i': x, 'l': x}])), lambda a, b: CASE WHEN a IS NULL THEN b ELSE list_append(a, {'i': b[1].i, 'l': coalesce(list_filter(a, lambda e: e.i = e.l AND list_contains(near, {'i': e.i, 'j': b[1].i}))[1].i, b[1].i)}) END) AS led FROM h),
       u AS (SELECT track, x.i AS idx, x.l AS leader FROM (SELECT track, unnest(led) AS x FROM f)) SELECT track, idx, chr((64 + dense_rank() OVER (PARTITION BY track ORDER BY leader))::INTEGER) AS label FROM u""", "beat_vectors", more=_SIM))
def motif_labels(spark, sf):
    v = _vectors(spark, sf)
    return ST.motif_labels(ST.section_pairs(v), v, 0.6)


_FEAT = """sc AS (SELECT *, floor(t / 60)::INTEGER AS idx FROM frames), sx AS (SELECT *, sum(rms) OVER (PARTITION BY track, idx ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS sm, row_number() OVER (PARTITION BY track, idx ORDER BY frame_idx) AS rn, count(*) OVER (PARTITION BY track, idx) AS n FROM sc),
  fg AS (SELECT track, idx, avg(rms) AS r, avg(onset) AS o, avg(centroid) AS c, var_pop(rms) AS v, avg(sm) FILTER (rn > n - greatest(1, n // 4)) - avg(sm) FILTER (rn <= greatest(1, n // 4)) AS raw FROM sx GROUP BY track, idx),
  fs AS (SELECT *, CASE WHEN abs(raw) <= 0.02 THEN 0 ELSE raw END AS steep, rank() OVER (PARTITION BY track ORDER BY r) AS rk, count(*) OVER (PARTITION BY track, r) AS ties, count(*) OVER t AS k,
    (r - min(r) OVER t) / (max(r) OVER t - min(r) OVER t + 1e-8) AS mean_rms, (o - min(o) OVER t) / (max(o) OVER t - min(o) OVER t + 1e-8) AS onset_density, (c - min(c) OVER t) / (max(c) OVER t - min(c) OVER t + 1e-8) AS centroid_mean,
    (v - min(v) OVER t) / (max(v) OVER t - min(v) OVER t + 1e-8) AS rms_variance, (idx * 60.0::DOUBLE + 30) / (max(idx) OVER t * 60.0::DOUBLE + 60) AS song_position FROM fg WINDOW t AS (PARTITION BY track)),
  ff AS (SELECT *, least(1, greatest(0, 0.5::DOUBLE + 0.5::DOUBLE * CASE WHEN max(abs(steep)) OVER t > 0 THEN steep / max(abs(steep)) OVER t ELSE 0 END)) AS slope, CASE WHEN k > 1 THEN (rk + (ties - 1) / 2.0::DOUBLE - 1) / (k - 1) ELSE 0.5::DOUBLE END AS intensity_rank FROM fs WINDOW t AS (PARTITION BY track))"""
_FCOLS = ("mean_rms", "onset_density", "centroid_mean", "rms_variance", "slope", "song_position", "intensity_rank")


@query("section_features", V.with_views("SELECT track, idx, " + ", ".join(f"round({c}, 5) AS {c}" for c in _FCOLS) + " FROM ff", "frames", more=_FEAT))
def section_features(spark, sf):
    return ST.section_features(*_sections(spark, sf)).select("track", "idx", *[F.round(c, 5).alias(c) for c in _FCOLS])


def _scored(spark, sf):
    f = ST.section_features(*_sections(spark, sf))
    i = F.col("idx")
    f = f.withColumns({"repetition": (i * 7 % 5) / 5.0, "novelty_prev": F.when(i == 0, 1.0).otherwise((i * 3 % 7) / 7.0), "novelty_next": (i * 5 % 6) / 6.0})
    return ST.role_scores(f)


_ROLE = _FEAT + """, rp AS (SELECT *, (idx * 7 % 5) / 5.0::DOUBLE AS rs, CASE WHEN idx = 0 THEN 1.0::DOUBLE ELSE (idx * 3 % 7) / 7.0::DOUBLE END AS ntp, (idx * 5 % 6) / 6.0::DOUBLE AS ntn FROM ff),
  rq AS (SELECT *, lead(intensity_rank) OVER (PARTITION BY track ORDER BY idx) - intensity_rank AS gap, min(rs) OVER t AS lo, max(rs) OVER t AS hi, CASE WHEN song_position < 0.2 THEN least(1, song_position / 0.2::DOUBLE) ELSE least(1, (1 - song_position) / 0.2::DOUBLE) END AS place, CASE WHEN slope > 0.5 THEN 1 - 0.4::DOUBLE * (slope - 0.5::DOUBLE) / 0.5::DOUBLE ELSE 1 END AS calm FROM rp WINDOW t AS (PARTITION BY track)),
  rsx AS (SELECT track, idx, [{'s': round(CASE WHEN song_position < 0.25 THEN 0.4::DOUBLE * (1 - song_position) + 0.25::DOUBLE * (1 - intensity_rank) + 0.2::DOUBLE * (1 - rs) + 0.15::DOUBLE * slope ELSE 0 END, 9), 'i': 0, 'r': 'intro'},
    {'s': round(0.45::DOUBLE * slope + 0.3::DOUBLE * (1 - intensity_rank) + 0.15::DOUBLE * onset_density + 0.1::DOUBLE * (1 - rms_variance) + CASE WHEN gap > 0.15 THEN 0.12::DOUBLE * gap ELSE 0 END, 9), 'i': 1, 'r': 'build'},
    {'s': round(0.5::DOUBLE * intensity_rank + 0.2::DOUBLE * mean_rms + 0.15::DOUBLE * onset_density + 0.15::DOUBLE * centroid_mean, 9), 'i': 2, 'r': 'payoff'},
    {'s': round((0.5::DOUBLE * (1 - intensity_rank) + 0.25::DOUBLE * (1 - onset_density) + 0.15::DOUBLE * (1 - mean_rms) + 0.1::DOUBLE * (1 - centroid_mean)) * (0.5::DOUBLE + 0.5::DOUBLE * place) * calm, 9), 'i': 3, 'r': 'valley'},
    {'s': round(0.35::DOUBLE * (hi - rs) / (hi - lo + 1e-8) + 0.3::DOUBLE * ntp + 0.25::DOUBLE * ntn + 0.1::DOUBLE * rms_variance, 9), 'i': 4, 'r': 'contrast'},
    {'s': round(CASE WHEN song_position > 0.75 THEN 0.4::DOUBLE * song_position + 0.3::DOUBLE * (1 - slope) + 0.2::DOUBLE * (1 - intensity_rank) + 0.1::DOUBLE * (1 - onset_density) ELSE 0 END, 9), 'i': 5, 'r': 'outro'}] AS l FROM rq),
  rr AS (SELECT track, idx, list_sort(list_transform(l, lambda x: {'s': -x.s, 'i': x.i, 'r': x.r})) AS l FROM rsx)"""


@query("role_scores", V.with_views("SELECT track, idx, l[1].r AS role, l[2].r AS runner_up, round(-l[1].s / (-l[1].s - l[2].s + 1e-8), 4) AS confidence FROM rr", "frames", more=_ROLE))
def role_scores(spark, sf):
    return ST.best_roles(_scored(spark, sf))


_REVISED = """ro AS (SELECT rr.track, rr.idx, l, l[1].r AS r0, intensity_rank, start_s, end_s, row_number() OVER w AS pos, count(*) OVER (PARTITION BY track) AS n FROM rr JOIN (SELECT track, idx, intensity_rank, idx * 60.0::DOUBLE AS start_s, idx * 60.0::DOUBLE + 60 AS end_s FROM ff) USING (track, idx) WINDOW w AS (PARTITION BY track ORDER BY idx)),
  r1 AS (SELECT *, CASE WHEN r0 = 'intro' AND pos > 2 THEN coalesce(list_filter(l, lambda x: x.r <> 'intro' AND x.s < 0)[1].r, 'valley') ELSE r0 END AS r1 FROM ro),
  r2 AS (SELECT *, CASE WHEN r1 = 'outro' AND pos <= n - 2 THEN coalesce(list_filter(l, lambda x: x.r <> 'outro' AND x.s < 0)[1].r, 'valley') ELSE r1 END AS r2 FROM r1),
  r3 AS (SELECT *, CASE WHEN r2 = 'build' AND NOT coalesce(lead(r2) OVER w = 'payoff', false) AND NOT coalesce(lead(r2, 2) OVER w = 'payoff', false) THEN coalesce(list_filter(l, lambda x: x.r <> 'build' AND x.s < 0)[1].r, 'valley') ELSE r2 END AS r3 FROM r2 WINDOW w AS (PARTITION BY track ORDER BY idx)),
  r5 AS (SELECT *, CASE WHEN n >= 3 AND count(*) FILTER (r3 = 'payoff') OVER (PARTITION BY track) = 0 AND r3 NOT IN ('intro', 'outro') AND row_number() OVER (PARTITION BY track, r3 IN ('intro', 'outro') ORDER BY intensity_rank DESC, idx) = 1 THEN 'payoff' ELSE r3 END AS role FROM r3)"""


@query("role_revision", V.with_views("SELECT track, idx, role FROM r5", "frames", more=_ROLE + ", " + _REVISED))
def role_revision(spark, sf):
    s = _scored(spark, sf)
    return ST.revise_roles(s.join(ST.best_roles(s).select("track", "idx", "role"), ["track", "idx"]))


@query("visual_behaviour", V.with_views(
    """SELECT track, idx, CASE role WHEN 'intro' THEN 'establish_world' WHEN 'build' THEN 'build_tension' WHEN 'payoff' THEN CASE WHEN EXISTS (SELECT 1 FROM r5 e WHERE e.track = r5.track AND e.idx < r5.idx AND e.role = 'payoff') THEN 'sustain_euphoria' ELSE 'release_payoff' END
       WHEN 'valley' THEN CASE WHEN (start_s + end_s) / 2 / (SELECT arg_max(end_s, idx) FROM r5 e WHERE e.track = r5.track) < 0.5 THEN 'develop_motion' ELSE 'strip_down' END WHEN 'contrast' THEN 'contrast_reset' ELSE 'close_out' END AS behaviour FROM r5""", "frames", more=_ROLE + ", " + _REVISED))
def visual_behaviour(spark, sf):
    s = _scored(spark, sf)
    revised = ST.revise_roles(s.join(ST.best_roles(s).select("track", "idx", "role"), ["track", "idx"]))
    return ST.visual_behaviour(s.select("track", "idx", "start_s", "end_s").join(revised, ["track", "idx"]))


@query("merge_sections", V.with_views(
    """WITH g AS (SELECT track, list_sort(list({'i': idx, 's': start_s, 'e': end_s, 'r': CASE WHEN (track + idx // 2) % 3 = 0 THEN 'build' ELSE 'valley' END, 'n': (idx * 7 % 10) / 10.0::DOUBLE})) AS ss FROM activity GROUP BY track),
       f AS (SELECT track, list_reduce(list_prepend(NULL, list_transform(ss, lambda x: [x])), lambda a, b: CASE WHEN a IS NULL THEN b WHEN a[-1].r = b[1].r AND a[-1].n < 0.3 AND b[1].e - a[-1].s <= 120 THEN list_append(a[:-2], {'i': a[-1].i, 's': a[-1].s, 'e': b[1].e, 'r': a[-1].r, 'n': b[1].n}) ELSE list_concat(a, b) END) AS m FROM g)
       SELECT track, (x.k - 1)::INTEGER AS sec, x.v.s AS start_s, x.v.e AS end_s, x.v.r AS role FROM f, LATERAL (SELECT unnest(m) AS v, generate_subscripts(m, 1) AS k) x""", "activity"))
def merge_sections(spark, sf):
    a = V.activity(V.events(spark, sf))
    i = F.col("idx")
    return ST.merge_sections(a.select("track", "idx", "start_s", "end_s", F.when((F.col("track") + F.floor(i / 2)) % 3 == 0, "build").otherwise("valley").alias("role"), ((i * 7 % 10) / 10.0).alias("novelty_to_next")))


@query("section_labels", V.with_views(
    """WITH n AS (SELECT track, idx, idx * 211 AS n FROM activity), d AS (SELECT *, CASE WHEN n >= 702 THEN chr((65 + (n - 702) // 676)::INTEGER) ELSE '' END || CASE WHEN n >= 26 THEN chr((65 + (n // 26 - 1) % 26)::INTEGER) ELSE '' END || chr((65 + n % 26)::INTEGER) AS label FROM n)
       SELECT track, idx, label, ((n + 0) % 4)::INTEGER AS colour, ((dense_rank() OVER (PARTITION BY track ORDER BY first, kind) - 1) % 4)::INTEGER AS seen FROM (SELECT *, min(idx) OVER (PARTITION BY track, kind) AS first FROM (SELECT *, substr(label, -1) AS kind FROM d))""", "activity"))
def section_labels(spark, sf):
    """Labels of one, two and three letters, their colours by value, and the colours of their last letters by first appearance."""
    a = V.activity(V.events(spark, sf)).withColumn("label", S.section_label(F.col("idx") * 211)).withColumn("kind", F.right("label", F.lit(1)))
    first = F.min("idx").over(Window.partitionBy("track", "kind"))
    a = a.withColumn("first", first)
    return a.select("track", "idx", "label", S.label_index(F.col("label"), 4).alias("colour"), S.first_seen_index(F.col("kind"), F.col("first"), Window.partitionBy("track"), 4).alias("seen"))


@query("content_ids", "SELECT doc_id, substr(sha256(text), 1, 16) AS song_id FROM documents")
def content_ids(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", files.content_id(F.col("text").cast("binary")).alias("song_id"))


@query("output_names", """WITH b AS (SELECT page_id::VARCHAR AS song_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(url), '[/\\\\]', '-', 'g'), '[^A-Za-z0-9_ .()\\[\\]-]+', '_', 'g'), '\\s+', ' ', 'g')) AS n FROM pages), c AS (SELECT song_id, CASE WHEN rtrim(n[1:96]) = '' THEN 'song' ELSE rtrim(n[1:96]) END AS base FROM b)
       SELECT song_id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '__' || song_id ELSE base END AS dir FROM c""")
def output_names(spark, sf):
    return files.output_names(V.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("song_id"), F.col("url").alias("title")))


@query("cache_manifest", "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM part m WHERE m.p_partkey = part.p_partkey AND m.p_partkey % 3 <> 0 AND m.p_size > 10 AND m.p_size % 50 > 0)")
def cache_manifest(spark, sf):
    """Parts as work items; the manifest has two of three of them, some with empty files."""
    p = V.table(spark, sf, "part")
    done = p.filter("p_partkey % 3 <> 0 AND p_size > 10").select("p_partkey", "p_brand", (F.col("p_size") % 50).alias("n_bytes"))
    return files.stale(p.select("p_partkey", "p_brand"), done, ["p_partkey", "p_brand"])


@query("tidy_plan", """WITH n AS (SELECT page_id, url AS path, CASE page_id % 8 WHEN 0 THEN '.' || name WHEN 1 THEN substr(sha256(url), 1, 16) WHEN 2 THEN name || '.MP4' WHEN 3 THEN name || '.webm' WHEN 4 THEN name || '.wav' ELSE name END AS name, page_id % 8 IN (1, 5, 6) AS is_dir, page_id % 8 = 5 AS has_analysis
       FROM (SELECT page_id, url, split_part(url, '/', -1) AS name FROM pages))
       SELECT path, name, CASE WHEN starts_with(name, '.') THEN 'skip' WHEN is_dir THEN CASE WHEN has_analysis OR regexp_matches(name, '^[0-9a-f]{16}$') THEN 'legacy' ELSE 'skip' END WHEN regexp_matches(lower(name), '.\\.(mp4|mov|mkv|avi|webm)$') THEN 'export' ELSE 'scratch' END AS action FROM n""")
def tidy_plan(spark, sf):
    """Pages as entries of an output folder: dot files, folders by content id, with or without an analysis, films and other files."""
    k = F.col("page_id") % 8
    name = F.element_at(F.split("url", "/"), -1)
    named = F.when(k == 0, F.concat(F.lit("."), name)).when(k == 1, F.substring(F.sha2("url", 256), 1, 16)).when(k == 2, F.concat(name, F.lit(".MP4"))).when(k == 3, F.concat(name, F.lit(".webm"))).when(k == 4, F.concat(name, F.lit(".wav"))).otherwise(name)
    return files.tidy_plan(V.table(spark, sf, "pages").select(F.col("url").alias("path"), named.alias("name"), k.isin(1, 5, 6).alias("is_dir"), (k == 5).alias("has_analysis")))


@query("gm_components", "SELECT p_partkey, CASE WHEN n IN (35,36) THEN 'kick' WHEN n IN (38,40) THEN 'snare' WHEN n IN (42,44,46) THEN 'hh' WHEN n IN (41,43,45,47,48) THEN 'toms' WHEN n IN (51,59) THEN 'ride' WHEN n IN (49,57) THEN 'crash' ELSE 'kick' END AS component FROM (SELECT p_partkey, (30 + p_size % 32)::INTEGER AS n FROM part)")
def gm_components(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", files.gm_component((F.lit(30) + F.col("p_size") % 32).cast("int")).alias("component"))


_STATE = (
    _BUILD
    + """, fs0 AS (SELECT f.track, f.frame_idx, f.t, f.rms01, f.onset01, f.tension, coalesce(exp(-(f.t - d.t) / 0.5::DOUBLE), 0) AS dp FROM ten f ASOF LEFT JOIN (SELECT track, t FROM dr WHERE rank <= 25) d ON d.track = f.track AND f.t >= d.t),
  fb AS (SELECT f.track, f.frame_idx, arg_min((f.t - b.start_t) / (b.peak_t - b.start_t), b.drop_t) AS bu FROM frames f JOIN bu b ON f.track = b.track AND f.t >= b.start_t AND f.t <= b.peak_t AND b.peak_t > b.start_t GROUP BY ALL),
  fs AS (SELECT fs0.*, coalesce(bu, 0) AS bu, CASE WHEN t >= 30 AND abs(t - round(t / 60) * 60) < 0.6 THEN 0.425::DOUBLE * (1 + cos(pi() * abs(t - round(t / 60) * 60) / 0.6::DOUBLE)) ELSE 0 END AS bd FROM fs0 LEFT JOIN fb USING (track, frame_idx))"""
)


@query("timeline_signals", V.with_views(
    """SELECT track, frame_idx, round(dp, 6) AS "drop", round(bu, 6) AS buildup, round(bd, 6) AS boundary, round(least(0.85, greatest(0, 0.15::DOUBLE + 0.55::DOUBLE * pow(tension, 0.9::DOUBLE))), 6) AS story_mix, round(0.5::DOUBLE + 0.65::DOUBLE * pow(rms01, 0.6::DOUBLE) + 0.12::DOUBLE * pow(tension, 0.9::DOUBLE), 6) AS brightness,
       round(22::DOUBLE * onset01 + 18::DOUBLE * tension + 30::DOUBLE * bd, 6) AS grain, round(0.08::DOUBLE + 0.22::DOUBLE * pow(rms01, 0.8::DOUBLE) + 0.1::DOUBLE * dp + 0.06::DOUBLE * bd + 0.12::DOUBLE * bu, 6) AS radius FROM fs""", "frames", more=_STATE))
def timeline_signals(spark, sf):
    """What each frame of the picture is driven by, with sections of a minute."""
    f = T.tension(V.frames(spark, sf))
    at = f.groupBy("track").agg(F.max("t").alias("m")).select("track", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 60).cast("int") + 1)).alias("k")).select("track", (F.col("k") * 60.0).alias("t"))
    times = f.select("track", "frame_idx", "t", F.col("rms01").alias("loud"), F.col("onset01").alias("onset"), "tension")
    state = ST.frame_state(times, T.drops(f).select("track", "t"), T.buildups(f), at)
    return ST.mix_frame(state).select("track", "frame_idx", *[F.round(c, 6).alias(c) for c in ("drop", "buildup", "boundary", "story_mix", "brightness", "grain", "radius")])


@query("palette_blend", V.with_views(
    """SELECT track, frame_idx, floor(t / 60)::INTEGER AS section, floor(t / 60)::INTEGER + 1 AS next_section, round(CASE WHEN 60 - t + floor(t / 60) * 60 < 1.5 THEN x * x * (3 - 2 * x) ELSE 0 END, 6) AS blend FROM (SELECT *, 1 - (60 - t + floor(t / 60) * 60) / 1.5::DOUBLE AS x FROM frames)""", "frames"))
def palette_blend(spark, sf):
    f, sections = _sections(spark, sf)
    return ST.palette_blend(f.select("track", "frame_idx", "t"), sections).select("track", "frame_idx", "section", "next_section", F.round("blend", 6).alias("blend"))


@query("tap_capture", V.with_views(
    """WITH k AS (SELECT track, onset_s - 20 AS t, event_id, CASE WHEN event_type IN ('click', 'view') THEN ' ' WHEN event_type = 'error' THEN 'q' ELSE 'x' END AS key FROM ev), c AS (SELECT *, max(key = 'q') OVER (PARTITION BY track ORDER BY t, event_id) AS quit FROM k WHERE t >= 0 AND t < 600 - track % 7),
       r AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS i, t FROM c WHERE NOT quit AND key = ' ') SELECT track, i::INTEGER AS i, floor((t + 0.05) * 1000 + 1e-6) / 1000 AS t FROM r WHERE i <= 3 + track % 5""", "ev"))
def tap_capture(spark, sf):
    """Events as keys pressed while a song plays from second 20 on; some songs are quit early, some have few words."""
    e = V.events(spark, sf)
    key = F.when(F.col("event_type").isin("click", "view"), " ").when(F.col("event_type") == "error", "q").otherwise("x")
    keys = e.select("track", "event_id", (F.col("onset_s") - 20).alias("t"), key.alias("key"))
    songs = e.select("track").distinct().select("track", (F.lit(3) + F.col("track") % 5).alias("n_words"), (F.lit(600.0) - F.col("track") % 7).alias("duration_s"))
    return live.capture_taps(keys, songs, 0.05).select("track", "i", (F.floor(F.col("t") * 1000 + 1e-6) / 1000.0).alias("t"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return live.tumbling(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", """WITH e AS (SELECT user_id AS track, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 8 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY ts) AS k FROM e) SELECT track, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS n FROM s GROUP BY track, k""")
def stream_sessions(spark, sf):
    s = live.sessions(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("stream_sliding", """SELECT start, user_id AS track, max(value) AS peak FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY ALL""")
def stream_sliding(spark, sf):
    return live.sliding(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_decay", """WITH e AS (SELECT user_id AS track, event_id, epoch_us(ts) AS us, max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM events)
  SELECT track, event_id, floor(round(coalesce(exp(-(us - last) / 1e6 / 43200.0::DOUBLE), 0), 6) * 10000 + 1e-6) / 10000 AS pulse FROM e""")
def stream_decay(spark, sf):
    """Decay since a track's last error event, as a stream with state that is run over all events there are."""
    out = live.drain_to_table(live.decay(live.read_events(spark, sf)))
    return out.withColumn("pulse", F.floor(F.col("pulse") * 10000 + 1e-6) / 10000.0)
