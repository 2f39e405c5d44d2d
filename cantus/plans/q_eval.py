"""Registered queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from . import views as V

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _notes(spark, sf):
    n = V.notes(spark, sf)
    return n, V.activity(n)


_CNT = "cnt AS (SELECT a.track, a.idx, a.active, a.label, count(n.note_id) AS n FROM activity a LEFT JOIN notes n ON n.track = a.track AND n.onset_s >= a.start_s AND n.onset_s < a.end_s GROUP BY ALL)"
_INACT = "ina AS (SELECT n.*, a.idx FROM notes n JOIN activity a ON n.track = a.track AND n.onset_s >= a.start_s AND n.onset_s < a.end_s AND a.active)"
_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END AS r"


@query("activity_f1", V.with_views(
    f"""SELECT track, tp, fp, fn, tn, silent_events, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1,
       round(CASE WHEN al > 0 THEN silent_events / al::DOUBLE ELSE 0 END, 4) AS silent_rate FROM (SELECT *, {_PRF} FROM (
       SELECT track, count(*) FILTER (n >= 3 AND active) AS tp, count(*) FILTER (n >= 3 AND NOT active) AS fp, count(*) FILTER (n < 3 AND active) AS fn, count(*) FILTER (n < 3 AND NOT active) AS tn,
       CAST(coalesce(sum(n) FILTER (NOT active), 0) AS BIGINT) AS silent_events, sum(n) AS al FROM cnt GROUP BY track))""", "notes", "activity", more=_CNT))
def activity_f1(spark, sf):
    return E.activity(*_notes(spark, sf))


@query("pitch_range", V.with_views(
    """SELECT track, round(count(*) FILTER (midi BETWEEN 38 AND 62) * 100.0::DOUBLE / count(*), 1) AS in_pct, round(count(*) FILTER (midi < 38) * 100.0::DOUBLE / count(*), 1) AS below_pct, round(count(*) FILTER (midi > 62) * 100.0::DOUBLE / count(*), 1) AS above_pct,
       round(quantile_cont(midi, 0.5), 1) AS median, round(avg(midi), 1) AS mean, count(*) AS checked FROM ina GROUP BY track""", "notes", "activity", more=_INACT))
def pitch_range(spark, sf):
    return E.pitch_range(E.in_active(*_notes(spark, sf)), 38, 62)


_HIST = """hist AS (SELECT s.track, s.pc, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.track)::DOUBLE AS share FROM
  (SELECT DISTINCT track, pc::INTEGER AS pc FROM notes, range(12) r(pc)) s LEFT JOIN (SELECT track, midi::INTEGER % 12 AS pc, count(*) AS n FROM notes GROUP BY ALL) c ON c.track = s.track AND c.pc = s.pc)"""


@query("pc_histogram", V.with_views("SELECT track, pc, round(share, 6) AS share FROM hist", "notes", more=_HIST))
def pc_histogram(spark, sf):
    return E.pc_histogram(V.notes(spark, sf), ["track"]).withColumn("share", F.round("share", 6))


@query("pc_report", V.with_views(
    """SELECT track, arg_max(pc, share * 1000 - pc / 1000000.0::DOUBLE) AS dominant, round(100 * sum(CASE WHEN pc = 4 THEN share ELSE 0 END), 1) AS root_pct, round(100 * sum(CASE WHEN pc IN (3, 5) THEN share ELSE 0 END), 1) AS neighbor_pct,
       round(100 * sum(CASE WHEN pc IN (4, 6, 7, 9, 11, 0, 2) THEN share ELSE 0 END), 1) AS scale_pct, round(sum(least(share, CASE WHEN pc IN (4, 6, 7, 9, 11, 0, 2) THEN 1 / 7.0::DOUBLE ELSE 0 END)), 4) AS overlap FROM hist GROUP BY track""", "notes", more=_HIST))
def pc_report(spark, sf):
    return E.pc_report(V.notes(spark, sf), 4, [6, 7, 9, 11, 0, 2])


_LEAD = "d AS (SELECT *, lead(midi) OVER w - midi AS d, lead(onset_s) OVER w - onset_s AS gap FROM notes WINDOW w AS (PARTITION BY track ORDER BY onset_s, note_id))"


@query("contour", V.with_views(
    "SELECT track, round(count(*) FILTER (d > 0.5) / greatest(count(d), 1)::DOUBLE, 6) AS up, round(count(*) FILTER (d < -0.5) / greatest(count(d), 1)::DOUBLE, 6) AS down, round(count(*) FILTER (abs(d) <= 0.5) / greatest(count(d), 1)::DOUBLE, 6) AS same FROM d GROUP BY track", "notes", more=_LEAD))
def contour(spark, sf):
    c = E.contour(V.notes(spark, sf), ["track"])
    return c.select("track", *[F.round(x, 6).alias(x) for x in ("up", "down", "same")])


@query("inter_onset", V.with_views("SELECT track, round(coalesce(quantile_cont(gap, 0.5), 0), 6) AS ioi FROM d GROUP BY track", "notes", more=_LEAD))
def inter_onset(spark, sf):
    return E.inter_onset(V.notes(spark, sf), ["track"]).withColumn("ioi", F.round("ioi", 6))


@query("cross_section", V.with_views(
    """WITH b AS (SELECT track, idx, count(*) AS n, quantile_cont(midi, 0.5) AS median FROM ina GROUP BY ALL HAVING count(*) >= 3),
       l AS (SELECT *, lead(midi) OVER w - midi AS d, lead(onset_s) OVER w - onset_s AS gap FROM ina WINDOW w AS (PARTITION BY track, idx ORDER BY onset_s, note_id)),
       c AS (SELECT track, idx, count(*) FILTER (d > 0.5) / greatest(count(d), 1)::DOUBLE AS up, count(*) FILTER (d < -0.5) / greatest(count(d), 1)::DOUBLE AS down, count(*) FILTER (abs(d) <= 0.5) / greatest(count(d), 1)::DOUBLE AS same, coalesce(quantile_cont(gap, 0.5), 0) AS ioi FROM l GROUP BY ALL),
       h AS (SELECT i.track, i.idx, midi::INTEGER % 12 AS pc, count(*) / any_value(b.n)::DOUBLE AS share FROM ina i JOIN b ON b.track = i.track AND b.idx = i.idx GROUP BY ALL),
       e AS (SELECT b.*, c.up, c.down, c.same, c.ioi FROM b JOIN c ON b.track = c.track AND b.idx = c.idx),
       p AS (SELECT x.track, x.idx AS i, y.idx AS j, 1 - (abs(x.up - y.up) + abs(x.down - y.down) + abs(x.same - y.same)) / 2 AS steps, abs(x.median - y.median) AS mg,
         CASE WHEN x.ioi > 0 AND y.ioi > 0 THEN least(x.ioi, y.ioi) / greatest(x.ioi, y.ioi) ELSE 0 END AS si, least(x.n, y.n) / greatest(x.n, y.n)::DOUBLE AS sn FROM e x JOIN e y ON x.track = y.track AND x.idx < y.idx),
       k AS (SELECT p.track, p.i, p.j, coalesce(sum(least(hx.share, coalesce(hy.share, 0))), 0) AS chroma FROM p LEFT JOIN h hx ON hx.track = p.track AND hx.idx = p.i LEFT JOIN h hy ON hy.track = p.track AND hy.idx = p.j AND hy.pc = hx.pc GROUP BY ALL)
       SELECT p.track, count(*) AS pairs, round(avg(k.chroma), 6) AS chroma_sim, round(avg(steps), 6) AS contour_sim, round(avg(si), 6) AS ioi_sim, round(avg(sn), 6) AS density_sim, round(avg(mg), 6) AS median_gap
       FROM p JOIN k ON k.track = p.track AND k.i = p.i AND k.j = p.j GROUP BY p.track""", "notes", "activity", more=_INACT))
def cross_section(spark, sf):
    return E.cross_section(*_notes(spark, sf))


@query("register_stability", V.with_views(
    """SELECT track, count(*) AS checked, CASE WHEN count(*) >= 2 THEN round(stddev_pop(midi), 4) END AS spread, CASE WHEN count(*) >= 2 THEN max(midi) - min(midi) END AS range, CASE WHEN count(*) >= 2 THEN count(*) FILTER (abs(d) >= 10) END AS octave_jumps,
       CASE WHEN count(*) >= 2 THEN count(*) FILTER (abs(d) >= 7) END AS large_jumps, CASE WHEN count(*) >= 2 THEN round(quantile_cont(midi, 0.5), 1) END AS median, CASE WHEN count(*) >= 2 THEN round(avg(midi), 1) END AS mean,
       CASE WHEN count(*) >= 2 THEN round(100.0::DOUBLE * count(*) FILTER (abs(d) >= 10) / count(d), 1) END AS octave_pct, CASE WHEN count(*) >= 2 THEN round(100.0::DOUBLE * count(*) FILTER (abs(d) >= 7) / count(d), 1) END AS large_pct FROM d GROUP BY track""", "notes", more=_LEAD))
def register_stability(spark, sf):
    return E.register_stability(V.notes(spark, sf))


_DR = """dt AS (SELECT track % 10 AS track, list_sort(list(onset_s)) AS det FROM ev WHERE event_type = 'click' GROUP BY 1), rf AS (SELECT track % 10 AS track, list_sort(list(onset_s)) AS ref FROM ev WHERE event_type = 'view' GROUP BY 1)"""


@query("onset_match", V.with_views(
    """WITH f AS (SELECT track, len(ref) AS n_ref, len(det) AS n_det, len(list_reduce(list_prepend(NULL, list_transform(ref, lambda x: {'r': x, 'u': []::BIGINT[]})), lambda a, b: {'r': 0.0::DOUBLE, 'u': CASE WHEN (
        list_sort(list_transform(list_filter(range(1, len(det) + 1), lambda i: abs(det[i] - b.r) <= 0.2 AND NOT list_contains(coalesce(a.u, []), i)), lambda i: {'d': abs(det[i] - b.r), 'i': i})))[1] IS NULL
        THEN coalesce(a.u, []) ELSE list_append(coalesce(a.u, []), (list_sort(list_transform(list_filter(range(1, len(det) + 1), lambda i: abs(det[i] - b.r) <= 0.2 AND NOT list_contains(coalesce(a.u, []), i)), lambda i: {'d': abs(det[i] - b.r), 'i': i})))[1].i) END}).u) AS matched
        FROM dt JOIN rf USING (track))
       SELECT track, n_ref, n_det, matched, n_det - matched AS fp, n_ref - matched AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1
       FROM (SELECT *, matched / n_det::DOUBLE AS p, matched / n_ref::DOUBLE AS r FROM f)""", "ev", more=_DR))
def onset_match(spark, sf):
    e = V.events(spark, sf).filter("event_type IN ('click', 'view') AND track IS NOT NULL")
    e = e.select((F.col("track") % 10).alias("track"), F.col("onset_s").alias("t"), (F.col("event_type") == "view").alias("is_ref"))
    return E.match_onset_events(e, 0.2).filter("n_ref > 0 AND n_det > 0")


_METRICS = [(m, count, least) for (count, least), names in E.MEASURED.items() for m in names]
_RES = (
    "res0 AS (SELECT track AS song, layer, count(*) AS n, avg(midi) AS a, stddev_pop(midi) AS d, CASE WHEN track % 13 = 5 THEN 'failed' END AS error FROM notes GROUP BY track, layer), "
    "res AS (SELECT song, layer, error, m.metric, m.value FROM (SELECT song, layer, error, unnest(["
    + ", ".join(f"{{'metric': '{m}', 'value': CASE WHEN (n + {len(count)}) % 4 >= {least} THEN a / {k + 1}::DOUBLE + d END}}" for k, (m, count, least) in enumerate(_METRICS))
    + "]) AS m FROM res0) WHERE m.value IS NOT NULL)"
)


def _results(spark, sf):
    """Stand-in evaluations: counts that say what was measured, and metrics made of the notes' pitches."""
    g = V.notes(spark, sf).groupBy(F.col("track").alias("song"), "layer").agg(F.count("*").alias("n"), F.avg("midi").alias("a"), F.stddev_pop("midi").alias("d"))
    counts = {count: (F.col("n") + len(count)) % 4 for count, _ in E.MEASURED}
    g = g.withColumns({**counts, **{m: F.col("a") / (k + 1) + F.col("d") for k, (m, _, _) in enumerate(_METRICS)}, "error": F.when(F.col("song") % 13 == 5, "failed")})
    return E.measured_metrics(g)


_AGG = "SELECT layer, metric, round(avg(v), 4) AS mean, round(min(v), 4) AS min, round(max(v), 4) AS max, count(*) AS n FROM (SELECT *, CASE WHEN metric = 'pitch_accuracy' THEN value * 100 ELSE value END AS v FROM res WHERE error IS NULL AND value IS NOT NULL{}) GROUP BY layer, metric"


@query("metric_aggregate", V.with_views(_AGG.format(""), "notes", more=_RES))
def metric_aggregate(spark, sf):
    return E.aggregate_metrics(_results(spark, sf))


@query("baseline_compare", V.with_views(
    f"""WITH c AS ({_AGG.format(" AND song % 2 = 0")}), b AS ({_AGG.format(" AND song % 2 = 1 AND layer <> 'drums'")}),
       j AS (SELECT coalesce(c.layer, b.layer) AS layer, coalesce(c.metric, b.metric) AS metric, c.mean AS now, b.mean AS was, round(c.mean - b.mean, 4) AS delta FROM c FULL JOIN b ON c.layer = b.layer AND c.metric = b.metric)
       SELECT *, CASE WHEN delta IS NULL THEN 'skipped' WHEN (CASE WHEN metric IN ('octave_jump_pct', 'silent_fp_rate', 'below_range_pct') THEN -delta ELSE delta END) > 0.02 THEN 'improved' WHEN (CASE WHEN metric IN ('octave_jump_pct', 'silent_fp_rate', 'below_range_pct') THEN -delta ELSE delta END) < -0.02 THEN 'regressed' ELSE 'same' END AS verdict FROM j""", "notes", more=_RES))
def baseline_compare(spark, sf):
    r = _results(spark, sf)
    return E.compare_to_baseline(E.aggregate_metrics(r.filter("song % 2 = 0")), E.aggregate_metrics(r.filter("song % 2 = 1 AND layer <> 'drums'")))


_DIAG = """dg AS (SELECT *, offset_s - onset_s AS dur, coalesce(onset_s - lag(offset_s) OVER w, 1e9) AS bf, coalesce(lead(onset_s) OVER w - offset_s, 1e9) AS af FROM notes WINDOW w AS (PARTITION BY track, layer ORDER BY onset_s, note_id)),
  dd AS (SELECT track, max(offset_s) AS duration_s FROM notes GROUP BY track),
  ds AS (SELECT track, layer, count(*) AS n, sum(greatest(dur, 0)) AS active, round(avg(dur), 3) AS mean_dur, round(quantile_cont(dur, 0.5), 3) AS median_dur, min(midi) AS midi_min, max(midi) AS midi_max, round(avg(midi), 1) AS midi_mean, round(quantile_cont(midi, 0.5), 1) AS midi_median,
    round(min(velocity), 4) AS velocity_min, round(quantile_cont(velocity, 0.1), 4) AS velocity_p10, count(*) FILTER (bf > 4 AND af > 4) AS isolated, sum(velocity * velocity * dur) AS energy FROM dg GROUP BY track, layer),
  dl AS (SELECT ds.* EXCLUDE (active, energy), round(100 * energy / sum(energy) OVER (PARTITION BY track), 2) AS energy_pct, round(n / duration_s, 4) AS density, round(100 * active / duration_s, 1) AS coverage_pct FROM ds JOIN dd USING (track))"""


def _diagnostics(spark, sf):
    n = V.notes(spark, sf)
    return n, E.layer_diagnostics(n, n.groupBy("track").agg(F.max("offset_s").alias("duration_s")))


@query("layer_diagnostics", V.with_views("SELECT * FROM dl", "notes", more=_DIAG))
def layer_diagnostics(spark, sf):
    return _diagnostics(spark, sf)[1]


@query("diagnostic_warnings", V.with_views(
    """WITH v AS (SELECT t.track, t.track % 5 = 0 AS pyin, max(energy_pct) FILTER (layer = 'drums') AS de, coalesce(max(coverage_pct) FILTER (layer = 'vocals'), 0) AS vc, coalesce(max(n) FILTER (layer = 'vocals'), 0) AS vn, max(midi_mean) FILTER (layer = 'vocals') AS vm,
         coalesce(max(coverage_pct) FILTER (layer = 'bass'), 0) AS bc, coalesce(max(n) FILTER (layer = 'bass'), 0) AS bn, max(median_dur) FILTER (layer = 'bass') AS bd, coalesce(max(isolated) FILTER (layer = 'bass'), 0) AS bi, max(velocity_min) FILTER (layer = 'bass') AS bv FROM dd t LEFT JOIN dl ON dl.track = t.track GROUP BY t.track)
       SELECT track, array_to_string(list_filter([CASE WHEN pyin THEN 'basic_pitch_unavailable_or_failed' END, CASE WHEN bv > 0.15 AND bn > 20 THEN 'bass_velocity_floor_high' END, CASE WHEN de > 60 THEN 'drums_dominate' END, CASE WHEN bn > 50 AND bd < 0.2 THEN 'fragmented_bass' END, CASE WHEN vn > 0 AND vm < 55 THEN 'low_vocal_pitch' END,
         CASE WHEN bi > 5 THEN 'many_isolated_bass_notes' END, CASE WHEN bc < 15 THEN 'sparse_bass' END, CASE WHEN vc < 20 THEN 'sparse_vocals' END], lambda x: x IS NOT NULL), ',') AS warnings FROM v""", "notes", more=_DIAG))
def diagnostic_warnings(spark, sf):
    n, layers = _diagnostics(spark, sf)
    sources = n.select("track").distinct().withColumn("vocals_source", F.when(F.col("track") % 5 == 0, "pyin").otherwise("basic_pitch"))
    return E.diagnostic_warnings(layers, sources).withColumn("warnings", F.concat_ws(",", "warnings"))


@query("section_heatmap", V.with_views(
    "SELECT track, (floor(t / 30))::INTEGER AS sec, round(avg(rms), 6) AS rms, round(avg(onset), 6) AS onset, round(avg(centroid), 6) AS centroid FROM frames GROUP BY ALL", "frames"))
def section_heatmap(spark, sf):
    """Mean of each stem in each section of 30 s."""
    f = V.frames(spark, sf)
    s = f.groupBy("track").agg(F.max("t").alias("m")).withColumn("sec", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 30).cast("int"))))
    s = s.select("track", "sec", (F.col("sec") * 30.0).alias("start_s"), (F.col("sec") * 30.0 + 30.0).alias("end_s"))
    j = J.interval_join(f, s, "t", 30.0)
    return j.groupBy("track", "sec").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("rms", "onset", "centroid")])


@query("component_counts", V.with_views("SELECT track, component, count(*) AS n, round(max(velocity), 4) AS top FROM hits GROUP BY ALL", "hits"))
def component_counts(spark, sf):
    return V.hits(spark, sf).groupBy("track", "component").agg(F.count("*").alias("n"), F.round(F.max("velocity"), 4).alias("top"))


@query("analysis_summary", V.with_views(
    "SELECT track, count(*) AS sections, count(*) FILTER (active) AS active_sections, CAST(sum(n) AS BIGINT) AS notes, string_agg(label, '' ORDER BY idx) AS labels FROM cnt GROUP BY track", "notes", "activity", more=_CNT))
def analysis_summary(spark, sf):
    n, a = _notes(spark, sf)
    c = J.count_in(a, n, "onset_s", 60.0)
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]), "")
    return c.groupBy("track").agg(F.count("*").alias("sections"), F.count_if("active").alias("active_sections"), F.sum("n").alias("notes"), labels.alias("labels"))


@query("stem_metrics", V.with_views(
    """SELECT track, round(avg(CASE WHEN centroid > 0.02 THEN 1.0::DOUBLE ELSE 0 END), 6) AS voiced_ratio, count(*) FILTER (abs(onset - prev) > 3) AS jumps3, count(*) FILTER (abs(onset - prev) > 5) AS jumps5, round(corr(rms, onset), 6) AS stem_corr,
       round(max(onset) / avg(onset), 6) AS sharpness FROM (SELECT *, lag(onset) OVER (PARTITION BY track ORDER BY frame_idx) AS prev FROM frames) GROUP BY track""", "frames"))
def stem_metrics(spark, sf):
    """Voiced ratio, pitch jumps, correlation of two stems and onset sharpness."""
    from ..operators.series import by_track

    f = V.frames(spark, sf).withColumn("jump", F.abs(F.col("onset") - F.lag("onset").over(by_track())))
    return f.groupBy("track").agg(
        F.round(F.avg((F.col("centroid") > 0.02).cast("double")), 6).alias("voiced_ratio"), F.count_if(F.col("jump") > 3).alias("jumps3"), F.count_if(F.col("jump") > 5).alias("jumps5"), F.round(F.corr("rms", "onset"), 6).alias("stem_corr"), F.round(F.max("onset") / F.avg("onset"), 6).alias("sharpness")
    )


@query("band_fold", V.with_views(
    """SELECT track, bar, band, round(e / max(e) OVER (PARTITION BY track, band), 6) AS energy FROM (SELECT track, floor(t / 10)::INTEGER AS bar, CASE WHEN component = 'kick' THEN 'low' WHEN component IN ('snare', 'toms') THEN 'mid' ELSE 'high' END AS band, sum(velocity) AS e FROM hits GROUP BY ALL)""", "hits"))
def band_fold(spark, sf):
    """Six components summed to three bands, each scaled by its maximum."""
    from pyspark.sql import Window

    band = F.when(F.col("component") == "kick", "low").when(F.col("component").isin("snare", "toms"), "mid").otherwise("high")
    e = V.hits(spark, sf).groupBy("track", F.floor(F.col("t") / 10).cast("int").alias("bar"), band.alias("band")).agg(F.sum("velocity").alias("e"))
    return e.select("track", "bar", "band", F.round(F.col("e") / F.max("e").over(Window.partitionBy("track", "band")), 6).alias("energy"))


@query("note_rms", V.with_views(
    """SELECT n.note_id, round(sqrt(avg(f.rms * f.rms)), 4) AS rms FROM notes n JOIN frames f ON f.track = n.track AND f.t >= n.onset_s AND f.t < n.offset_s GROUP BY n.note_id""", "notes", "frames"))
def note_rms(spark, sf):
    """Root mean square of the frames within each note."""
    n = V.notes(spark, sf).select("track", "note_id", F.col("onset_s").alias("start_s"), F.col("offset_s").alias("end_s"))
    j = J.interval_join(V.frames(spark, sf), n, "t", 5.0)
    return j.groupBy("note_id").agg(F.round(F.sqrt(F.avg(F.col("rms") * F.col("rms"))), 4).alias("rms"))


@query("key_estimate", V.with_views(
    """WITH t AS (SELECT mode, root::INTEGER AS root, pc::INTEGER AS pc, CASE WHEN list_contains(degrees, ((pc - root + 12) % 12)::INTEGER) THEN 1.0::DOUBLE ELSE 0 END AS w FROM (VALUES ('major', [0,2,4,5,7,9,11]), ('minor', [0,2,3,5,7,8,10])) m(mode, degrees), range(12) r(root), range(12) q(pc)),
       s AS (SELECT h.track, t.root, t.mode, round(corr(h.share, t.w), 9) AS score FROM hist h JOIN t ON t.pc = h.pc GROUP BY ALL)
       SELECT track, root, mode, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, root, mode) AS r FROM s) WHERE r = 1""", "notes", more=_HIST))
def key_estimate(spark, sf):
    """Best of 24 diatonic templates by correlation with the pitch-class profile."""
    from ..operators.notes import estimate_key

    return estimate_key(E.pc_histogram(V.notes(spark, sf), ["track"])).withColumn("score", F.round("score", 6))


@query("beat_sync", V.with_views(
    "SELECT track, floor(t / 4)::INTEGER AS beat, round(avg(rms), 6) AS rms_mean, round(quantile_cont(onset, 0.5), 4) AS onset_median FROM frames GROUP BY ALL", "frames"))
def beat_sync(spark, sf):
    """Frames gathered between beats: mean of one feature, median of another."""
    return V.frames(spark, sf).groupBy("track", F.floor(F.col("t") / 4).cast("int").alias("beat")).agg(F.round(F.avg("rms"), 6).alias("rms_mean"), F.round(F.percentile("onset", F.lit(0.5)), 4).alias("onset_median"))
