"""Evaluation of detected notes and onsets against references and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pitch_class, ratio
from .joins import count_in, interval_join
from .matching import FITS, events_of, match_counts, onset_counts


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def activity(events: DataFrame, sections: DataFrame, t: str = "onset_s", least: int = 3) -> DataFrame:
    """Confusion of sections by ``least`` events in them: tp, fp, fn, tn, precision, recall, f1, silent counts, by track.

    Without a positive, precision and recall are 1.
    """
    c = count_in(sections, events, t, 60.0)
    hit, act = F.col("n") >= least, F.col("active")
    g = c.groupBy("track").agg(
        F.count_if(hit & act).alias("tp"), F.count_if(hit & ~act).alias("fp"), F.count_if(~hit & act).alias("fn"), F.count_if(~hit & ~act).alias("tn"),
        F.coalesce(F.sum(F.when(~act, F.col("n"))), F.lit(0)).alias("silent_events"), F.sum("n").alias("all_events"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return g.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"), F.round(ratio(F.col("silent_events"), F.col("all_events")), 4).alias("silent_rate")).drop("all_events")


def in_active(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Notes with each active section that holds their onset."""
    return interval_join(notes, sections.filter("active").select("track", "idx", "start_s", "end_s", "label"), "onset_s", 60.0)


def pitch_range(notes: DataFrame, lo: float, hi: float) -> DataFrame:
    """Percent of notes in, below and above a range, median and mean pitch, by track."""
    m = F.col("midi")
    share = lambda c: F.round(F.count_if(c) * 100.0 / F.count("*"), 1)
    return notes.groupBy("track").agg(
        share((m >= lo) & (m <= hi)).alias("in_pct"), share(m < lo).alias("below_pct"), share(m > hi).alias("above_pct"), F.round(F.percentile("midi", F.lit(0.5)), 1).alias("median"), F.round(F.avg("midi"), 1).alias("mean"), F.count("*").alias("checked")
    )


def pc_histogram(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the twelve pitch classes in each group, with a row for every class."""
    counts = notes.groupBy(*keys, pitch_class(F.col("midi")).alias("pc")).agg(F.count("*").alias("n"))
    spine = notes.select(*keys).distinct().withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11))))
    full = spine.join(counts, [*keys, "pc"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")


def pc_report(notes: DataFrame, root: int, scale: list[int]) -> DataFrame:
    """Dominant class (the lowest of equals), root, neighbour and in-scale percent, overlap with a flat scale, by track.

    Percents come from whole counts, so they don't depend on the order of
    rows, and halves of the last digit are rounded up.
    """
    pc = pitch_class(F.col("midi"))
    c = notes.groupBy("track").agg(F.count(pc).alias("n"), *[F.count_if(pc == k).alias(f"n{k}") for k in range(12)])
    ns, scale = [F.col(f"n{k}") for k in range(12)], sorted({root, *scale})
    near = {(root - 1) % 12, (root + 1) % 12}
    pct = lambda classes: F.round(ratio(sum(ns[k] for k in sorted(classes)) * 1000.0, F.col("n"))) / 10.0
    overlap = sum(F.least(ratio(ns[k].cast("double"), F.col("n")), F.lit(1.0 / len(scale) if k in scale else 0.0)) for k in range(12))
    dominant = F.when(F.col("n") > 0, F.array_position(F.array(*ns), F.greatest(*ns)) - 1).cast("int")
    return c.select("track", dominant.alias("dominant"), pct({root}).alias("root_pct"), pct(near).alias("neighbor_pct"), pct(scale).alias("scale_pct"), F.round(overlap, 4).alias("overlap"))


def contour(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of rising, falling and level steps between successive notes; a group of one note has zeros."""
    w = Window.partitionBy(*keys).orderBy("onset_s", "note_id")
    d = notes.withColumn("d", F.lead("midi").over(w) - F.col("midi"))
    n = F.greatest(F.count("d"), F.lit(1))
    share = lambda c: F.count_if(c) / n
    return d.groupBy(*keys).agg(share(F.col("d") > 0.5).alias("up"), share(F.col("d") < -0.5).alias("down"), share(F.abs("d") <= 0.5).alias("same"))


def inter_onset(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Median time between successive onsets, by group; 0 for a single note."""
    w = Window.partitionBy(*keys).orderBy("onset_s", "note_id")
    d = notes.withColumn("d", F.lead("onset_s").over(w) - F.col("onset_s"))
    return d.groupBy(*keys).agg(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(0.0)).alias("ioi"))


def cross_section(notes: DataFrame, sections: DataFrame, least: int = 3) -> DataFrame:
    """Mean similarities over all pairs of active sections with at least ``least`` notes, by track."""
    keys = ["track", "idx"]
    n = in_active(notes, sections)
    base = n.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("midi", F.lit(0.5)).alias("median"), F.stddev_pop("midi").alias("spread")).filter(F.col("n") >= least)
    hist = pc_histogram(n.join(base.select(*keys), keys, "left_semi"), keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pc", "share"))).alias("hist"))
    each = base.join(hist, keys).join(contour(n, keys), keys).join(inter_onset(n, keys), keys)
    a, b = each.alias("a"), each.alias("b")
    c = lambda x: (F.col(f"a.{x}"), F.col(f"b.{x}"))
    alike = lambda x: F.when((c(x)[0] > 0) & (c(x)[1] > 0), F.least(*c(x)) / F.greatest(*c(x))).otherwise(0.0)
    pairs = a.join(b, (F.col("a.track") == F.col("b.track")) & (F.col("a.idx") < F.col("b.idx")))
    chroma = F.aggregate(F.zip_with(F.col("a.hist"), F.col("b.hist"), lambda x, y: F.least(x["share"], y["share"])), F.lit(0.0), lambda acc, x: acc + x)
    steps = F.lit(1.0) - (F.abs(F.col("a.up") - F.col("b.up")) + F.abs(F.col("a.down") - F.col("b.down")) + F.abs(F.col("a.same") - F.col("b.same"))) / 2
    return pairs.groupBy(F.col("a.track").alias("track")).agg(
        F.count("*").alias("pairs"), F.round(F.avg(chroma), 6).alias("chroma_sim"), F.round(F.avg(steps), 6).alias("contour_sim"), F.round(F.avg(alike("ioi")), 6).alias("ioi_sim"), F.round(F.avg(alike("n")), 6).alias("density_sim"),
        F.round(F.avg(F.abs(c("median")[0] - c("median")[1])), 6).alias("median_gap"),
    )


def register_stability(notes: DataFrame) -> DataFrame:
    """Spread and large jumps of pitch, by track; nulls but ``checked`` below two notes."""
    w = Window.partitionBy("track").orderBy("onset_s", "note_id")
    d = notes.withColumn("jump", F.abs(F.lead("midi").over(w) - F.col("midi")))
    g = d.groupBy("track").agg(
        F.count("*").alias("checked"), F.round(F.stddev_pop("midi"), 4).alias("spread"), (F.max("midi") - F.min("midi")).alias("range"), F.count_if(F.col("jump") >= 10).alias("octave_jumps"), F.count_if(F.col("jump") >= 7).alias("large_jumps"), F.count("jump").alias("steps"), F.round(F.percentile("midi", F.lit(0.5)), 1).alias("median"), F.round(F.avg("midi"), 1).alias("mean")
    )
    enough = F.col("checked") >= 2
    pct = lambda x: F.round(ratio(100.0 * F.col(x), F.col("steps")), 1)
    made = {x: F.when(enough, F.col(x)) for x in ("spread", "range", "octave_jumps", "large_jumps", "median", "mean")}
    return g.select("track", "checked", *[v.alias(k) for k, v in made.items()], F.when(enough, pct("octave_jumps")).alias("octave_pct"), F.when(enough, pct("large_jumps")).alias("large_pct"))


def match_onsets(det: DataFrame, ref: DataFrame, tol: float = 0.05) -> DataFrame:
    """One-to-one matches: references in time order, each takes its nearest free detection within ``tol``; the earlier of equals.

    det, ref: track, t.  Returns n_ref, n_det, matched and P/R/F1 by track.
    """
    known = F.col("t").isNotNull()
    return match_onset_events(events_of(det.filter(known), ref.filter(known), "t").select("track", "t", "is_ref"), tol)


def match_onset_events(events: DataFrame, tol: float = 0.05) -> DataFrame:
    """``match_onsets`` of both sides in one table, which is read once: track, t, is_ref; events without a time count but match nothing."""
    return onset_scores(onset_counts(events, tol))


#: The variants of a note match: by onset alone, and with a pitch or a pitch class beside it.
PITCH = FITS


def _match_counts(det: DataFrame, ref: DataFrame, variants: list[str], tol: float) -> DataFrame:
    return match_counts(events_of(det, ref, "onset_s", "note_id", "midi"), variants, tol)


def match_notes(det: DataFrame, ref: DataFrame, variant: str = "onset", tol: float = 0.05) -> DataFrame:
    """One-to-one note matches by onset and, by variant, pitch within a semitone or pitch class within one.

    det, ref: track, onset_s, note_id, midi.  References in time order take
    the nearest free detection that fits; the earlier of equals.  Returns
    track, n_ref, n_det, matched, pitch_hits (matches with pitch within a
    semitone) and mean_error of onsets.
    """
    c = _match_counts(det, ref, [variant], tol)
    n = F.col(f"matched_{variant}")
    return c.select("track", "n_ref", "n_det", n.alias("matched"), F.col(f"pitch_hits_{variant}").alias("pitch_hits"), ratio(F.col(f"error_{variant}"), n).alias("mean_error"))


def transcription_summary(det: DataFrame, ref: DataFrame, tol: float = 0.05) -> DataFrame:
    """F1 of the three match variants, fragmentation, pitch accuracy and mean onset error of each track."""
    c = _match_counts(det, ref, list(PITCH), tol)
    n = F.col("matched_onset")
    score = lambda v: F.round(f1(ratio(F.col(f"matched_{v}"), F.col("n_det")), ratio(F.col(f"matched_{v}"), F.col("n_ref"))), 4).alias(f"f1_{v}")
    return c.select(
        "track", F.round(ratio(F.col("n_det"), F.col("n_ref")), 4).alias("fragmentation"), F.round(ratio(F.col("pitch_hits_onset"), n), 4).alias("pitch_accuracy"), F.round(ratio(F.col("error_onset"), n), 4).alias("mean_error"), *[score(v) for v in PITCH]
    )


def onset_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of match counts; an empty side gives 0, and no fp without detections, no fn without references."""
    p, r = ratio(F.col("matched"), F.col("n_det")), ratio(F.col("matched"), F.col("n_ref"))
    return counts.select("*", (F.col("n_det") - F.col("matched")).alias("fp"), (F.col("n_ref") - F.col("matched")).alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"))


# Metrics of an evaluation, by the count that says whether they were measured and how large it must be.
MEASURED = {
    ("activity_checked", 1): ["activity_f1", "silent_fp_rate"],
    ("pitch_class_checked", 1): ["in_scale_pct", "root_pc_pct"],
    ("register_checked", 2): ["octave_jump_pct"],
    ("range_checked", 1): ["in_range_pct", "below_range_pct"],
    ("ref_note_count", 1): ["note_f1", "note_f1_octave_invariant", "onset_f1", "pitch_accuracy", "fragmentation_ratio"],
}


def measured_metrics(evaluations: DataFrame) -> DataFrame:
    """(song, layer, metric, value, error): one row for each metric that an evaluation really measured.

    evaluations: song, layer, error, and the counts and metrics of MEASURED.  A
    metric whose count is null or too small, or that is null, gives no row.
    """
    pairs = [F.struct(F.lit(m).alias("metric"), F.when(F.col(count) >= least, F.col(m).cast("double")).alias("value")) for (count, least), names in MEASURED.items() for m in names]
    each = evaluations.select("song", "layer", "error", F.explode(F.array(*pairs)).alias("p"))
    return each.select("song", "layer", "p.metric", "p.value", "error").filter("value IS NOT NULL")


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """Mean, min, max and count of each metric over songs: results (song, layer, metric, value, error); rows with an error or no value are left out."""
    ok = results.filter(F.col("error").isNull() & F.col("value").isNotNull())
    value = F.when(F.col("metric") == "pitch_accuracy", F.col("value") * 100).otherwise(F.col("value"))
    return ok.groupBy("layer", "metric").agg(F.round(F.avg(value), 4).alias("mean"), F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max"), F.count("*").alias("n"))


# Metrics where less is better; all others count as more is better.
LOWER_IS_BETTER = ["below_range_pct", "octave_jump_pct", "silent_fp_rate"]


def compare_to_baseline(current: DataFrame, baseline: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Union of metrics of both sides with the change and a verdict: improved, regressed or same; unknown where a side lacks it."""
    c = current.select("layer", "metric", F.col("mean").alias("now"))
    b = baseline.select("layer", "metric", F.col("mean").alias("was"))
    j = c.join(b, ["layer", "metric"], "full_outer").withColumn("delta", F.round(F.col("now") - F.col("was"), 4))
    gain = F.when(F.col("metric").isin(LOWER_IS_BETTER), -F.col("delta")).otherwise(F.col("delta"))
    return j.withColumn("verdict", F.when(gain.isNull(), "skipped").when(gain > threshold, "improved").when(gain < -threshold, "regressed").otherwise("same"))


def layer_diagnostics(notes: DataFrame, duration: DataFrame) -> DataFrame:
    """Counts, density, coverage, durations, pitch, velocities, isolated notes and share of energy of each layer of a track.

    duration: track, duration_s.  The energy of a layer is the sum of velocity
    squared times duration, a stand-in for that of synthesised audio.
    """
    keys = ["track", "layer"]
    w = Window.partitionBy(*keys).orderBy("onset_s", "note_id")
    far = F.lit(1e9)
    n = notes.withColumns({"dur": F.col("offset_s") - F.col("onset_s"), "before": F.coalesce(F.col("onset_s") - F.lag("offset_s").over(w), far), "after": F.coalesce(F.lead("onset_s").over(w) - F.col("offset_s"), far)})
    active = F.sum(F.greatest(F.col("dur"), F.lit(0.0)))
    g = n.groupBy(*keys).agg(
        F.count("*").alias("n"),
        active.alias("active"),
        F.round(F.avg("dur"), 3).alias("mean_dur"),
        F.round(F.percentile("dur", F.lit(0.5)), 3).alias("median_dur"),
        F.min("midi").alias("midi_min"),
        F.max("midi").alias("midi_max"),
        F.round(F.avg("midi"), 1).alias("midi_mean"),
        F.round(F.percentile("midi", F.lit(0.5)), 1).alias("midi_median"),
        F.round(F.min("velocity"), 4).alias("velocity_min"),
        F.round(F.percentile("velocity", F.lit(0.1)), 4).alias("velocity_p10"),
        F.count_if((F.col("before") > 4) & (F.col("after") > 4)).alias("isolated"),
        F.sum(F.col("velocity") * F.col("velocity") * F.col("dur")).alias("energy"),
    ).join(duration, "track")
    total = F.sum("energy").over(Window.partitionBy("track"))
    share = F.round(F.when(total > 1e-12, 100.0 * F.col("energy") / total).otherwise(0.0), 2)
    g = g.withColumns({"energy_pct": share, "density": F.round(ratio(F.col("n").cast("double"), F.col("duration_s")), 4), "coverage_pct": F.round(100.0 * ratio(F.col("active"), F.col("duration_s")), 1)})
    return g.drop("active", "energy", "duration_s")


def diagnostic_warnings(layers: DataFrame, sources: DataFrame) -> DataFrame:
    """track, warnings: what is suspicious about a track's layers, sorted; a layer without notes counts as empty.

    layers: layer_diagnostics.  sources: track, vocals_source (how the vocal
    notes were found).
    """
    from ..functions.scalars import flags

    of = lambda layer, c, default: F.coalesce(F.max(F.when(F.col("layer") == layer, F.col(c))), F.lit(default)).alias(f"{layer}_{c}")
    wanted = [("drums", "energy_pct", 0.0), ("vocals", "coverage_pct", 0.0), ("vocals", "n", 0), ("vocals", "midi_mean", 0.0), ("bass", "coverage_pct", 0.0), ("bass", "n", 0), ("bass", "median_dur", 0.0), ("bass", "isolated", 0), ("bass", "velocity_min", 1.0)]
    g = sources.join(layers.groupBy("track").agg(*[of(*x) for x in wanted]), "track", "left").fillna({f"{a}_{b}": d for a, b, d in wanted})
    rules = (
        ("drums_dominate", F.col("drums_energy_pct") > 60),
        ("sparse_vocals", F.col("vocals_coverage_pct") < 20),
        ("sparse_bass", F.col("bass_coverage_pct") < 15),
        ("low_vocal_pitch", (F.col("vocals_n") > 0) & (F.col("vocals_midi_mean") < 55)),
        ("fragmented_bass", (F.col("bass_n") > 50) & (F.col("bass_median_dur") < 0.2)),
        ("basic_pitch_unavailable_or_failed", F.col("vocals_source") == "pyin"),
        ("many_isolated_bass_notes", F.col("bass_isolated") > 5),
        ("bass_velocity_floor_high", (F.col("bass_velocity_min") > 0.15) & (F.col("bass_n") > 20)),
    )
    return g.select("track", flags(*rules).alias("warnings"))
