"""Note clean-up: merging, octave correction, monophony, gating; keys and scales.

Greedy steps that depend on earlier decisions are ordered folds in the JVM, by
``aggregate`` over notes that hang together or over one layer of one track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pitch_class, quantile, ratio

MAJOR, MINOR = [0, 2, 4, 5, 7, 9, 11], [0, 2, 3, 5, 7, 8, 10]


# Seconds that a drum component sounds, and the least level of a hit.
DRUM_SECONDS = {"kick": 0.060, "snare": 0.040, "toms": 0.050, "hh": 0.015, "ride": 0.025, "crash": 0.080}
LEAST_HIT = 0.25


def midi_events(notes: DataFrame) -> DataFrame:
    """Adds start_s, end_s and a MIDI velocity of 1..127 in place of the level; notes without length are dropped.

    notes: layer, component, onset_s, offset_s, velocity (0..1).  Drums sound as
    long as their component does, unknown ones as long as a kick, and are at
    least LEAST_HIT loud; their offset_s isn't read.
    """
    drums = F.col("layer") == "drums"
    seconds = F.create_map(*[F.lit(x) for kv in DRUM_SECONDS.items() for x in kv])
    end = F.when(drums, F.col("onset_s") + F.coalesce(seconds[F.col("component")], F.lit(DRUM_SECONDS["kick"]))).otherwise(F.col("offset_s"))
    level = F.floor(F.when(drums, F.greatest("velocity", F.lit(LEAST_HIT))).otherwise(F.col("velocity")) * 127)
    return notes.filter(end > F.col("onset_s")).withColumns({"start_s": F.col("onset_s"), "end_s": end, "velocity": F.greatest(F.lit(1), F.least(F.lit(127), level)).cast("int")})


def estimate_key(hist: DataFrame) -> DataFrame:
    """Best diatonic template by Pearson correlation: track, root, mode, score.  hist: track, pc, share.

    The 24 templates are broadcast; ties go to the lower root, then major.
    """
    spark = hist.sparkSession
    rows = [(m, r, p, float((p - r) % 12 in d)) for m, d in (("major", MAJOR), ("minor", MINOR)) for r in range(12) for p in range(12)]
    t = spark.createDataFrame(rows, "mode string, root int, pc int, w double")
    s = hist.join(F.broadcast(t), "pc").groupBy("track", "root", "mode").agg(F.round(F.corr("share", "w"), 9).alias("score"))
    best = Window.partitionBy("track").orderBy(F.desc("score"), "root", "mode")
    return s.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def snap_to_scale(notes: DataFrame, key: DataFrame) -> DataFrame:
    """Moves each note to the nearest scale tone within two semitones; down on a tie, unmoved if none is near."""
    member = F.when(F.col("mode") == "minor", F.array(*map(F.lit, MINOR))).otherwise(F.array(*map(F.lit, MAJOR)))
    j = notes.join(key.select("track", "root", "mode"), "track")
    deltas = F.array(*[F.lit(d) for d in (0, -1, 1, -2, 2)])
    ok = F.filter(deltas, lambda d: F.array_contains(member, F.pmod(pitch_class(F.col("midi")) + d - F.col("root"), F.lit(12))))
    return j.withColumn("midi", F.col("midi") + F.coalesce(F.get(ok, F.lit(0)), F.lit(0))).select(notes.columns)


def fix_register(notes: DataFrame, lo: float = 34, hi: float = 55, floor: float = 28, top: float = 60) -> DataFrame:
    """Moves a whole track by an octave if its median is outside lo..hi, but just notes that land within floor..top."""
    m = notes.groupBy("track").agg(F.percentile("midi", F.lit(0.5)).alias("median"))
    shift = F.when(F.col("median") < lo, 12).when(F.col("median") > hi, -12).otherwise(0)
    moved = F.col("midi") + shift
    return notes.join(m, "track").withColumn("midi", F.when((moved >= floor) & (moved <= top), moved).otherwise(F.col("midi"))).select(notes.columns)


def octave_by_energy(midi: Column, at: Column, up: Column, down: Column, dur: Column, mean: Column) -> Column:
    """Octave decision by spectral energies at a pitch and an octave from it; short or weak notes stay."""
    skip = (dur < 0.06) | (at < 2 * mean)
    return F.when(skip, midi).when((up > 1.2 * at) & (midi + 12 <= 60), midi + 12).when((down > 1.5 * at) & (midi - 12 >= 28), midi - 12).otherwise(midi)


def merge_adjacent(notes: DataFrame, keys: list[str], max_gap: float = 0.08, max_step: float = 1.0) -> DataFrame:
    """Joins a note to the one before it if the gap to its running end is at most max_gap and the pitch near its first.

    A fold in the JVM over notes that no longer gap separates.  Returns the keys, onset_s, offset_s, midi, velocity.
    """
    note = "named_struct('onset_s', x.onset_s, 'offset_s', x.offset_s, 'midi', x.midi, 'velocity', x.velocity)"
    empty = "cast(array() AS array<struct<onset_s: double, offset_s: double, midi: double, velocity: double>>)"
    last = "element_at(acc, -1)"
    joined = f"named_struct('onset_s', {last}.onset_s, 'offset_s', greatest({last}.offset_s, x.offset_s), 'midi', {last}.midi, 'velocity', greatest({last}.velocity, x.velocity))"
    near = f"size(acc) > 0 AND x.onset_s - {last}.offset_s <= {max_gap}D AND abs(x.midi - {last}.midi) <= {max_step}D"
    fold = f"aggregate(ns, {empty}, (acc, x) -> if({near}, concat(slice(acc, 1, size(acc) - 1), array({joined})), concat(acc, array({note}))))"
    g = _islands(notes, keys, max_gap + 1e-9).groupBy(*keys, "__island").agg(F.array_sort(F.collect_list(F.struct("onset_s", "note_id", "offset_s", "midi", "velocity"))).alias("ns"))
    return g.select(*keys, F.explode(F.expr(fold)).alias("m")).select(*keys, "m.*")


def _islands(notes: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """Adds __island: a note that begins at least ``gap`` after all before it have ended begins a new one.

    Steps that look at overlapping notes only can fold each island by itself.
    """
    w = Window.partitionBy(*keys).orderBy("onset_s", "note_id")
    ended = F.max("offset_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return notes.withColumn("__new", F.coalesce((F.col("onset_s") - ended >= gap).cast("int"), F.lit(1))).withColumn("__island", F.sum("__new").over(w)).drop("__new")


def _fold(notes: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """Replaces the notes of each group, an array ``ns`` of (onset_s, note_id, note) in time order, by the array of notes that ``fold`` makes of it."""
    cols = [c for c in notes.columns if c != "__island"]
    g = notes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("onset_s", "note_id", F.struct(*cols).alias("note")))).alias("ns"))
    return g.select(F.explode(F.expr(fold)).alias("n")).select(*[F.col("n")[c].cast(notes.schema[c].dataType).alias(c) for c in cols])


def _with(cols: list[str], note: str, **new: str) -> str:
    """SQL of a note with some fields replaced."""
    return "named_struct(" + ", ".join(f"'{c}', {new.get(c, f'{note}.{c}')}" for c in cols) + ")"


def monophonic(notes: DataFrame, keys: list[str]) -> DataFrame:
    """No two notes overlap: the louder wins, the earlier on a tie; a louder later note cuts the one before it short.

    A fold in the JVM over notes that hang together.
    """
    last, x = "element_at(acc, -1)", "x.note"
    cut = _with(notes.columns, last, offset_s=f"round({x}.onset_s, 4)")
    rest = "slice(acc, 1, size(acc) - 1)"
    louder = f"if(round({x}.onset_s, 4) > {last}.onset_s, concat({rest}, array({cut}, {x})), concat({rest}, array({x})))"
    step = f"if(size(acc) = 0 OR {x}.onset_s >= {last}.offset_s, concat(acc, array({x})), if({x}.velocity > {last}.velocity, {louder}, acc))"
    return _fold(_islands(notes, keys), [*keys, "__island"], f"aggregate(ns, slice(transform(ns, x -> x.note), 1, 0), (acc, x) -> {step})")


def _shifted(pitch: str, cost: str, lo: float, hi: float) -> str:
    """SQL of the cheapest of a pitch, an octave down and an octave up within lo..hi, the first of equals: (c, k, m).  cost: SQL with {m}."""
    option = lambda k, m: f"struct(if({k} = 0 OR {m} BETWEEN {lo}D AND {hi}D, {cost.format(m=m)}, double('infinity')) AS c, {k} AS k, {m} AS m)"
    return f"array_min(array({option(0, pitch)}, {option(1, f'({pitch} - 12)')}, {option(2, f'({pitch} + 12)')}))"


def _refold(notes: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Folds the pitches ``ms`` of a group from left to right: ``step`` gives the i-th from those before it (acc, done) and the others."""
    cols = notes.columns
    fold = f"transform(array(transform(ns, x -> x.note.midi)), ms -> aggregate(sequence(0, size(ns) - 1), cast(array() AS array<double>), (acc, i) -> concat(acc, array({step}))))[0]"
    return _fold(notes, keys, f"transform(array({fold}), done -> transform(ns, (x, i) -> {_with(cols, 'x.note', midi='done[i]')}))[0]")


def octave_context(notes: DataFrame, keys: list[str], lo: float = 20, hi: float = 80, window: int = 5, gain: float = 6) -> DataFrame:
    """Moves a note by an octave, within lo..hi, if that brings it at least ``gain`` nearer to the median around it.

    Neighbours on the left are corrected already, those on the right aren't; a
    note with fewer than two stays.
    """
    near = f"array_sort(concat(slice(acc, greatest(size(acc) - {window - 1}, 1), {window}), slice(ms, i + 2, {window})))"
    median = "(n[cast((size(n) - 1) div 2 AS int)] + n[cast(size(n) div 2 AS int)]) / 2"
    best = _shifted("ms[i]", "abs({m} - md)", lo, hi)
    moved = f"transform(array({best}), b -> if(b.k > 0 AND abs(ms[i] - md) - b.c >= {gain}D, round(b.m, 2), ms[i]))[0]"
    return _refold(notes, keys, f"transform(array({near}), n -> if(size(n) < 2, ms[i], transform(array({median}), md -> {moved})[0]))[0]")


def octave_smooth(notes: DataFrame, keys: list[str], jump: float = 10, lo: float = 36, hi: float = 96) -> DataFrame:
    """Moves an inner note that jumps away from both neighbours by the octave, within lo..hi, that shortens the way, if one does."""
    before, after = "element_at(acc, -1)", "ms[i + 1]"
    best = _shifted("ms[i]", f"abs({{m}} - {before}) + abs({{m}} - {after})", lo, hi)
    moved = f"transform(array({best}), b -> if(b.k > 0, round(b.m, 2), ms[i]))[0]"
    return _refold(notes, keys, f"if(i = 0 OR i + 1 >= size(ms), ms[i], if(abs(ms[i] - {before}) < {jump}D OR abs(ms[i] - {after}) < {jump}D, ms[i], {moved}))")


def octave_dedup(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Of overlapping notes of one pitch class and different octaves the louder stays; the earlier on a tie.

    From left to right each note that is left drops its later twins up to the
    first louder one, which drops it.  A fold over notes that hang together.
    """
    pitch = lambda j: f"cast(bround(ns[{j}].note.midi) AS int)"
    twin = f"j > i AND keep[j] AND ns[j].note.onset_s < ns[i].note.offset_s AND pmod({pitch('j')}, 12) = pmod({pitch('i')}, 12) AND {pitch('j')} <> {pitch('i')}"
    drop = "transform(keep, (k, j) -> CASE WHEN j = i THEN w.louder IS NULL WHEN array_contains(w.twins, j) AND (w.louder IS NULL OR j < w.louder) THEN false ELSE k END)"
    twins = f"filter(sequence(0, size(ns) - 1), j -> {twin})"
    step = f"if(NOT keep[i], keep, transform(transform(array({twins}), t -> struct(t AS twins, get(filter(t, j -> ns[j].note.velocity > ns[i].note.velocity), 0) AS louder)), w -> {drop})[0])"
    kept = f"aggregate(sequence(0, size(ns) - 1), transform(ns, x -> true), (keep, i) -> {step})"
    return _fold(_islands(notes, keys), [*keys, "__island"], f"transform(array({kept}), keep -> transform(filter(ns, (x, i) -> keep[i]), x -> x.note))[0]")


def gate_and_prune(notes: DataFrame, rms: str, share: float = 0.3, gap: float = 4.0, weak: float = 0.25) -> DataFrame:
    """Drops notes below ``share`` of the 5th percentile of non-zero levels, then weak notes far from both neighbours."""
    level = notes.filter(F.col(rms) > 0).groupBy("track").agg(quantile(rms, 0.05).alias("p5"))
    loud = notes.join(level, "track", "left").filter(F.col("p5").isNull() | (F.col(rms) >= share * F.col("p5"))).drop("p5")
    w = Window.partitionBy("track").orderBy("onset_s", "note_id")
    far = F.lit(1e9)
    before, after = F.coalesce(F.col("onset_s") - F.lag("offset_s").over(w), far), F.coalesce(F.lead("onset_s").over(w) - F.col("offset_s"), far)
    return loud.withColumns({"__b": before, "__a": after}).filter(~((F.col("__b") > gap) & (F.col("__a") > gap) & (F.col("velocity") < weak))).drop("__b", "__a")


def rescale_velocity(notes: DataFrame, rms: str) -> DataFrame:
    """velocity = level / its 99th percentile, clipped; unchanged where that is next to 0."""
    p = notes.groupBy("track").agg(F.percentile(rms, F.lit(0.99)).alias("p99"))
    return notes.join(p, "track").withColumn("velocity", F.when(F.col("p99") >= 1e-8, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(F.col(rms), F.col("p99"))))).otherwise(F.col("velocity"))).drop("p99")


def _numbered(notes: DataFrame) -> DataFrame:
    return notes.withColumn("note_id", F.row_number().over(Window.partitionBy("track").orderBy("onset_s", "midi")).cast("long"))


def clean_vocals(notes: DataFrame, tracked: bool = False) -> DataFrame:
    """Vocal notes merged, then both octave corrections within 36..96; first made monophonic unless they come from a pitch track."""
    keys = ["track"]
    single = notes if tracked else monophonic(notes, keys)
    return octave_smooth(octave_context(_numbered(merge_adjacent(single, keys, 0.08)), keys, 36, 96), keys)


def clean_bass(notes: DataFrame, key: DataFrame | None = None, tracked: bool = False) -> DataFrame:
    """Bass notes merged, register fixed, octave context, snapped to the key's scale if one is given, levels rescaled; velocity stands for the level.

    Recognised notes lose octave twins first and are gated and pruned at the
    end; notes of a pitch track (``tracked``) are merged over longer gaps instead.
    """
    keys = ["track"]
    merged = merge_adjacent(notes, keys, 0.15) if tracked else merge_adjacent(octave_dedup(notes, keys), keys, 0.10)
    fixed = octave_context(fix_register(_numbered(merged), 34, 55), keys)
    fixed = (snap_to_scale(fixed, key) if key is not None else fixed).withColumn("rms", F.col("velocity"))
    scaled = rescale_velocity(fixed, "rms")
    return (scaled if tracked else gate_and_prune(scaled, "rms")).drop("rms")


def from_pitch(frames: DataFrame, beats: DataFrame, hop_s: float = 0.5, min_frames: int = 3, max_gap: int = 3) -> DataFrame:
    """Notes of a pitch track (track, frame_idx, t, midi, rms): runs, their level, velocity and nearest beat."""
    from .joins import beat_align, interval_join
    from .series import pitch_runs, robust01

    runs = pitch_runs(frames, "midi", min_frames, max_gap).select("track", (F.col("first") * hop_s).alias("start_s"), ((F.col("last") + 1) * hop_s).alias("end_s"), F.col("midi").cast("double").alias("midi"))
    level = interval_join(frames.select("track", "t", "rms"), runs, "t", 5.0).groupBy("track", "start_s", "end_s", "midi").agg(F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("level"))
    aligned = beat_align(robust01(level, "level", "velocity"), beats, "start_s")
    return aligned.select("track", F.col("start_s").alias("onset_s"), F.col("end_s").alias("offset_s"), "midi", "velocity", "beat_idx", "beat_phase")
