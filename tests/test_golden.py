"""Golden values of the operators on literals."""

import pytest
from pyspark.sql import functions as F

from cantus.functions import scalars as S
from cantus.operators import evaluation as E
from cantus.operators import joins as J
from cantus.operators import lyrics as L
from cantus.operators import notes as N
from cantus.operators import series as T
from cantus.operators import story as ST


def notes(spark, rows):
    """rows: (onset, offset, midi, velocity)"""
    return spark.createDataFrame([(1, i, float(a), float(b), float(m), float(v)) for i, (a, b, m, v) in enumerate(rows)], "track long, note_id long, onset_s double, offset_s double, midi double, velocity double")


def sections(spark, *rows):
    return spark.createDataFrame([(1, i, float(a), float(b), x, chr(65 + i)) for i, (a, b, x) in enumerate(rows)], "track long, idx int, start_s double, end_s double, active boolean, label string")


def test_half_open_interval(spark):
    n = notes(spark, [(2, 3, 60, 1), (4, 5, 60, 1)])
    got = J.interval_join(n, sections(spark, (2, 4, True)), "onset_s", 60.0).collect()
    assert [r["onset_s"] for r in got] == [2.0]


def test_activity(spark):
    n = notes(spark, [(i, i + 0.5, 60, 1) for i in range(5)] + [(20 + i, 20.5 + i, 60, 1) for i in range(5)])
    r = E.activity(n, sections(spark, (0, 10, False), (20, 30, True))).first()
    assert (r["fp"], r["silent_events"], r["precision"]) == (1, 5, 0.5)
    n = notes(spark, [(20 + i, 20.5 + i, 60, 1) for i in range(5)])
    r = E.activity(n, sections(spark, (0, 10, True), (20, 30, True))).first()
    assert (r["fn"], r["recall"]) == (1, 0.5)
    r = E.activity(n.limit(0), sections(spark, (0, 10, False))).first()
    assert (r["precision"], r["recall"]) == (1.0, 1.0)


def test_onset_match(spark):
    t = lambda xs: spark.createDataFrame([(1, float(x)) for x in xs], "track long, t double")
    r = E.match_onsets(t([1, 2, 3, 4]), t([1, 2, 5]), 0.05).first()
    assert (r["matched"], r["fp"], r["fn"]) == (2, 2, 1)
    r = E.match_onsets(t([1, 2]), t([]), 0.05).first()
    assert (r["matched"], r["precision"], r["recall"]) == (0, 0.0, 0.0)


def test_pitch_range(spark):
    r = E.pitch_range(notes(spark, [(0, 1, 30, 1), (1, 2, 43, 1), (2, 3, 60, 1)]), 38, 50).first()
    assert (r["in_pct"], r["below_pct"], r["above_pct"]) == (33.3, 33.3, 33.3)


def test_contour_and_register(spark):
    r = E.contour(notes(spark, [(i, i + 1, m, 1) for i, m in enumerate([40, 43, 43, 38])]), ["track"]).first()
    assert (r["up"], r["same"], r["down"]) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    r = E.register_stability(notes(spark, [(i, i + 1, 43 + 12 * (i % 2), 1) for i in range(10)])).first()
    assert (r["octave_jumps"], r["octave_pct"]) == (9, 100.0)
    r = E.register_stability(notes(spark, [(0, 1, 43, 1)])).first()
    assert r["checked"] == 1 and r["spread"] is None


def test_semitone_error(spark):
    r = E.pc_report(notes(spark, [(0, 1, 44, 1)]), 7, [7]).first()
    assert (r["root_pct"], r["neighbor_pct"]) == (0.0, 100.0)


def test_pc_report_rounds_whole_counts(spark):
    """Halves of the last digit: sums of shares fall on either side of them, whole counts don't."""
    import random

    rng, rows, want = random.Random(3), [], {}
    for track in range(300):
        inside = rng.choice([k for k in range(1, 80) if k * 1000 % 80 == 40])  # of 80 notes: a percent that ends in .x5
        midis = [rng.choice([4, 6, 7, 9, 11, 0, 2]) + 36 for _ in range(inside)] + [rng.choice([1, 3, 5, 8, 10]) + 36 for _ in range(80 - inside)]
        rows += [(track, float(m)) for m in midis]
        want[track] = (inside * 1000 + 40) // 80 / 10
    df = spark.createDataFrame(rows, "track long, midi double")
    assert {r["track"]: r["scale_pct"] for r in E.pc_report(df, 4, [6, 7, 9, 11, 0, 2]).collect()} == want
    none = E.pc_report(spark.createDataFrame([(1, None)], "track long, midi double"), 4, [6]).first()
    assert (none["dominant"], none["root_pct"], none["overlap"]) == (None, 0.0, 0.0)


def test_quantile_to_the_last_bit(spark):
    """Against DuckDB's quantile_cont, bit by bit."""
    import random

    import duckdb

    rng = random.Random(5)
    rows = [(g, round(rng.expovariate(0.02), 2)) for g in range(400) for _ in range(1 + g % 97)] + [(900, None), (901, None), (901, 2.5)]
    df = spark.createDataFrame(rows, "g long, v double").groupBy("g").agg(S.quantile("v", 0.99).alias("a"), S.quantile("v", 0.05).alias("b"), S.quantile("v", 0.5).alias("c"))
    values = ", ".join(f"({g}, {'NULL' if v is None else repr(v)}::DOUBLE)" for g, v in rows)
    want = duckdb.sql(f"SELECT g::BIGINT, quantile_cont(v, 0.99), quantile_cont(v, 0.05), quantile_cont(v, 0.5) FROM (VALUES {values}) t(g, v) GROUP BY g").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_gate_at_a_share_of_the_quantile(spark):
    """A note at 0.3 times the 5th percentile to the last bit stays, one below it doesn't, as in SQL."""
    import random

    import duckdb

    rng, levels = random.Random(11), {}
    while len(levels) < 40:
        vs = [round(rng.uniform(1, 300), 2) for _ in range(rng.choice([29, 34, 56]))]
        low = duckdb.sql(f"SELECT 0.3::DOUBLE * quantile_cont(v, 0.05) FROM (SELECT unnest({[0.001, *vs]}::DOUBLE[]) AS v)").fetchall()[0][0]
        if low > 0.001 and low < min(vs):
            levels[len(levels)] = [low, *vs]
    rows = [(t, i, 10.0 * i, 10.0 * i + 9, 60.0, v) for t, vs in levels.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "track long, note_id long, onset_s double, offset_s double, midi double, velocity double")
    kept = {(r["track"], r["note_id"]) for r in N.gate_and_prune(df, "velocity").collect()}
    values = ", ".join(f"({t}, {i}, {v!r}::DOUBLE)" for t, i, _, _, _, v in rows)
    want = duckdb.sql(f"WITH n AS (FROM (VALUES {values}) t(track, i, v)), p AS (SELECT track, quantile_cont(v, 0.05) AS p5 FROM n GROUP BY track) SELECT track, i FROM n JOIN p USING (track) WHERE v >= 0.3::DOUBLE * p5").fetchall()
    assert kept == set(want) and len(kept) > len(rows) - 40


def test_gap_merge(spark):
    def runs(gap):
        rows = [(1, i, 33.0) for i in range(10)] + [(1, 10 + i, None) for i in range(gap)] + [(1, 10 + gap + i, 33.0) for i in range(10)]
        return T.pitch_runs(spark.createDataFrame(rows, "track long, frame_idx int, midi double"), "midi", 3, 3).collect()

    assert [r["midi"] for r in runs(2)] == [33] and len(runs(5)) == 2


def pitches(df):
    return [r["midi"] for r in df.orderBy("onset_s", "note_id").collect()]


def test_octave_steps(spark):
    seq = lambda ms: notes(spark, [(i, i + 0.5, m, 0.5) for i, m in enumerate(ms)])
    assert pitches(N.octave_dedup(notes(spark, [(0, 1, 34, 0.6), (0.1, 1, 46, 0.3)]), ["track"])) == [34.0]
    assert pitches(N.octave_dedup(notes(spark, [(0, 2, 34, 0.3), (0.1, 1, 46, 0.2), (0.2, 3, 58, 0.6), (0.3, 1, 46, 0.1), (3, 4, 34, 0.1)]), ["track"])) == [58.0, 34.0]
    assert pitches(N.octave_context(seq([34, 35, 46, 32, 34]), ["track"]))[2] == 34.0
    assert pitches(N.octave_context(seq([34, 38, 46, 44, 40]), ["track"])) == [34, 38, 46, 44, 40]
    assert pitches(N.octave_smooth(seq([50, 63, 51]), ["track"])) == [50, 51, 51]
    assert pitches(N.octave_smooth(seq([28, 40, 29]), ["track"])) == [28, 40, 29]  # an octave down would be below 36
    assert pitches(N.octave_smooth(seq([50]), ["track"])) == [50] and N.octave_smooth(seq([]), ["track"]).count() == 0


def test_monophonic_has_no_overlap(spark):
    got = N.monophonic(notes(spark, [(a, b, 60, v) for a, b, v in [(0, 2, 0.5), (1, 3, 0.9), (1.5, 4, 0.2), (3, 5, 0.1), (3, 6, 0.4)]]), ["track"]).orderBy("onset_s").collect()
    assert [(x["onset_s"], x["offset_s"]) for x in got] == [(0, 1), (1, 3), (3, 6)]


def test_merge_adjacent_uses_the_running_end_and_first_pitch(spark):
    got = N.merge_adjacent(notes(spark, [(0, 5, 60, 0.2), (1, 2, 61, 0.9), (5.05, 6, 61, 0.1), (6.05, 7, 62, 0.1)]), ["track"]).orderBy("onset_s").collect()
    assert [(r["onset_s"], r["offset_s"], r["midi"], r["velocity"]) for r in got] == [(0, 6, 60, 0.9), (6.05, 7, 62, 0.1)]


def test_merge_sections(spark):
    rows = [(1, i, 10.0 * i, 10.0 * i + 10, r, 0.1) for i, r in enumerate("AABA")]
    got = ST.merge_sections(spark.createDataFrame(rows, "track long, idx int, start_s double, end_s double, role string, novelty_to_next double")).orderBy("sec").collect()
    assert len(got) == 3 and (got[0]["start_s"], got[0]["end_s"]) == (0, 20)


def test_novelty_peaks_between_blocks(spark):
    b = spark.createDataFrame([(1, i, [1.0, 0.0] if i < 50 else [0.0, 1.0]) for i in range(100)], "track long, beat_idx long, vec array<double>")
    best = T.checkerboard_novelty(b, 10).orderBy(F.desc("novelty"), "beat_idx").first()
    assert 40 <= best["beat_idx"] <= 60 and best["novelty"] == 1.0


def revised(spark, rows):
    """rows: (role, intensity_rank, {role: score})"""
    cols = ["track long", "idx int", "role string", "intensity_rank double", *[f"s_{r} double" for r in ST.ROLES]]
    data = [(1, i, role, rank, *[float(sc.get(r, 0.1)) for r in ST.ROLES]) for i, (role, rank, sc) in enumerate(rows)]
    return [r["role"] for r in ST.revise_roles(spark.createDataFrame(data, ", ".join(cols))).orderBy("idx").collect()]


def test_role_revision(spark):
    assert revised(spark, [("valley", 0.2, {}), ("valley", 0.9, {}), ("valley", 0.3, {})]) == ["valley", "payoff", "valley"]
    # The most intense section is an outro, so the next one becomes the payoff.
    assert revised(spark, [("intro", 0.1, {}), ("valley", 0.4, {}), ("contrast", 0.6, {}), ("outro", 1.0, {})]) == ["intro", "valley", "payoff", "outro"]
    got = revised(spark, [("outro", 0.1, {"valley": 0.9}), ("intro", 0.2, {}), ("intro", 0.3, {"contrast": 0.5}), ("payoff", 0.9, {})])
    assert got == ["valley", "intro", "contrast", "payoff"]
    # Without another score above 0 it is a valley; a build needs a payoff in the next two.
    none = dict.fromkeys(ST.ROLES, 0.0)
    assert revised(spark, [("build", 0.1, none), ("valley", 0.2, {}), ("valley", 0.2, {}), ("payoff", 0.9, {})])[0] == "valley"
    assert revised(spark, [("valley", 0.1, {}), ("build", 0.2, {}), ("valley", 0.2, {}), ("payoff", 0.9, {})])[1] == "build"


def test_visual_behaviour(spark):
    rows = [(1, i, 10.0 * i, 10.0 * i + 10, r) for i, r in enumerate(["intro", "valley", "payoff", "build", "valley", "payoff", "contrast", "outro", None])]
    got = [r["behaviour"] for r in ST.visual_behaviour(spark.createDataFrame(rows, "track long, idx int, start_s double, end_s double, role string")).orderBy("idx").collect()]
    assert got == ["establish_world", "develop_motion", "release_payoff", "build_tension", "strip_down", "sustain_euphoria", "contrast_reset", "close_out", "develop_motion"]


def test_first_sounds(spark):
    words = {"knee": "nasal", "gnaw": "nasal", "write": "approximant", "What": "approximant", "the": "fricative", "shop": "fricative", "psalm": "vowel", "ghost": "vowel", "chair": "affricate", "judge": "affricate", "city": "fricative", "cat": "plosive", "queen": "plosive", "xylo": "fricative",
             "'big": "plosive", "very": "unknown", "12": "unknown", "apple": "vowel", "you": "approximant", "c": "plosive"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r[0]: r[1] for r in df.select("word", L.first_sound(F.col("word"))).collect()} == words
    leads = {r[0]: r[1] for r in df.select("word", L.sound_lead_in(F.col("word"))).collect()}
    assert (leads["cat"], leads["chair"], leads["very"], leads["apple"]) == (0.055, 0.045, 0.04, 0.005)


def test_quality_flags(spark):
    rows = [(0.6, 10, 4, 0.3, False, 0.03, 1), (0.7, 10, 3, 0.06, False, 0.01, 0), (None, None, None, None, None, None, 0), (0.9, 0, 0, 0.3, True, 0.0, 0), (0.9, 5, 0, 0.01, False, 0.0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "song int, matched_word_ratio double, lines_total int, lines_fallback int, offset_s double, applied boolean, improvement double, backend_errors int")
    got = [r["flags"] for r in L.quality_flags(df).orderBy("song").collect()]
    first = ["backend_fallback_used", "large_global_offset_detected", "low_word_match_ratio", "many_lines_without_whisper_coverage", "offset_not_applied_low_confidence"]
    assert got == [first, ["offset_detected_but_not_applied"], [], ["large_global_offset_detected"], []]


def test_diagnostic_warnings(spark):
    bass = [(1, i, i * 10.0, i * 10.0 + 0.1, 40.0, 0.5, "bass") for i in range(51)]
    df = spark.createDataFrame([*bass, (1, 99, 0.0, 1.0, 50.0, 0.1, "vocals"), (1, 100, 0.0, 100.0, 36.0, 1.0, "drums"), (2, 1, 0.0, 10.0, 60.0, 0.5, "vocals"), (2, 2, 0.0, 10.0, 40.0, 0.1, "bass")], "track long, note_id long, onset_s double, offset_s double, midi double, velocity double, layer string")
    layers = E.layer_diagnostics(df, spark.createDataFrame([(1, 520.0), (2, 10.0)], "track long, duration_s double"))
    got = {r["track"]: r["warnings"] for r in E.diagnostic_warnings(layers, spark.createDataFrame([(1, "pyin"), (2, "basic_pitch"), (3, None)], "track long, vocals_source string")).collect()}
    assert got[1] == ["basic_pitch_unavailable_or_failed", "bass_velocity_floor_high", "drums_dominate", "fragmented_bass", "low_vocal_pitch", "many_isolated_bass_notes", "sparse_bass", "sparse_vocals"]
    assert got[2] == [] and got[3] == ["sparse_bass", "sparse_vocals"]


def test_tidy_and_components(spark):
    from cantus.sources import files

    rows = [(".DS_Store", False, None), ("0123456789abcdef", True, False), ("song", True, True), ("song2", True, False), ("A.MP4", False, None), ("a.wav", False, None), ("notes", False, None), (".exports", True, None)]
    df = spark.createDataFrame([(n, n, d, h) for n, d, h in rows], "path string, name string, is_dir boolean, has_analysis boolean")
    assert {r["name"]: r["action"] for r in files.tidy_plan(df).collect()} == {".DS_Store": "skip", "0123456789abcdef": "legacy", "song": "legacy", "song2": "skip", "A.MP4": "export", "a.wav": "scratch", "notes": "scratch", ".exports": "skip"}
    gm = spark.createDataFrame([(n,) for n in (35, 40, 46, 48, 50, 53, 55, 57, 59)], "n int")
    assert [r[0] for r in gm.orderBy("n").select(files.gm_component(F.col("n"))).collect()] == ["kick", "snare", "hh", "toms", "kick", "kick", "kick", "crash", "ride"]


def test_labels(spark):
    n = [0, 25, 26, 51, 52, 701, 702, 703, 18277, 18278]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").orderBy("n").select(S.section_label(F.col("n"))).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAB", "ZZZ", "AAAA"]


def test_drum_hits(spark):
    level = lambda c, i: 0.0 if c == "toms" else 1.0 if i % 10 == 5 else 0.1
    rows = [(1, c, i, i * 0.5, (1.0 if i % 10 == 5 else 0.0), level(c, i)) for c in ("kick", "hh", "toms", "cowbell") for i in range(40)]
    from cantus.operators import hits as H

    got = H.drum_hits(spark.createDataFrame(rows, "track long, component string, frame_idx int, t double, strength double, level double"))
    assert sorted((r["component"], r["frame_idx"], r["velocity"]) for r in got.collect()) == sorted((c, i, 1.0) for c in ("kick", "hh") for i in (5, 15, 25, 35))
    on = spark.createDataFrame([(1, 0.0, 2.0, 5.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, 5.0, 5.0), (1, 2.0, 0.0, 0.0, 0.0, 1.0)], "track long, t double, level double, kick double, snare double, hh double")
    assert [(r["component"], r["velocity"]) for r in H.drum_hits_from_bands(on).orderBy("t").collect()] == [("kick", 1.0), ("snare", 0.5051), ("hh", 0.0)]


def test_long_track_stays_linear(spark):
    """One track of 200,000 rows: both directions of the as-of join are one pass."""
    import time

    p = spark.range(200_000).select(F.lit(1).cast("long").alias("track"), (F.col("id") * 0.01).alias("t"))
    began = time.time()
    assert J.nearest(p, p.withColumn("r", F.col("t") + 0.004).select("track", F.col("r").alias("t")), "t", "t").agg(F.count("near")).first()[0] == 200_000
    assert time.time() - began < 30


def test_lrc(spark):
    df = spark.createDataFrame([(1, "[00:10.50] Hello world\n[00:15.00] Goodbye friend"), (2, "x\n[01:02.345]a"), (3, "[00:01.00]one\n[00:02.00]\n[00:09.00] two")], "song long, text string")
    got = [tuple(r) for r in L.parse_lrc(df).orderBy("song", "start_s").select("song", "text", "start_s", "end_s").collect()]
    assert got == [(1, "Hello world", 10.5, 15.0), (1, "Goodbye friend", 15.0, 20.0), (2, "a", 62.345, 67.345), (3, "one", 1.0, 2.0), (3, "two", 9.0, 14.0)]


def test_spelling_variant():
    assert L.align_lists(["my", "colour", "is"], ["my", "color", "is"]) == [0, 1, 2]
    assert L.align_lists(["my", "house"], ["my", "zebra"]) == [0, None]
    assert L.similarity("", "a") == 0 and L.similarity("a", "a") == 1
    assert L.forced_partners(["hello", "xx", "world"], ["helo", "wrld"]) == [0, None, 1]
    assert L.forced_partners(["a1", "b1"], ["zz", "a1", "b1"]) == [None, None]  # the cursor waits for its word


def test_correction_quality(spark):
    r = L.alignment_quality(spark.createDataFrame([(1, 1.1, 1.0), (1, 2.1, 2.0)], "song long, start_s double, original_start_s double")).first()
    assert (r["mean_abs"], r["median_abs"], r["within_200"], r["offset"]) == (0.1, 0.1, 100.0, 0.1)


def test_box_smooth_divides_by_the_window(spark):
    f = spark.createDataFrame([(1, i, 1.0) for i in range(4)], "track long, frame_idx int, x double")
    got = [r[0] for r in f.select(T.box_smooth(F.col("x"), 4), "frame_idx").orderBy("frame_idx").collect()]
    assert got == [0.5, 0.75, 1.0, 0.75]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.note_name(F.lit(60.0))) == "C4" and get(S.pitch_class(F.lit(-1.0))) == 11
    assert [get(S.fold_register(F.lit(float(m)))) for m in (28, 41, 66, 90)] == [52, 41, 54, 54]
    assert [get(S.section_label(F.lit(i))) for i in (0, 25, 26, 27)] == ["A", "Z", "AA", "AB"]
    assert get(S.hz_to_midi(F.lit(440.0))) == 69 and get(S.octave_distance(F.lit(1), F.lit(11))) == 2


def test_as_of_sides(spark):
    p = spark.createDataFrame([(1, 1.0), (1, 2.5)], "track long, t double")
    r = spark.createDataFrame([(1, 1.0), (1, 3.0)], "track long, r double")
    get = lambda **k: [x["ref"] for x in J.as_of(p, r, "t", "r", **k).orderBy("t").collect()]
    assert get() == [1.0, 1.0] and get(inclusive=False) == [None, 1.0]
    assert get(forward=True) == [1.0, 3.0] and get(forward=True, inclusive=False) == [3.0, 3.0]


def test_note_match_variants(spark):
    det = notes(spark, [(1.0, 2, 60, 1), (2.0, 3, 72, 1), (3.0, 4, 65, 1)])
    ref = notes(spark, [(1.01, 2, 60, 1), (2.02, 3, 60, 1), (3.0, 4, 60, 1), (9.0, 10, 60, 1)])
    got = {v: E.match_notes(det, ref, v).first()["matched"] for v in E.PITCH}
    assert got == {"onset": 3, "pitch": 1, "class": 2}


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_brute_force(spark, seed):
    """Dense events, repeated times, equal distances, missing and odd pitches: every variant against all pairs."""
    import random

    rng = random.Random(seed)
    pitch = lambda: rng.choice([None, 60.5, float("nan"), *map(float, range(55, 80))])
    make = lambda n: [(rng.randrange(3), rng.randrange(10**6), rng.choice([rng.randrange(400) / 64, rng.uniform(0, 7)]), pitch()) for _ in range(n)]
    det, ref = make(700), make(700)
    frame = lambda rows: spark.createDataFrame(rows, "track long, note_id long, onset_s double, midi double")
    close = {"onset": lambda d, r: True, "pitch": lambda d, r: abs(d - r) <= 1, "class": lambda d, r: min(int(abs(d - r) + 0.5) % 12, 12 - int(abs(d - r) + 0.5) % 12) <= 1}
    for v, fits in close.items():
        got = {r["track"]: r for r in E.match_notes(frame(det), frame(ref), v, 0.1).collect()}
        for track in range(3):
            mine = lambda rows: sorted([r for r in rows if r[0] == track], key=lambda r: (r[2], r[1]))  # noqa: B023, E731
            ds, used, hits, errors = mine(det), set(), 0, []
            for _, _, t, m in mine(ref):
                real = lambda x: x is not None and x == x
                free = [(abs(d[2] - t), i) for i, d in enumerate(ds) if i not in used and abs(d[2] - t) <= 0.1 and (v == "onset" or (real(d[3]) and real(m) and fits(d[3], m)))]
                if free:
                    e, i = min(free)
                    used.add(i)
                    errors.append(e)
                    hits += real(ds[i][3]) and real(m) and abs(ds[i][3] - m) <= 1
            r = got[track]
            assert (r["n_det"], r["matched"], r["pitch_hits"]) == (len(ds), len(used), hits) and r["mean_error"] == pytest.approx(sum(errors) / len(errors))
        assert v != "onset" or {t: r["matched"] for t, r in got.items()} == {r["track"]: r["matched"] for r in E.match_onsets(frame(det).withColumnRenamed("onset_s", "t"), frame(ref).withColumnRenamed("onset_s", "t"), 0.1).collect()}


def test_matching_is_linear_where_events_are_dense():
    """All events of a track within the tolerance of each other: 40,000 pairs, which took their product of steps."""
    import time

    from cantus.operators.matching import Track

    track, at = Track(["onset", "pitch", "class"], 10.0), time.process_time()
    for i in range(80_000):
        track.add(i * 1e-5, i % 2 == 1, 28.0 + i % 60)
    assert track.row()[:3] == (40_000, 40_000, 40_000) and time.process_time() - at < 60


@pytest.mark.parametrize("seed", range(3))
def test_onsets_in_stretches_equal_brute_force(seed):
    """Repeated times, equal distances, distances that rounding makes equal: cut anywhere, the counts of all pairs."""
    import random

    import numpy as np

    from cantus.operators.matching import Onsets

    rng = random.Random(seed)
    draws = [lambda: rng.randrange(40) / 16, lambda: rng.uniform(0, 5), lambda: rng.randrange(8) * 0.1, lambda: rng.choice([-1, 1]) * (rng.randrange(3) * 0.1 + rng.randrange(4) * 1e-17)]
    for draw in draws * 50:
        tol, ds, used, rs = rng.choice([0.0, 0.1, 0.2, 1.0]), sorted(draw() for _ in range(rng.randrange(60))), set(), sorted(draw() for _ in range(rng.randrange(60)))
        for r in rs:
            free = [(abs(d - r), i) for i, d in enumerate(ds) if i not in used and abs(d - r) <= tol]
            used |= {min(free)[1]} if free else set()
        events = sorted([(d, rng.random(), False) for d in ds] + [(r, rng.random(), True) for r in rs])
        o = Onsets(tol)
        while events:
            part, events = events[: (k := rng.randrange(1, 12))], events[k:]
            o.add(np.array([t for t, _, _ in part]), np.array([x for _, _, x in part]))
        assert o.row() == (len(rs), len(ds), len(used))


def test_onset_match_of_a_dense_track(spark):
    """Two million events within one tolerance, a fifth of them references: what is held isn't looked through again."""
    import time

    e = spark.range(2_000_000).select(F.lit(1).alias("track"), (F.col("id") * 1e-9).alias("t"), (F.col("id") % 5 == 0).alias("ref"))
    at = time.monotonic()
    r = E.match_onsets(e.filter("NOT ref"), e.filter("ref"), 0.2).collect()
    assert [(x["n_ref"], x["n_det"], x["matched"]) for x in r] == [(400_000, 1_600_000, 400_000)] and time.monotonic() - at < 25


def test_onset_match_reads_events_once(spark):
    from cantus.plans.q_eval import QUERIES

    plan = QUERIES["onset_match"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_onset_match_of_odd_events_equals_sql(spark, tmp_path):
    """Tracks with one side, events without a time or a user."""
    import duckdb

    from cantus.plans.q_eval import QUERIES

    f, sql = QUERIES["onset_match"]
    db = duckdb.connect()
    db.sql(f"""COPY (SELECT event_id, CASE WHEN event_id % 89 > 0 THEN ts END AS ts, CASE WHEN event_id % 97 > 0 THEN user_id END AS user_id, CASE WHEN (user_id % 10, event_type) IN ((3, 'view'), (4, 'click')) THEN 'error' ELSE event_type END AS event_type, value, props
        FROM '/root/testdata/sf0.01/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = f(spark, str(tmp_path))
    want = sorted(db.sql(sql).select(*got.columns).fetchall(), key=repr)
    assert len(want) == 8 and sorted(map(tuple, got.collect()), key=repr) == want


def test_line_merge_falls_back_to_proportional_times(spark):
    lines = spark.createDataFrame([(1, 0, "one two", 0.0, 2.0), (1, 1, "three four", 10.0, 12.0)], "track long, idx int, text string, start_s double, end_s double")
    heard = spark.createDataFrame([(1, "One!", 0.5, 0.8), (1, "two", 1.0, 1.4)], "track long, word string, start_s double, end_s double")
    got = {(r["idx"], r["word_idx"]): (r["start_s"], r["end_s"], r["confidence"]) for r in L.merge_lines(lines, heard).collect()}
    assert got[0, 0] == (0.5, 0.8, 1.0) and got[0, 1] == (1.0, 1.4, 1.0)
    assert got[1, 0][0] == 10.0 and got[1, 1][2] == 0.65 and got[1, 1][1] <= 12.0


def test_fallback_chain(spark):
    make = lambda rows: spark.createDataFrame(rows, "song long, word string")
    songs = spark.createDataFrame([(1,), (2,), (3,), (3,)], "song long")
    got = L.fallback_chain(songs, [("synced", make([(1, "a"), (1, "b")])), ("merge", make([(1, "c"), (2, "d")])), ("proportional", make([(2, "e"), (4, "f")]))])
    assert sorted((r["song"], r["tier"], r["word"] or "") for r in got.select("song", "tier", "word").collect()) == [(1, "synced", "a"), (1, "synced", "b"), (2, "merge", "d"), (3, "error", "")]


def test_forced_alignment(spark):
    lines = spark.createDataFrame([(1, 0, "one two three", 0.0, 9.0), (1, 1, "four", 10.0, 12.0), (2, 0, "none heard", 0.0, 4.0), (3, 0, "  ", 0.0, 1.0)], "track long, idx int, text string, start_s double, end_s double")
    heard = spark.createDataFrame([(1, 1, "One", 1.0, 2.0, 0.8), (1, 2, "threes", 5.0, 6.0, 0.7), (1, 3, "four!", 10.5, 11.0, 0.9)], "track long, pos int, word string, start_s double, end_s double, confidence double")
    got = {(r["track"], r["word"]): (r["start_s"], r["end_s"], r["confidence"]) for r in L.forced_alignment(lines, heard).collect()}
    assert got == {(1, "one"): (1.0, 2.0, 0.8), (1, "two"): (2.0, 5.0, 0.65), (1, "three"): (5.0, 6.0, 0.7), (1, "four"): (10.5, 11.0, 0.9), (2, "none"): (0.0, pytest.approx(4 * 4 / 9 * 0.95, abs=1e-5), 0.65), (2, "heard"): (pytest.approx(16 / 9, abs=1e-5), 4.0, 0.65)}
    assert L.forced_alignment(lines.limit(0), heard).count() == 0


def test_lyric_activity(spark):
    seg = spark.createDataFrame([(1, 0, "ab cd", 0.0, 4.0), (1, 1, "ef", 3.0, 8.0)], "track long, idx int, text string, start_s double, end_s double")
    words = spark.createDataFrame([(1, 0, 0, "ab", 1.0, 2.0, 0.5), (1, 0, 1, "cd", 2.5, 3.0, 0.7), (1, 1, 0, "ef", 3.0, 5.0, 0.9)], "track long, idx int, word_idx int, word string, start_s double, end_s double, confidence double")
    times = spark.createDataFrame([(1, t) for t in (0.5, 1.5, 2.2, 3.5, 4.0, 9.0, 9.0)], "track long, t double")
    got = [tuple(r) for r in L.lyric_activity(times, seg, words).orderBy("t").select("active_segment", "active_word", "active_word_index", "word_confidence", "word_progress", "word_active", "phrase_active").collect()]
    none = ("", "", -1, 0.0, 0.0, False, False)
    assert got == [("ab cd", "", -1, 0.0, 0.0, False, True), ("ab cd", "ab", 0, 0.5, 0.5, True, True), ("ab cd", "ab", 0, 0.5, 1.0, True, True), ("ab cd", "cd", 1, 0.7, 1.0, True, True), ("ef", "ef", 0, 0.9, 0.5, True, True), none, none]


def test_lag_correlation(spark):
    x = [0.0] * 60
    x[20], x[40] = 1.0, 2.0
    make = lambda v: spark.createDataFrame([(1, i, y) for i, y in enumerate(v)], "track long, frame_idx int, x double")
    assert T.lag_correlation(make(x), make(x[-7:] + x[:-7]), 20).first()["lag"] == 7
    assert T.lag_correlation(make(x), make(x), 20, 9).first()["lag"] == 0
    flat = T.lag_correlation(make([1.0] * 30), make(x[:30]), 5).first()
    assert (flat["lag"], flat["corr"], flat["corr0"]) == (0, 0.0, 0.0)


def test_midi_events_and_voiced(spark):
    df = spark.createDataFrame([("vocals", None, 1.0, 1.0, 0.5), ("bass", None, 1.0, 2.0, 2.0), ("drums", "crash", 1.0, None, 0.1), ("drums", "gong", 1.0, None, 0.5), ("bass", None, 3.0, 4.0, 0.0)], "layer string, component string, onset_s double, offset_s double, velocity double")
    got = sorted((r["layer"], r["velocity"], round(r["end_s"] - r["start_s"], 3)) for r in N.midi_events(df).collect())
    assert got == [("bass", 1, 1.0), ("bass", 127, 1.0), ("drums", 31, 0.08), ("drums", 63, 0.06)]
    f = spark.createDataFrame([(1, i, v, fl, p) for i, (v, fl, p) in enumerate([(1.0, True, 0.9), (0.05, True, 0.9), (1.0, None, 0.9), (1.0, True, 0.1), (0.9, True, 0.8)])], "track long, frame_idx int, rms double, flag boolean, prob double")
    assert [r["voiced"] for r in T.voiced(f, "rms", "flag", "prob", 0.8).orderBy("frame_idx").collect()] == [True, False, False, False, True]


def test_measured_metrics(spark):
    cols = ["activity_checked", "pitch_class_checked", "register_checked", "range_checked", "ref_note_count"]
    names = [m for ms in E.MEASURED.values() for m in ms]
    df = spark.createDataFrame([(1, "bass", None, 1, 0, 1, 1, None, *[0.5] * len(names))], "song int, layer string, error string, " + ", ".join(f"{c} int" for c in cols) + ", " + ", ".join(f"{m} double" for m in names))
    assert sorted(r["metric"] for r in E.measured_metrics(df).collect()) == ["activity_f1", "below_range_pct", "in_range_pct", "silent_fp_rate"]


def test_mix_frame_and_blend(spark):
    st = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "track int, loud double, onset double, tension double, drop double, buildup double, boundary double")
    a, b = ST.mix_frame(st).orderBy("track").collect()
    assert (round(a["story_mix"], 6), round(a["radius"], 6), a["orb_alpha"], a["rays"], a["grain"], a["ray_alpha"]) == (0.7, 0.58, 255, 32, 70.0, 160)
    assert (b["story_mix"], b["brightness"], b["radius"], b["orb_alpha"], b["rays"]) == (0.15, 0.5, 0.08, 90, 0)
    sec = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0)], "track long, idx int, start_s double, end_s double")
    t = spark.createDataFrame([(1, x) for x in (5.0, 9.25, 10.0, 25.0)], "track long, t double")
    assert [(r["section"], r["blend"]) for r in ST.palette_blend(t, sec).orderBy("t").collect()] == [(0, 0.0), (0, 0.5), (1, 0.0), (1, 0.0)]



def test_compare_directions(spark):
    make = lambda rows: spark.createDataFrame(rows, "layer string, metric string, mean double")
    now = make([("bass", "f1", 0.5), ("bass", "octave_jump_pct", 5.0), ("bass", "new", 1.0), ("bass", "same", 1.0)])
    was = make([("bass", "f1", 0.6), ("bass", "octave_jump_pct", 7.0), ("bass", "gone", 1.0), ("bass", "same", 1.01)])
    got = {r["metric"]: r["verdict"] for r in E.compare_to_baseline(now, was).collect()}
    assert got == {"f1": "regressed", "octave_jump_pct": "improved", "new": "skipped", "gone": "skipped", "same": "same"}


def test_valley_boundaries(spark):
    # Loud, quiet from 30 s to 60 s, loud again: the valley's right side is as loud as its left.
    rows = [(1, i, i * 0.5, 0.1 if 60 <= i < 120 else 1.0) for i in range(240)]
    f = spark.createDataFrame(rows, "track long, frame_idx int, t double, x double")
    d = spark.createDataFrame([(1, 120.0), (2, 50.0)], "track long, duration double")
    got = {(r["track"], r["t"]) for r in ST.valley_boundaries(f, d, "x").collect()}
    inner = sorted(t for k, t in got if k == 1 and 0 < t < 120)
    assert {(1, 0.0), (1, 120.0), (2, 0.0), (2, 50.0)} <= got and inner and all(12 <= t <= 108 for t in inner)
    assert all(b - a >= 12 for a, b in zip(inner, inner[1:]))
    # A steady curve has no valley.
    flat = f.withColumn("x", F.lit(0.5))
    assert all(t < 13 or t > 107 for t in (r["t"] for r in ST.valley_boundaries(flat, d.filter("track = 1"), "x").collect()))


def test_clusters_keep_both_ends(spark):
    d = spark.createDataFrame([(1, 100.0), (2, 30.0)], "track long, duration double")
    b = spark.createDataFrame([(1, t) for t in (0.0, 5.0, 14.0, 20.0, 50.0, 58.0, 95.0, 100.0)], "track long, t double")
    got = [(r["track"], r["t"]) for r in ST.cluster_boundaries(b, d, 12.0).orderBy("track", "t").collect()]
    # 5, 14 and 20 are one cluster: 20 is farthest from 0 and from 50; of 50 and 58 the gaps 30 and 37 count; 95 is too near the end.
    assert got == [(1, 0.0), (1, 20.0), (1, 58.0), (1, 100.0), (2, 0.0), (2, 30.0)]


def test_subsections_cover_the_section(spark):
    rows = [(1, i, i * 0.5, 0.2 if 56 <= i < 64 else 0.9) for i in range(120)]
    f = spark.createDataFrame(rows, "track long, frame_idx int, t double, tension double")
    sec = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 60.0, 70.0)], "track long, idx int, start_s double, end_s double")
    got = [(r["idx"], r["start_s"], r["end_s"], r["energy"]) for r in ST.subsections(f, sec).orderBy("idx", "sub").collect()]
    assert got[0][1] == 0.0 and [x[2] for x in got[:-1]][-1] == 60.0 and all(a[2] == b[1] for a, b in zip(got[:-1], got[1:-1])) and len(got) >= 3
    assert got[-1] == (1, 60.0, 70.0, "mid")


def test_parse_lrc_keeps_long_lines(spark):
    from cantus.plans import q_lyrics
    from cantus.plans import views as V

    sf = "/root/testdata/sf0.001"
    want = V.lyric_lines(spark, sf).filter(F.col("line_idx") % 5 != 4).agg(F.max(F.length(F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))))).first()[0]
    assert q_lyrics.parse_lrc(spark, sf).agg(F.max(F.length("text"))).first()[0] == want > 40


def test_taps_return_every_word(spark):
    from cantus.plans import q_lyrics

    sf = "/root/testdata/sf0.001"
    out, words = q_lyrics.taps(spark, sf), q_lyrics.word_timing(spark, sf)
    assert out.count() == words.count()
    assert {(r["tapped"], r["status"]) for r in out.select("tapped", "status").distinct().collect()} == {(True, "corrected"), (False, "auto")}


def test_line_merge_sends_no_line_with_each_word(spark):
    """What a line heard isn't carried by each of its words through an exchange or a window."""
    lines = spark.createDataFrame([(1, 0, "aa bb", 0.0, 2.0), (2, 0, None, 0.0, 2.0), (3, 0, "xx yy", None, 2.0), (4, 0, "zz", 3.0, 3.0)], "track long, idx int, text string, start_s double, end_s double")
    heard = spark.createDataFrame([(1, "bb", 0.8, 1.1)], "track long, word string, start_s double, end_s double")
    out = L.merge_lines(lines, heard)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Exchange")
    got = {(r["track"], r["word"]): (r["start_s"], r["end_s"], r["confidence"]) for r in out.collect()}
    assert got[1, "bb"] == (0.8, 1.1, 1.0) and got[1, "aa"] == pytest.approx((0.44, 0.8, 0.65)) and got[4, "zz"] == pytest.approx((3.0, 3.06, 0.65))
    assert set(got) == {(1, "aa"), (1, "bb"), (3, "xx"), (3, "yy"), (4, "zz")}


def test_line_merge_limits_gaps_at_edges(spark):
    lines = spark.createDataFrame([(1, 0, "aa bb cc dd", 0.0, 20.0)], "track long, idx int, text string, start_s double, end_s double")
    heard = spark.createDataFrame([(1, "bb", 8.0, 8.5), (1, "cc", 9.0, 9.5)], "track long, word string, start_s double, end_s double")
    got = {r["word"]: (r["start_s"], r["end_s"], r["confidence"]) for r in L.merge_lines(lines, heard).collect()}
    assert got["bb"] == (8.0, 8.5, 1.0) and got["cc"] == (9.0, 9.5, 1.0)
    assert got["aa"] == pytest.approx((7.4, 8.0, 0.65)) and got["dd"] == pytest.approx((9.5, 10.1, 0.65))


def test_nearest_with_repeats_nulls_and_no_references(spark):
    p = spark.createDataFrame([(1, 0.5, "a"), (1, 0.5, "a"), (1, 9.0, "b"), (1, None, "n"), (2, 1.0, "c"), (None, 1.0, "d")], "track long, t double, near string")
    r = spark.createDataFrame([(1, 0.0, 7), (1, 0.0, 5), (1, 1.0, 8), (1, 1.0, 8)], "track long, t double, beat_idx int")
    q = p.withColumnRenamed("near", "name")
    got = sorted((x["name"], x["beat_idx"], x["beat_phase"]) for x in J.beat_align(q.filter("t IS NOT NULL"), r, "t").collect())
    assert got == [("a", 5, 0.5), ("a", 5, 0.5), ("b", 8, 0.0), ("c", None, None), ("d", None, None)]
    s = r.withColumn("x", F.col("beat_idx").cast("double"))
    assert sorted((x["name"], x["value"]) for x in J.interpolate(q.filter("t IS NOT NULL"), s, "t", "x").collect()) == [("a", 7.5), ("a", 7.5), ("b", 8.0), ("c", None), ("d", None)]
    assert J.nearest(q.limit(0), r, "t", "t").count() == 0 and J.nearest(q, r.limit(0), "t", "t").filter("near IS NOT NULL").count() == 0


@pytest.mark.parametrize("step", [N.monophonic, N.octave_context, N.octave_smooth, N.octave_dedup])
def test_note_steps_on_empty_repeats_and_more_columns(spark, step):
    one = spark.createDataFrame([(1, 0, 0.0, 1.0, 60.0, 0.5, "x", None)], "track long, note_id long, onset_s double, offset_s double, midi double, velocity double, ns string, acc int")
    assert step(one.limit(0), ["track"]).count() == 0
    assert [tuple(r) for r in step(one, ["track"]).collect()] == [tuple(one.first())]
    twice = step(one.union(one), ["track"])
    assert twice.columns == one.columns and twice.count() == (1 if step is N.monophonic else 2)


def test_sections_of_tracks_without_anything(spark):
    d = spark.createDataFrame([(1, 30.0), (2, None)], "track long, duration double")
    none = spark.createDataFrame([], "track long, t double")
    assert sorted(r["t"] for r in ST.cluster_boundaries(none, d.filter("track = 1"), 12.0).collect()) == [0.0, 30.0]
    s = ST.spans(ST.cluster_boundaries(none, d.filter("track = 1"), 12.0)).collect()
    assert [(r["idx"], r["start_s"], r["end_s"]) for r in s] == [(0, 0.0, 30.0)]
    f = spark.createDataFrame([], "track long, frame_idx int, t double, tension double")
    sec = spark.createDataFrame([(1, 0, 0.0, 30.0)], "track long, idx int, start_s double, end_s double")
    assert [(r["sub"], r["energy"]) for r in ST.subsections(f, sec).collect()] == [(0, "mid")]


def test_matching_without_one_side(spark):
    t = lambda xs: spark.createDataFrame([(1, float(x)) for x in xs], "track long, t double")
    r = E.match_onsets(t([1, 1, 2]), t([1, 1.04, 1.04]), 0.05).first()
    assert (r["n_ref"], r["n_det"], r["matched"]) == (3, 3, 2)
    assert E.match_onsets(t([]), t([]), 0.05).count() == 0


def test_corrections_that_come_twice(spark):
    w = spark.createDataFrame([(1, 0, "a b", 0, 0.0, 1.0), (1, 0, "a b", 1, 1.0, 2.0)], "song long, line_idx int, text string, word_idx int, start_s double, end_s double")
    c = spark.createDataFrame([(1, 0, "a b", 0, "corrected", 0.5, 0.9), (1, 0, "a b", 0, "auto", 0.1, 0.2), (1, 0, "a b", 0, "corrected", 0.4, 0.9)], "song long, line_idx int, text string, word_idx int, status string, start_s double, end_s double")
    assert sorted((r["word_idx"], r["start_s"], r["outcome"]) for r in L.apply_corrections(w, c).collect()) == [(0, 0.5, "corrected"), (1, 1.0, "auto")]


def test_song_boundaries(spark):
    """Two minutes, quiet and of one sound, then loud and of another, then as at first."""
    from cantus.operators import structure as X

    loud = lambda t: 1.0 if 40 <= t < 80 else 0.2
    f = spark.createDataFrame([(1, i, i * 0.5, loud(i * 0.5), 10 * loud(i * 0.5), 0.1 + 0.01 * (i % 3)) for i in range(240)], "track long, frame_idx int, t double, rms double, onset double, centroid double")
    one, other = [1.0] + [0.0] * 11, [0.0] * 11 + [1.0]
    b = spark.createDataFrame([(1, i, float(i), other if 40 <= i < 80 else one, [float(40 <= i < 80)] * 10 + [1.0] * 10) for i in range(120)], "track long, beat_idx int, t double, chroma array<double>, mfcc array<double>")
    cuts = sorted(r["t"] for r in X.novelty_boundaries(b).collect())
    assert len(cuts) == 2 and abs(cuts[0] - 40) <= 2 and abs(cuts[1] - 80) <= 2
    d = spark.createDataFrame([(1, 120.0)], "track long, duration double")
    got = sorted(r["t"] for r in X.boundaries(T.tension(f), b, d).collect())
    assert got[0] == 0.0 and got[-1] == 120.0 and all(y - x >= 12 for x, y in zip(got, got[1:]))
    assert min(abs(t - 40) for t in got) <= 6 and min(abs(t - 80) for t in got) <= 6
    assert X.novelty_boundaries(b.limit(0)).count() == 0
    sec = spark.createDataFrame([(1, 0, 0.0, 40.0, 0.1, 0.2), (1, 1, 40.0, 80.0, 0.9, 0.8), (2, 0, 0.0, 1.0, 0.5, 0.5)], "track long, idx int, start_s double, end_s double, mean_rms double, onset_density double")
    vec = {(r["track"], r["idx"]): r["vec"] for r in X.section_vectors(sec, b, sec).collect()}
    assert vec[1, 0] == [0.0] * 10 + [1.0] * 10 + one + [0.1, 0.2] and vec[1, 1] == [1.0] * 20 + other + [0.9, 0.8] and vec[2, 0] == [0.0] * 32 + [0.5, 0.5]
