"""Song structure: boundaries, section features, roles, labels and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, ratio, section_label
from .joins import interval_join

ROLES = ["intro", "build", "payoff", "valley", "contrast", "outro"]


def valley_candidates(f: DataFrame, value: str, smooth_s: float, reach_s: float, hop_s: float = 0.5, least_win: int = 5, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Valleys of a smoothed curve: keys, frame_idx, t, depth, edge_t and spread (highest less lowest of the group).

    The curve is a box over ``smooth_s`` (rounded to 9 decimals, so that equal
    sums are equal however they were added up).  A valley's depth is its
    distance below the mean of the highest points of ``reach_s`` on either
    side.  edge_t is where the curve has come 40 % of the way up on the side
    that is louder on average, the right one on a tie.
    """
    from .series import box_smooth, difference

    rate = max(1, int(1 / hop_s))
    reach = max(1, int(reach_s * rate))
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    back, ahead = w.rowsBetween(-reach, -1), w.rowsBetween(0, reach - 1)
    g = f.withColumn("x", F.round(box_smooth(F.col(value), max(least_win, int(smooth_s * rate)), w), 9))
    point = F.struct("t", "x")
    whole = Window.partitionBy(*keys)
    g = g.withColumn("d", difference(F.col("x"), w)).withColumns({
        "prev": F.lag("d").over(w), "back_max": F.max("x").over(back), "back_mean": F.avg("x").over(back), "ahead_max": F.max("x").over(ahead), "ahead_mean": F.avg("x").over(ahead),
        "back": F.collect_list(point).over(w.rowsBetween(-reach, 0)), "ahead": F.collect_list(point).over(ahead), "spread": F.max("x").over(whole) - F.min("x").over(whole),
    })
    v = g.filter((F.col("prev") < 0) & (F.col("d") >= 0))
    up = F.round("ahead_mean", 9) >= F.round("back_mean", 9)
    high = lambda side: F.filter(side, lambda e: e["x"] >= F.col("x") + 0.4 * (F.col(f"{side}_max") - F.col("x")))
    edge = F.when(up, F.get(high("ahead"), F.lit(0))["t"]).otherwise(F.try_element_at(high("back"), F.lit(-1))["t"])
    depth = F.round((F.col("back_max") + F.col("ahead_max")) / 2 - F.col("x"), 9)
    return v.select(*keys, "frame_idx", "t", depth.alias("depth"), F.coalesce(edge, "t").alias("edge_t"), "spread")


def _deepest_first(valleys: DataFrame, keys: list[str], at: str, most: str, apart: float) -> DataFrame:
    """Greedy choice in the JVM: deepest first, ``apart`` from all chosen and from lo and hi, ``most`` at most: keys, lo, hi, ts (sorted).

    valleys: keys, frame_idx, depth, the column ``at`` and lo, hi of the group.
    """
    g = valleys.groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "frame_idx", F.col(at).alias("t")))).alias("vs"))
    fits = f"size(acc) < {most} AND v.t - lo >= {apart}D AND hi - v.t >= {apart}D AND forall(acc, s -> abs(v.t - s) >= {apart}D)"
    fold = f"aggregate(vs, cast(array() AS array<double>), (acc, v) -> if({fits}, concat(acc, array(v.t)), acc))"
    return g.select(*keys, "lo", "hi", F.array_sort(F.expr(fold)).alias("ts"))


def valley_boundaries(f: DataFrame, duration: DataFrame, value: str = "tension", min_len: float = 12.0, per_s: float = 55.0, least_k: int = 2, least: float = 0.05, hop_s: float = 0.5) -> DataFrame:
    """Boundaries at the deepest valleys of a curve smoothed over 12 s: track, t, with 0 and the duration as ends.

    duration: track, duration.  A boundary lies at the edge of its valley, at
    least ``min_len`` from all others and from both ends.  At most
    max(least_k, round(duration / per_s)) are chosen.
    """
    v = valley_candidates(f, value, 12.0, min_len, hop_s).filter(F.col("depth") >= least)
    ends = duration.select("track", F.lit(0.0).alias("lo"), F.col("duration").alias("hi"))
    chosen = _deepest_first(v.join(ends, "track"), ["track"], "edge_t", f"greatest({least_k}, bround((hi - lo) / {per_s}D))", min_len)
    inner = ends.join(chosen.select("track", "ts"), "track", "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<double>")))
    return inner.select("track", F.explode(F.concat(F.array("lo"), F.col("ts"), F.array("hi"))).alias("t"))


def cluster_boundaries(bounds: DataFrame, duration: DataFrame, min_len: float) -> DataFrame:
    """Thins candidate boundaries (track, t); 0 and the duration (track, duration) always stay: track, t.

    A cluster is a run of inner candidates with gaps below ``min_len``; its
    candidate that maximises the smaller of the gaps to the boundary kept
    before and to the next cluster's begin (or the end) is kept if both gaps
    suffice; the first of equals.  A fold in the JVM over a track's clusters.
    """
    w = Window.partitionBy("track").orderBy("t")
    c = bounds.select("track", "t").distinct().join(duration, "track").filter((F.col("t") > 0) & (F.col("t") < F.col("duration")))
    c = c.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) >= min_len).cast("int"), F.lit(1))).withColumn("c", F.sum("new").over(w))
    g = c.groupBy("track", "c").agg(F.array_sort(F.collect_list("t")).alias("ts")).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("c", "ts"))).alias("cs"))
    g = duration.join(g, "track", "left")
    after = "if(x.c < size(cs), cs[cast(x.c AS int)].ts[0], duration)"
    best = f"array_max(transform(x.ts, t -> struct(least(t - element_at(acc, -1), {after} - t) AS g, -t AS t)))"
    fold = f"aggregate(coalesce(cs, array()), array(0.0D), (acc, x) -> if({best}.g >= {min_len}D, concat(acc, array(-{best}.t)), acc))"
    return g.select("track", F.explode(F.concat(F.expr(fold), F.array("duration"))).alias("t"))


def spans(bounds: DataFrame) -> DataFrame:
    """Sections between neighbouring boundaries (track, t): track, idx, start_s, end_s."""
    w = Window.partitionBy("track").orderBy("t")
    s = bounds.select("track", F.col("t").alias("start_s"), F.lead("t").over(w).alias("end_s"), (F.row_number().over(w) - 1).alias("idx"))
    return s.filter(F.col("end_s").isNotNull()).select("track", "idx", "start_s", "end_s")


def merge_sections(sections: DataFrame, novelty: float = 0.3, longest: float = 120.0) -> DataFrame:
    """Joins neighbouring sections of one role where the novelty between them is low and the result isn't too long.

    sections: track, idx, start_s, end_s, role, novelty_to_next.  A fold in
    the JVM over the sections of a track; returns track, sec, start_s, end_s, role.
    """
    last = "element_at(acc, -1)"
    item = "named_struct('start_s', x.start_s, 'end_s', x.end_s, 'role', x.role, 'nov', x.novelty_to_next)"
    joined = f"named_struct('start_s', {last}.start_s, 'end_s', x.end_s, 'role', {last}.role, 'nov', x.novelty_to_next)"
    ok = f"size(acc) > 0 AND {last}.role = x.role AND {last}.nov < {novelty}D AND x.end_s - {last}.start_s <= {longest}D"
    empty = "cast(array() AS array<struct<start_s: double, end_s: double, role: string, nov: double>>)"
    fold = f"aggregate(ss, {empty}, (acc, x) -> if({ok}, concat(slice(acc, 1, size(acc) - 1), array({joined})), concat(acc, array({item}))))"
    g = sections.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", "start_s", "end_s", "role", "novelty_to_next"))).alias("ss"))
    return g.select("track", F.posexplode(F.expr(fold)).alias("sec", "s")).select("track", "sec", "s.start_s", "s.end_s", "s.role")


def vector_similarity(a: Column, b: Column) -> Column:
    """0.4 cosine of MFCC + 0.2 cosine of chroma + 0.4 closeness of energy; cosines are scaled to 0..1, 0.5 without a length."""

    def part(v: Column, lo: int, n: int) -> Column:
        return F.slice(v, lo + 1, n)

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def cos01(lo: int, n: int) -> Column:
        x, y = part(a, lo, n), part(b, lo, n)
        length = lambda v: F.sqrt(total(F.transform(v, lambda e: e * e)))
        dot = total(F.zip_with(x, y, lambda p, q: p * q))
        return F.when((length(x) < 1e-8) | (length(y) < 1e-8), 0.5).otherwise((dot / (length(x) * length(y)) + 1) / 2)

    apart = total(F.zip_with(part(a, 32, 2), part(b, 32, 2), lambda p, q: F.abs(p - q)))
    return clamp01(F.lit(0.4) * cos01(0, 20) + F.lit(0.2) * cos01(20, 12) + F.lit(0.4) * F.greatest(F.lit(0.0), F.lit(1.0) - apart / 2))


def section_pairs(vectors: DataFrame) -> DataFrame:
    """Similarity of all pairs of sections i < j of a track: track, i, j, sim.  vectors: track, idx, vec."""
    a, b = vectors.alias("a"), vectors.alias("b")
    p = a.join(b, (F.col("a.track") == F.col("b.track")) & (F.col("a.idx") < F.col("b.idx")))
    return p.select("a.track", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), vector_similarity(F.col("a.vec"), F.col("b.vec")).alias("sim"))


def repetition(vectors: DataFrame) -> DataFrame:
    """track, idx, repetition (best similarity to a section that isn't next to it), novelty_prev, novelty_next (1 at the ends)."""
    p = section_pairs(vectors)
    both = p.select("track", F.col("i").alias("idx"), F.col("j").alias("other"), "sim").union(p.select("track", "j", "i", "sim"))
    far, nxt, prv = F.abs(F.col("other") - F.col("idx")) > 1, F.col("other") == F.col("idx") + 1, F.col("other") == F.col("idx") - 1
    g = both.groupBy("track", "idx").agg(F.max(F.when(far, F.col("sim"))).alias("rep"), (1 - F.max(F.when(prv, F.col("sim")))).alias("p"), (1 - F.max(F.when(nxt, F.col("sim")))).alias("n"))
    return vectors.select("track", "idx").join(g, ["track", "idx"], "left").select("track", "idx", F.coalesce("rep", F.lit(0.0)).alias("repetition"), F.coalesce("p", F.lit(1.0)).alias("novelty_prev"), F.coalesce("n", F.lit(1.0)).alias("novelty_next"))


def section_features(frames: DataFrame, sections: DataFrame) -> DataFrame:
    """Scaled features of each section (track, idx, start_s, end_s) from its frames.

    Adds mean_rms, onset_density, centroid_mean, rms_variance (each scaled over
    the track's sections), slope (0.5 is level), song_position and intensity_rank.
    """
    from .series import average_rank01, box_smooth, quarter_means

    inside = interval_join(frames, sections, "t", 60.0)
    sm = inside.withColumn("sm", box_smooth(F.col("rms"), 3, Window.partitionBy("track", "idx").orderBy("frame_idx")))
    q = quarter_means(sm, "sm", ["track", "idx"], ["frame_idx"]).select("track", "idx", (F.col("last_q") - F.col("first_q")).alias("raw_slope"))
    g = inside.groupBy("track", "idx", "start_s", "end_s").agg(F.avg("rms").alias("r"), F.avg("onset").alias("o"), F.avg("centroid").alias("c"), F.var_pop("rms").alias("v")).join(q, ["track", "idx"])
    w = Window.partitionBy("track")
    scaled = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-8)
    steep = F.when(F.abs("raw_slope") <= 0.02, 0.0).otherwise(F.col("raw_slope"))
    g = g.withColumns({"mean_rms": scaled("r"), "onset_density": scaled("o"), "centroid_mean": scaled("c"), "rms_variance": scaled("v"), "steep": steep, "song_position": (F.col("start_s") + F.col("end_s")) / 2 / F.max("end_s").over(w)})
    most = F.max(F.abs("steep")).over(w)
    g = g.withColumns({"slope": clamp01(F.lit(0.5) + F.lit(0.5) * ratio(F.col("steep"), most)), "intensity_rank": average_rank01(F.col("r"), w, Window.partitionBy("track", "r"))})
    return g.select("track", "idx", "start_s", "end_s", "mean_rms", "onset_density", "centroid_mean", "rms_variance", "slope", "song_position", "intensity_rank")


def role_scores(f: DataFrame) -> DataFrame:
    """Adds a score column for each role.

    f: section_features and repetition of the same sections.
    """
    w = Window.partitionBy("track")
    by = w.orderBy("idx")
    sp, rir, rs, sl, od, rv, mr, cm, ntp, ntn = (F.col(c) for c in ("song_position", "intensity_rank", "repetition", "slope", "onset_density", "rms_variance", "mean_rms", "centroid_mean", "novelty_prev", "novelty_next"))
    gap = F.lead("intensity_rank").over(by) - rir
    lo, hi = F.min("repetition").over(w), F.max("repetition").over(w)
    place = F.when(sp < 0.2, F.least(F.lit(1.0), sp / 0.2)).otherwise(F.least(F.lit(1.0), (1 - sp) / 0.2))
    calm = F.when(sl > 0.5, 1 - 0.4 * (sl - 0.5) / 0.5).otherwise(1.0)
    scores = {
        "intro": F.when(sp < 0.25, 0.40 * (1 - sp) + 0.25 * (1 - rir) + 0.20 * (1 - rs) + 0.15 * sl).otherwise(0.0),
        "build": 0.45 * sl + 0.30 * (1 - rir) + 0.15 * od + 0.10 * (1 - rv) + F.when(gap > 0.15, 0.12 * gap).otherwise(0.0),
        "payoff": 0.50 * rir + 0.20 * mr + 0.15 * od + 0.15 * cm,
        "valley": (0.50 * (1 - rir) + 0.25 * (1 - od) + 0.15 * (1 - mr) + 0.10 * (1 - cm)) * (0.5 + 0.5 * place) * calm,
        "contrast": 0.35 * (hi - rs) / (hi - lo + 1e-8) + 0.30 * ntp + 0.25 * ntn + 0.10 * rv,
        "outro": F.when(sp > 0.75, 0.40 * sp + 0.30 * (1 - sl) + 0.20 * (1 - rir) + 0.10 * (1 - od)).otherwise(0.0),
    }
    return f.withColumns({f"s_{k}": v for k, v in scores.items()})


def best_roles(scored: DataFrame) -> DataFrame:
    """track, idx, role (the first of equals in the order of ROLES), runner_up, confidence."""
    x = scored.withColumn("ranked", _ranked())
    a, b = -F.col("ranked")[0]["s"], -F.col("ranked")[1]["s"]
    return x.select("track", "idx", F.col("ranked")[0]["r"].alias("role"), F.col("ranked")[1]["r"].alias("runner_up"), F.round(a / (a + b + 1e-8), 4).alias("confidence"))


def _ranked() -> Column:
    """Scores of a row, best first, the first of equals in the order of ROLES: array of (s: negated, i, r)."""
    return F.array_sort(F.array(*[F.struct((-F.round(F.col(f"s_{r}"), 9)).alias("s"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(ROLES)]))


def revise_roles(scored: DataFrame) -> DataFrame:
    """track, idx, role after the global rules, each of which sees the edits of those before it.

    Intros in the first two sections only; outros in the last two only; a build
    needs a payoff in the next two.  What breaks a rule gets its best other role
    with a score above 0, else valley.  Of three sections or more one is a
    payoff: else the most intense that is neither intro nor outro becomes one.
    scored: role_scores with best_roles' role.
    """
    w = Window.partitionBy("track")
    by = w.orderBy("idx")
    role = F.col("role")
    other = lambda name: F.coalesce(F.get(F.filter("ranked", lambda x: (x["r"] != name) & (x["s"] < 0)), F.lit(0))["r"], F.lit("valley"))
    g = scored.withColumns({"ranked": _ranked(), "at": F.row_number().over(by), "n": F.count("*").over(w)})
    g = g.withColumn("role", F.when((role == "intro") & (F.col("at") > 2), other("intro")).otherwise(role))
    g = g.withColumn("role", F.when((role == "outro") & (F.col("at") <= F.col("n") - 2), other("outro")).otherwise(role))
    soon = (F.coalesce(F.lead("role", 1).over(by), F.lit("")) == "payoff") | (F.coalesce(F.lead("role", 2).over(by), F.lit("")) == "payoff")
    g = g.withColumn("soon", soon).withColumn("role", F.when((role == "build") & ~F.col("soon"), other("build")).otherwise(role))
    none = F.max((role == "payoff").cast("int")).over(w) == 0
    free = ~role.isin("intro", "outro")
    first = F.min(F.when(free, F.struct((-F.col("intensity_rank")).alias("r"), "at"))).over(w)
    g = g.withColumns({"none": none, "first": first["at"]})
    return g.select("track", "idx", F.when(F.col("none") & (F.col("n") >= 3) & (F.coalesce("first", F.lit(-1)) == F.col("at")), "payoff").otherwise(role).alias("role"))


def motif_labels(pairs: DataFrame, sections: DataFrame, least: float = 0.82) -> DataFrame:
    """Leader clusters of similar sections as labels A, B, ..: track, idx, label.

    Each free section leads; later free ones join if they are similar enough
    to the leader.  pairs: track, i, j, sim.  With a column role in sections
    only those of one role share a label.  Letters go by first appearance.  A
    fold in the JVM: state is the array of leaders by section.
    """
    close = pairs.filter(F.col("sim") >= least)
    if "role" in sections.columns:
        role = lambda k: sections.select("track", F.col("idx").alias(k), F.col("role").alias(f"__{k}"))
        close = close.join(role("i"), ["track", "i"]).join(role("j"), ["track", "j"]).filter("__i <=> __j")
    near = close.groupBy("track").agg(F.collect_set(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))).alias("near"))
    ids = sections.groupBy("track").agg(F.array_sort(F.collect_set(F.col("idx").cast("int"))).alias("ids"))
    g = ids.join(near, "track", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<i:int,j:int>>")))
    # A section's leader is the first leader before it that it is near to, else itself.
    lead = "coalesce(get(filter(acc, e -> e.idx = e.leader AND array_contains(near, named_struct('i', e.idx, 'j', x))), 0).idx, x)"
    fold = f"aggregate(ids, cast(array() AS array<struct<idx: int, leader: int>>), (acc, x) -> concat(acc, array(named_struct('idx', x, 'leader', {lead}))))"
    led = g.select("track", F.explode(F.expr(fold)).alias("e")).select("track", "e.idx", "e.leader")
    number = F.dense_rank().over(Window.partitionBy("track").orderBy("leader")) - 1
    return led.withColumn("label", section_label(number)).select("track", "idx", "label")


# What a role looks like on screen; a second payoff, and valleys of the first and the second half.
BEHAVIOUR = {"intro": "establish_world", "build": "build_tension", "payoff": "release_payoff", "contrast": "contrast_reset", "outro": "close_out"}
LATER_PAYOFF, EARLY_VALLEY, LATE_VALLEY, NO_ROLE = "sustain_euphoria", "develop_motion", "strip_down", "develop_motion"


def visual_behaviour(roles: DataFrame) -> DataFrame:
    """track, idx, behaviour of sections (track, idx, start_s, end_s, role).

    By role; a payoff after another sustains, and a valley depends on the half
    of the song in which its middle lies.
    """
    w = Window.partitionBy("track").orderBy("idx")
    earlier = F.max((F.col("role") == "payoff").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.max_by("end_s", "idx").over(Window.partitionBy("track"))
    early = (F.col("start_s") + F.col("end_s")) / 2 / F.greatest(total, F.lit(1e-8)) < 0.5
    plain = F.create_map(*[F.lit(x) for kv in BEHAVIOUR.items() for x in kv])
    b = F.when((F.col("role") == "payoff") & (earlier == 1), LATER_PAYOFF).when(F.col("role") == "valley", F.when(early, EARLY_VALLEY).otherwise(LATE_VALLEY))
    return roles.select("track", "idx", b.otherwise(F.coalesce(plain[F.col("role")], F.lit(NO_ROLE))).alias("behaviour"))


def subsections(frames: DataFrame, sections: DataFrame, value: str = "tension", hop_s: float = 0.5, per_s: float = 25.0, min_len: float = 8.0) -> DataFrame:
    """Parts of sections between deep valleys, which cover each section: track, idx, sub, start_s, end_s, energy.

    A section of at least 2.5 * min_len and ten frames is smoothed over 4 s;
    its valleys of at least 15 % of its range are taken deepest first,
    ``min_len`` apart and from its ends, max(1, round(length / per_s)) at most.
    energy: rising or falling by the quarters' means, else low, mid or high;
    mid without frames.
    """
    from ..functions.scalars import energy_word
    from .series import quarter_means

    span = sections.select("track", "idx", "start_s", "end_s")
    inside = interval_join(frames.select("track", "frame_idx", "t", value), span, "t", 60.0)
    n = F.count("*").over(Window.partitionBy("track", "idx"))
    long = inside.withColumn("n", n).filter((F.col("n") >= 10) & (F.col("end_s") - F.col("start_s") >= 2.5 * min_len))
    v = valley_candidates(long, value, 4.0, min_len, hop_s, 3, ("track", "idx")).filter(F.col("depth") >= F.round(F.col("spread") * 0.15, 9))
    v = v.join(span.select("track", "idx", F.col("start_s").alias("lo"), F.col("end_s").alias("hi")), ["track", "idx"])
    cuts = _deepest_first(v, ["track", "idx"], "t", f"greatest(1, bround((hi - lo) / {per_s}D))", min_len)
    whole = span.join(cuts.select("track", "idx", "ts"), ["track", "idx"], "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<double>")))
    whole = whole.withColumn("b", F.concat(F.array("start_s"), "ts", F.array("end_s")))
    parts = whole.select("track", "idx", F.posexplode(F.expr("transform(sequence(1, size(b) - 1), k -> struct(b[k - 1] AS start_s, b[k] AS end_s))")).alias("sub", "p")).select("track", "idx", "sub", "p.start_s", "p.end_s")
    q = quarter_means(interval_join(frames.select("track", "frame_idx", "t", value), parts, "t", 30.0), value, ["track", "idx", "sub"], ["frame_idx"])
    word = energy_word(F.col("first_q"), F.col("last_q"), F.col("mean"))
    return parts.join(q, ["track", "idx", "sub"], "left").select("track", "idx", "sub", "start_s", "end_s", F.when(F.col("mean").isNull(), "mid").otherwise(word).alias("energy"))


def frame_state(times: DataFrame, drops: DataFrame, buildups: DataFrame, boundaries: DataFrame, decay_s: float = 0.5) -> DataFrame:
    """Adds drop, buildup and boundary, 0..1, to times (track, t, ..).

    drop: exponential decay since the last drop (track, t).  buildup: how far the
    first build-up (track, start_t, peak_t, drop_t) that holds t has come, both
    ends included.  boundary: the pulse around the nearest begin of a section
    (track, t) but the first.
    """
    from .joins import as_of
    from .series import boundary_pulse

    j = as_of(times, drops, "t", "t", "__drop")
    j = j.withColumn("drop", F.coalesce(F.exp(-(F.col("t") - F.col("__drop")) / decay_s), F.lit(0.0))).drop("__drop")
    j = boundary_pulse(j, boundaries.filter("t >= 1e-3"), "boundary", 0.6, 0.85)
    spans = buildups.filter(F.col("peak_t") > F.col("start_t")).select("track", F.col("start_t").alias("__s"), (F.col("peak_t") + 1e-9).alias("__e"), F.col("peak_t").alias("__p"), "drop_t")
    held = interval_join(j.select("track", "t").distinct(), spans, "t", 10.0, lo="__s", hi="__e")
    part = held.groupBy("track", "t").agg(F.min_by((F.col("t") - F.col("__s")) / (F.col("__p") - F.col("__s")), "drop_t").alias("buildup"))
    return j.join(part, ["track", "t"], "left").withColumn("buildup", F.coalesce("buildup", F.lit(0.0)))


def mix_frame(state: DataFrame) -> DataFrame:
    """What the picture of the whole mix is driven by, from loud, onset, tension, drop, buildup and boundary (all 0..1).

    Adds story_mix (share of the section's gradient), brightness, grain, sway
    (how far the centre moves), radius and orb_alpha of the pulse, and the number
    of rays and their alpha.
    """
    power = lambda c, e: F.pow(F.col(c), F.lit(e))
    return state.withColumns({
        "story_mix": F.least(F.lit(0.85), F.greatest(F.lit(0.0), F.lit(0.15) + 0.55 * power("tension", 0.9))),
        "brightness": F.lit(0.50) + 0.65 * power("loud", 0.6) + 0.12 * power("tension", 0.9),
        "grain": 22.0 * F.col("onset") + 18.0 * F.col("tension") + 30.0 * F.col("boundary"),
        "sway": F.lit(0.05) * (F.lit(0.3) + F.col("onset")),
        "radius": F.lit(0.08) + 0.22 * power("loud", 0.8) + 0.10 * F.col("drop") + 0.06 * F.col("boundary") + 0.12 * F.col("buildup"),
        "orb_alpha": F.least(F.lit(255), F.floor(F.lit(90) + 130 * F.col("loud") + 80 * F.col("drop"))).cast("int"),
        "rays": F.floor(F.col("onset") * (F.lit(18) + 14 * F.col("buildup"))).cast("int"),
        "ray_alpha": F.floor(F.lit(40) + 120 * F.col("onset")).cast("int"),
    })


def palette_blend(times: DataFrame, sections: DataFrame, crossfade_s: float = 1.5) -> DataFrame:
    """Adds section, next_section and blend: in the last ``crossfade_s`` of a section the next one's colours come in by a smooth step.

    times: track, t, ..  sections: track, idx, start_s, end_s.  Times outside all
    sections belong to the last one before them, else to the first.
    """
    from .joins import as_of

    begins = sections.select("track", F.col("start_s").alias("at"))
    j = as_of(times, begins, "t", "at", "__s").join(sections.select("track", F.col("start_s").alias("__s"), "idx", "end_s"), ["track", "__s"], "left")
    left = F.col("end_s") - F.col("t")
    x = F.lit(1.0) - left / crossfade_s
    blend = F.when((left > 0) & (left < crossfade_s), x * x * (F.lit(3.0) - 2.0 * x)).otherwise(0.0)
    return j.withColumns({"section": F.coalesce("idx", F.lit(0)), "blend": blend}).withColumn("next_section", F.col("section") + 1).drop("__s", "idx", "end_s")
