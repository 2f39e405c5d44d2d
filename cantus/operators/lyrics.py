"""Timed lyrics: parsing, word timing, alignment to recognised words, corrections and their quality."""

from __future__ import annotations

import difflib
import functools
import operator
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LEAD_IN, SOUND_OF_ONE, SOUND_OF_TWO, flags, ratio
from .joins import as_of

# The timed-line format.
LRC_LINE = r"^\[(\d{1,2}):(\d{2})\.(\d{2,3})\](.*)"
MARKERS = r"(?m)^\s*\[[^\]\n]*\]\s*$"


def parse_lrc(df: DataFrame, text: str = "text") -> DataFrame:
    """song, line_no, text, start_s, end_s of every timed line.

    A line ends where the next timed line begins, also where that one has no
    text and is dropped itself; the last line lasts 5 s.
    """
    lines = df.select("song", F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("raw", F.trim("raw"))
    part = lambda k: F.regexp_extract("raw", LRC_LINE, k)
    timed = lines.filter(F.col("raw").rlike(LRC_LINE))
    frac = part(3)
    ms = F.when(F.length(frac) == 2, frac.cast("int") * 10).otherwise(frac.cast("int"))
    start = part(1).cast("int") * 60 + part(2).cast("int") + ms / 1000.0
    t = timed.select("song", "line_no", F.trim(part(4)).alias("text"), start.alias("start_s"))
    w = Window.partitionBy("song").orderBy("start_s", "line_no")
    return t.withColumn("end_s", F.coalesce(F.lead("start_s").over(w), F.col("start_s") + 5.0)).filter("text <> ''")


def time_words(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Words of each line with times in proportion to their length.

    A word takes its slot up to 95 %, the last word up to the line's end.
    Returns the keys, word_idx, word, start_s, end_s (6 decimals), confidence.
    """
    lines = lines.select(*keys, "text", "start_s", "end_s").repartition(*keys)  # lines are dealt, not their many words
    w = lines.select(*keys, F.col("start_s").alias("ls"), F.col("end_s").alias("le"), F.posexplode(F.filter(F.split(F.col("text"), r"\s+"), lambda x: x != "")).alias("word_idx", "word"))
    order = Window.partitionBy(*keys).orderBy("word_idx")
    n = F.length("word")
    total, upto, last = F.sum(n).over(Window.partitionBy(*keys)), F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lead("word").over(order).isNull()
    w = w.withColumns({"total": total, "upto": F.coalesce(upto, F.lit(0)), "is_last": last})
    dur = F.col("le") - F.col("ls")
    start = F.col("ls") + dur * F.col("upto") / F.col("total")
    end = F.when(F.col("is_last"), F.col("le")).otherwise(start + dur * n / F.col("total") * 0.95)
    return w.select(*keys, "word_idx", "word", F.round(start, 6).alias("start_s"), F.round(end, 6).alias("end_s"), F.lit(1.0).alias("confidence"))


def strip_markers(text: Column) -> Column:
    """Text without section-marker lines, with at most one blank line in a row, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARKERS, ""), r"\n{3,}", "\n\n"))


def token_norm(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def first_sound(word: Column) -> Column:
    """Class of a word's first sound by its letters; ``unknown`` without a letter, for other letters and for null."""
    w = F.lower(F.regexp_replace(word, "^[^A-Za-z]+|[^A-Za-z]+$", ""))
    table = {**{x: name for name, letters in SOUND_OF_ONE.items() for x in letters}, **SOUND_OF_TWO}
    sounds = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(sounds, F.substring(w, 1, 2)), F.try_element_at(sounds, F.substring(w, 1, 1)), F.lit("unknown"))


def sound_lead_in(word: Column) -> Column:
    """Seconds by which a word begins before its onset, by the class of its first sound."""
    return F.create_map(*[F.lit(x) for kv in LEAD_IN.items() for x in kv])[first_sound(word)]


def rasterise(words: DataFrame, hz: float = 100.0) -> DataFrame:
    """Distinct frames in which a word sounds: song, frame."""
    a, b = F.floor(F.col("start_s") * hz).cast("long"), F.ceil(F.col("end_s") * hz).cast("long") - 1
    return words.filter(b >= a).select("song", F.explode(F.sequence(a, b)).alias("frame")).distinct()


def lyric_activity(times: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """What is sung at each time (track, t): first the segment, then the word within it.

    segments: track, idx, text, start_s, end_s.  words: track, idx, word_idx,
    word, start_s, end_s, confidence.  The first segment that holds t counts, in
    it the first word that holds t, else the last word that has ended.  Adds
    active_segment and active_word (empty if none), active_word_index (-1),
    word_confidence and word_progress (0; 1 behind a word), word_active and
    phrase_active.
    """
    from .joins import interval_join

    inside = interval_join(times.select("track", "t").distinct(), segments.select("track", "idx", "text", "start_s", "end_s"), "t", 10.0)
    first = inside.groupBy("track", "t").agg(F.min(F.struct("idx", "text")).alias("s")).select("track", "t", "s.idx", "s.text")
    held = words.groupBy("track", "idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_s", "end_s", "confidence"))).alias("ws"))
    j = times.join(first, ["track", "t"], "left").join(held, ["track", "idx"], "left")
    t = F.col("t")
    now = F.get(F.filter("ws", lambda w: (w["start_s"] <= t) & (t < w["end_s"])), F.lit(0))
    past = F.try_element_at(F.filter("ws", lambda w: w["end_s"] <= t), F.lit(-1))
    j = j.withColumns({"now": now, "w": F.coalesce(now, past)})
    part = (t - F.col("now.start_s")) / F.greatest(F.col("now.end_s") - F.col("now.start_s"), F.lit(1e-6))
    out = j.select(
        *times.columns,
        F.coalesce("text", F.lit("")).alias("active_segment"),
        F.coalesce("w.word", F.lit("")).alias("active_word"),
        F.coalesce("w.word_idx", F.lit(-1)).alias("active_word_index"),
        F.coalesce("w.confidence", F.lit(0.0)).alias("word_confidence"),
        F.when(F.col("now").isNotNull(), part).when(F.col("w").isNotNull(), 1.0).otherwise(0.0).alias("word_progress"),
    )
    return out.withColumns({"word_active": F.col("active_word") != "", "phrase_active": F.col("active_segment") != ""})


def snap_to_onsets(words: DataFrame, onsets: DataFrame, within: float = 0.20, lead_in: Column | float | None = None, least: float = 0.02, remain: float = 0.05) -> DataFrame:
    """Moves word starts to the first onset within reach, less a lead-in; small moves and vanishing words stay.

    Without a lead-in it is that of the first sound of the column ``word``.
    """
    lead_in = sound_lead_in(F.col("word")) if lead_in is None else lead_in
    j = as_of(words, onsets, "start_s", "t", "onset", forward=True)
    new = F.greatest(F.col("start_s"), F.col("onset") - lead_in)
    ok = (F.col("onset") - F.col("start_s") <= within) & (new - F.col("start_s") >= least) & (F.col("end_s") - new >= remain)
    return j.withColumn("snapped", F.coalesce(ok, F.lit(False))).withColumn("start_s", F.when(F.col("snapped"), F.round(new, 6)).otherwise(F.col("start_s"))).drop("onset")


def snap_to_energy(words: DataFrame, frames: DataFrame, quiet: float = 0.10, rise: float = 0.15, lead_in: float = 0.05, least: float = 0.03) -> DataFrame:
    """Moves the start of a word that begins quietly to its first loud frame, less a lead-in, if that is far enough.

    words: track, word_id, start_s, end_s.  frames: track, t, rms.
    """
    from .joins import interval_join

    j = interval_join(frames.select("track", "t", "rms"), words.select("track", "word_id", "start_s", "end_s"), "t", 5.0)
    peak = F.max("rms").over(Window.partitionBy("track", "word_id"))
    g = j.withColumn("peak", peak).groupBy("track", "word_id", "start_s").agg(F.min_by("rms", "t").alias("first"), F.max("peak").alias("peak"), F.min(F.when(F.col("rms") >= rise * F.col("peak"), F.col("t"))).alias("loud"))
    new = F.greatest(F.col("start_s"), F.col("loud") - lead_in)
    ok = (F.col("first") <= quiet * F.col("peak")) & (new - F.col("start_s") >= least)
    return g.select("track", "word_id", F.when(F.coalesce(ok, F.lit(False)), F.round(new, 6)).otherwise(F.col("start_s")).alias("start_s"), F.coalesce(ok, F.lit(False)).alias("snapped"))


def normalise_segments(segments: DataFrame) -> DataFrame:
    """Recogniser output (song, words array<struct<word, start_s, end_s, probability, score>>) without empty words; probability, else score, else 0."""
    clean = F.transform("words", lambda w: F.struct(F.trim(w["word"]).alias("word"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s"), F.coalesce(w["probability"], w["score"], F.lit(0.0)).alias("confidence")))
    return segments.withColumn("words", F.filter(clean, lambda w: w["word"] != ""))


def merge_lines(lines: DataFrame, heard: DataFrame, slack: float = 0.6) -> DataFrame:
    """Timed words of lines from heard words whose middle lies within ``slack`` of the line; a line without any is timed in proportion.

    lines: track, idx, text, start_s, end_s.  heard: track, word, start_s,
    end_s and confidence (1 if there is no such column).  A heard word may
    serve two lines.  Returns track, idx, word_idx, word, start_s, end_s,
    confidence.
    """
    bucket = lambda c: F.floor(c / 10.0).cast("long")
    mid = (F.col("start_s") + F.col("end_s")) / 2  # worked out again behind the join, which is sent no more than it must
    trust = F.col("confidence") if "confidence" in heard.columns else F.lit(1.0)
    h = heard.select("track", bucket(mid).alias("b"), "start_s", "end_s", token_norm(F.col("word")).alias("w"), trust.alias("c"))
    wide = lines.select("track", "idx", (F.col("start_s") - slack).alias("lo"), (F.col("end_s") + slack).alias("hi")).filter("lo < hi").withColumn("b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    inside = h.join(wide, ["track", "b"]).filter((mid >= F.col("lo")) & (mid < F.col("hi")))
    near = inside.groupBy("track", "idx").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "w", "c"))).alias("heard"))
    w = lines.select("track", "idx", F.col("start_s").alias("line_start"), F.col("end_s").alias("line_end"), "text").join(near, ["track", "idx"], "left")
    w = w.withColumn("ws", F.filter(F.split("text", r"\s+"), lambda x: x != ""))  # behind the join: a text is smaller than its words
    timed = w.select("track", F.col("idx").cast("long").alias("idx"), F.arrays_zip("ws", _merged_times(slack)("ws", F.transform("ws", token_norm), "heard", "line_start", "line_end").alias("t")).alias("ws"))
    each = timed.select("track", "idx", F.posexplode("ws").alias("word_idx", "w"))
    return each.select("track", "idx", "word_idx", F.col("w.ws").alias("word"), F.round("w.t.start_s", 6).alias("start_s"), F.round("w.t.end_s", 6).alias("end_s"), F.col("w.t.confidence").alias("confidence"))


def _merged_times(slack: float):
    """A function of a line's words, their tokens, what was heard and the line's edges: a time for each word.

    A line is aligned and filled at once, so that neither words nor what was
    heard is sent anywhere again.
    """
    kind = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("confidence", pa.float64())])

    @F.arrow_udf("array<struct<start_s: double, end_s: double, confidence: double>>")
    def run(ws: pa.Array, tokens: pa.Array, heard: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(ws), 256):  # few lines at a time as Python objects
            rows = zip(*[x.slice(i, 256).to_pylist() for x in (ws, tokens, heard, start, end)], strict=True)
            parts.append(pa.array([None if w is None else line_times(w, t, h or [], a, b, slack) for w, t, h, a, b in rows], pa.list_(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))

    return run


def line_times(words: list[str], tokens: list[str], heard: list[dict], line_start: float | None, line_end: float | None, slack: float, least: float = 0.06) -> list[dict]:
    """start_s, end_s and confidence of each word of a line: those of its heard partner, else as in ``fill_gaps`` with a column heard."""
    plus = lambda x, y: None if x is None or y is None else x + y
    most = lambda *xs: max((x for x in xs if x is not None), default=None)
    fewest = lambda *xs: min((x for x in xs if x is not None), default=None)
    beyond = lambda a, b: a is not None and b is not None and a > b + 1e-4
    partner = align_lists(tokens, [h["w"] for h in heard])
    known = [None if k is None else heard[k] for k in partner]
    out = [None if h is None else {"start_s": h["start_s"], "end_s": h["end_s"], "confidence": 1.0 if h["c"] is None else h["c"]} for h in known]
    lengths = [max(h["end_s"] - h["start_s"], 0.03) for h in heard if h["end_s"] > h["start_s"]]
    if lengths:
        average = functools.reduce(operator.add, lengths) / len(lengths)
    else:
        average = most(0.06, None if line_start is None or line_end is None else (line_end - line_start) / max(1, len(words)))
    first = most(line_start, plus(min(h["start_s"] for h in heard) if heard else line_start, -slack))
    last = fewest(line_end, plus(max(h["end_s"] for h in heard) if heard else line_end, slack))
    i = 0
    while i < len(words):
        if known[i]:
            i += 1
            continue
        j = i
        while j < len(words) and not known[j]:
            j += 1
        before, after = known[i - 1]["end_s"] if i else None, known[j]["start_s"] if j < len(words) else None
        inside, total = average * (j - i), sum(map(len, words[i:j]))
        left = before if before is not None else first if after is None else most(first, after - inside * 1.2)
        right = after if after is not None else last if before is None else fewest(last, before + inside * 1.2)
        short = fewest(plus(left, max(least, inside)), after if after is not None else line_end)
        end = right if beyond(right, left) else short if beyond(short, left) else plus(left, least)
        upto = 0
        for k in range(i, j):
            n = len(words[k])
            if left is None:
                start = stop = None
            else:
                span = end - left
                start = left + span * upto / total
                stop = left + span if k == j - 1 else start + span * n / total * 0.95
            out[k] = {"start_s": start, "end_s": stop, "confidence": 0.65}
            upto += n
        i = j
    return out


def fill_gaps(words: DataFrame, keys: list[str], least: float = 0.06, slack: float = 0.6) -> DataFrame:
    """Times for words without one, in proportion to their length between the timed words around them.

    words: keys, word_idx, word, start_s and end_s (null if unmatched),
    line_start, line_end.  Filled words get confidence 0.65; others keep the
    column confidence, or get 1 without one.  A word ends at 95 % of its slot,
    the last of a gap at the gap's end.  With a column heard (the line's heard
    words: start_s, end_s) a gap at an edge of the line ends ``slack`` beyond
    what was heard, and with words on its other side it takes 1.2 times the
    average heard word for each of its words.
    """
    trust = F.coalesce("confidence", F.lit(1.0)) if "confidence" in words.columns else F.lit(1.0)
    w = Window.partitionBy(*keys).orderBy("word_idx")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("word_idx")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("start_s").isNotNull()
    g = words.withColumns({"left": F.last("end_s", True).over(before), "right": F.last("start_s", True).over(after), "island": F.count("start_s").over(before)})
    gap = Window.partitionBy(*keys, "island", F.col("start_s").isNull())
    n = F.length("word")
    total = F.sum(n).over(gap)
    upto = F.coalesce(F.sum(n).over(gap.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left, right = F.coalesce("left", "line_start"), F.coalesce("right", "line_end")
    span = F.greatest(right - left, F.lit(least))
    if "heard" in words.columns:
        durations = F.transform(F.filter("heard", lambda x: x["end_s"] > x["start_s"]), lambda x: F.greatest(x["end_s"] - x["start_s"], F.lit(0.03)))
        mean = F.aggregate(durations, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(durations), F.lit(0))
        average = F.coalesce(mean, F.greatest(F.lit(0.06), (F.col("line_end") - F.col("line_start")) / F.count("*").over(Window.partitionBy(*keys))))
        inside = average * F.count("*").over(gap)
        first = F.greatest("line_start", F.coalesce(F.array_min(F.transform("heard", lambda x: x["start_s"])), "line_start") - slack)
        last = F.least("line_end", F.coalesce(F.array_max(F.transform("heard", lambda x: x["end_s"])), "line_end") + slack)
        left = F.coalesce("left", F.when(F.col("right").isNull(), first).otherwise(F.greatest(first, F.col("right") - inside * 1.2)))
        right = F.coalesce("right", F.when(F.col("left").isNull(), last).otherwise(F.least(last, F.col("left") + inside * 1.2)))
        short = F.least(left + F.greatest(F.lit(least), inside), F.coalesce("right", "line_end"))
        end = F.when(right > left + 1e-4, right).otherwise(F.when(short > left + 1e-4, short).otherwise(left + least))
        span = end - left
    start, slot = left + span * upto / total, span * n / total
    closes = F.col("word_idx") == F.max("word_idx").over(gap)
    stop = F.when(closes, left + span).otherwise(start + slot * 0.95)
    return g.select(
        *keys, "word_idx", "word", F.round(F.when(known, F.col("start_s")).otherwise(start), 6).alias("start_s"), F.round(F.when(known, F.col("end_s")).otherwise(stop), 6).alias("end_s"), F.when(known, trust).otherwise(0.65).alias("confidence")
    )


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of two tokens; 0 for an empty one."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def token_similarity(pairs: DataFrame) -> DataFrame:
    """Adds ``similarity`` of columns a and b; each distinct pair is compared once."""

    @F.arrow_udf("double")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    distinct = pairs.select("a", "b").distinct().withColumn("similarity", compare("a", "b"))
    return pairs.join(distinct, pairs["a"].eqNullSafe(distinct["a"]) & pairs["b"].eqNullSafe(distinct["b"])).select(pairs["*"], "similarity")


def align_lists(left: list[str], right: list[str], least: float = 0.72) -> list[int | None]:
    """For each left token the place of its partner: equal runs, and replaced tokens that are similar enough."""
    out: list[int | None] = [None] * len(left)
    for tag, i, i2, j, j2 in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if tag == "equal":
            out[i:i2] = range(j, j2)
        elif tag == "replace":
            for k in range(min(i2 - i, j2 - j)):
                if similarity(left[i + k], right[j + k]) >= least:
                    out[i + k] = j + k
    return out


def align_words(lines: DataFrame) -> DataFrame:
    """Aligns two token lists of a row: (song, line_idx, left, right) -> song, line_idx, word_idx, partner."""
    schema = "song long, line_idx long, word_idx int, partner int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, i, k, p) for s, i, x, y in b[["song", "line_idx", "left", "right"]].itertuples(index=False) for k, p in enumerate(align_lists(list(x), list(y)))]
            yield pd.DataFrame(rows, columns=["song", "line_idx", "word_idx", "partner"]).astype({"partner": "Int32", "word_idx": "int32"})

    return lines.select("song", "line_idx", "left", "right").mapInPandas(run, schema)


def forced_partners(words: list[str], heard: list[str], least: float = 0.6) -> list[int | None]:
    """For each word the heard word under a cursor, which moves on for a similar one only."""
    out: list[int | None] = []
    at = 0
    for w in words:
        hit = at < len(heard) and similarity(w, heard[at]) >= least
        out.append(at if hit else None)
        at += hit
    return out


def forced_alignment(lines: DataFrame, heard: DataFrame, least: float = 0.6) -> DataFrame:
    """Words of lines with the times of a recogniser that was given their text.

    lines: track, idx, text, start_s, end_s.  heard: track, pos, word, start_s,
    end_s, confidence, in the order of pos.  One cursor a song runs over the
    heard words.  Unmatched words share the room between their neighbours, or up
    to the line's edge, with confidence 0.65.  Returns track, idx, word_idx,
    word, start_s, end_s, confidence; a line without words gives no row.
    """
    words = lines.select("track", "idx", F.col("start_s").alias("line_start"), F.col("end_s").alias("line_end"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("word_idx", "word"))
    text = words.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", "word_idx", token_norm(F.col("word")).alias("w")))).alias("ws"))
    sound = heard.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("pos", token_norm(F.col("word")).alias("w"), "start_s", "end_s", "confidence"))).alias("hs"))
    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("track", "idx")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for track, ws, hs in zip(b.column("track").to_pylist(), b.column("ws").to_pylist(), b.column("hs").to_pylist(), strict=True):
                hs = hs or []
                found = forced_partners([w["w"] for w in ws], [h["w"] for h in hs], least)
                rows += [(track, w["idx"], w["word_idx"], hs[k]["start_s"], hs[k]["end_s"], hs[k]["confidence"]) for w, k in zip(ws, found, strict=True) if k is not None]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [b.schema.field("track").type, b.schema.field("ws").type.value_type.field("idx").type, pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["track", "idx", "word_idx", "start_s", "end_s", "confidence"])

    pairs = text.join(sound, "track", "left").select("track", "ws", "hs").mapInArrow(run, f"track {kinds['track']}, idx {kinds['idx']}, word_idx int, start_s double, end_s double, confidence double")
    return fill_gaps(words.join(pairs, ["track", "idx", "word_idx"], "left"), ["track", "idx"], least=0.0)


def fallback_chain(songs: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of each song's first tier that has any, with a column tier; one row with tier ``error`` for a song without.

    songs: song.  tiers: (name, rows with a column song), best first, all of the
    same columns.  A tier that failed for a song simply has no rows of it.
    """
    rows = None
    for k, (name, df) in enumerate(tiers):
        one = df.withColumns({"tier": F.lit(name), "__priority": F.lit(k)})
        rows = one if rows is None else rows.unionByName(one)
    best = F.min("__priority").over(Window.partitionBy("song"))
    chosen = rows.withColumn("__best", best).filter("__priority = __best").drop("__priority", "__best")
    return songs.select("song").distinct().join(chosen, "song", "left").withColumn("tier", F.coalesce("tier", F.lit("error")))


def merge_statistics(words: DataFrame) -> DataFrame:
    """What came of merging, by song: lines_total, lines_with_coverage, lines_fallback, total_words, matched_words, interpolated_words, matched_word_ratio.

    words: song, line_idx, matched (whether a heard word gave the times).  A
    line without any matched word was timed in proportion.
    """
    line = words.groupBy("song", "line_idx").agg(F.count("*").alias("n"), F.count_if("matched").alias("m"))
    g = line.groupBy("song").agg(F.count("*").alias("lines_total"), F.count_if(F.col("m") > 0).alias("lines_with_coverage"), F.count_if(F.col("m") == 0).alias("lines_fallback"), F.sum("n").alias("total_words"), F.sum("m").alias("matched_words"))
    return g.withColumns({"interpolated_words": F.col("total_words") - F.col("matched_words"), "matched_word_ratio": F.round(ratio(F.col("matched_words").cast("double"), F.col("total_words")), 4)})


def quality_flags(found: DataFrame) -> DataFrame:
    """Adds ``flags``: what is doubtful about an alignment, sorted.

    found: matched_word_ratio, lines_total, lines_fallback (null if nothing
    was merged), offset_s, applied, improvement (null without a calibration)
    and backend_errors (a number).
    """
    far = F.abs("offset_s")
    idle = F.col("offset_s").isNotNull() & ~F.coalesce("applied", F.lit(False))
    unsure = F.coalesce("improvement", F.lit(0.0)) >= 0.02
    rules = (
        ("low_word_match_ratio", F.col("matched_word_ratio") < 0.65),
        ("many_lines_without_whisper_coverage", ratio(F.col("lines_fallback").cast("double"), F.col("lines_total")) > 0.35),
        ("large_global_offset_detected", far >= 0.25),
        ("offset_not_applied_low_confidence", idle & unsure),
        ("offset_detected_but_not_applied", idle & ~unsure & (far >= 0.05)),
        ("backend_fallback_used", F.col("backend_errors") > 0),
    )
    return found.withColumn("flags", flags(*rules))


# Corrections -----------------------------------------------------------------


def apply_corrections(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """Overwrites the times of words of corrected phrases.

    words: song, line_idx, text, word_idx, start_s, end_s.  corrections: song,
    line_idx, text, word_idx, status, start_s, end_s.  A phrase applies if its
    number and trimmed text agree; verified and automatic ones change nothing.
    """
    c = corrections.select("song", "line_idx", F.trim("text").alias("__text"), "word_idx", "status", F.col("start_s").alias("__s"), F.col("end_s").alias("__e"))
    latest = Window.partitionBy("song", "line_idx", "word_idx").orderBy(F.desc("status"), F.desc("__s"), F.desc("__e"), F.desc("__text"))
    c = c.withColumn("__r", F.row_number().over(latest)).filter("__r = 1").drop("__r")  # one for each word
    on = ["song", "line_idx", "word_idx"]
    j = words.join(c, on, "left")
    same = F.coalesce(F.col("__text") == F.trim("text"), F.lit(False))
    use = same & (F.col("status") == "corrected")
    outcome = F.when(F.col("status").isNull() | (F.col("status") == "auto"), "auto").when(~same, "mismatched").otherwise(F.col("status"))
    return j.select(*[c for c in words.columns if c not in ("start_s", "end_s")], F.when(use, F.coalesce("__s", "start_s")).otherwise(F.col("start_s")).alias("start_s"), F.when(use, F.coalesce("__e", "end_s")).otherwise(F.col("end_s")).alias("end_s"), outcome.alias("outcome"))


def merge_template(fresh: DataFrame, earlier: DataFrame) -> DataFrame:
    """A new template of phrases (song, line_idx, text, status) that keeps earlier work on the same phrase."""
    e = earlier.filter("status <> 'auto'").select("song", "line_idx", "text", F.col("status").alias("__status"))
    return fresh.join(e, ["song", "line_idx", "text"], "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def taps_to_words(words: DataFrame, taps: DataFrame, gap: float = 0.05, least: float = 0.02) -> DataFrame:
    """The i-th tap begins the i-th word of a song; a word ends just before the next tap, the last of a line with the line.

    words: song, line_idx, word_idx, start_s, end_s, line_end.  taps: song, t.
    """
    order = Window.partitionBy("song").orderBy("line_idx", "word_idx")
    line_end = F.lead("line_idx").over(order)
    w = words.withColumns({"i": F.row_number().over(order), "closes": F.coalesce(line_end != F.col("line_idx"), F.lit(True))})
    t = taps.withColumn("i", F.row_number().over(Window.partitionBy("song").orderBy("t")))
    t = t.withColumn("next_t", F.lead("t").over(Window.partitionBy("song").orderBy("t")))
    j = w.join(t, ["song", "i"], "left")
    end = F.when(F.col("closes") | F.col("next_t").isNull(), F.col("line_end")).otherwise(F.col("next_t") - gap)
    out = j.withColumns({"tapped": F.col("t").isNotNull(), "start_s": F.coalesce("t", "start_s"), "end_s": F.when(F.col("t").isNotNull(), F.greatest(F.round(end, 3), F.round(F.col("t") + least, 3))).otherwise(F.col("end_s"))})
    status = F.when(F.max(F.col("tapped").cast("int")).over(Window.partitionBy("song", "line_idx")) == 1, "corrected").otherwise("auto")
    return out.select("song", "line_idx", "word_idx", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "tapped", status.alias("status"))


def alignment_quality(words: DataFrame) -> DataFrame:
    """How far corrections moved words (song, start_s, original_start_s): absolute and signed statistics."""
    d = words.withColumn("d", F.col("start_s") - F.col("original_start_s"))
    a = F.abs("d")
    pct = lambda x: F.round(ratio(100.0 * F.count_if(a <= x), F.count("d")), 1)
    return d.groupBy("song").agg(F.count("d").alias("n"), F.round(F.avg(a), 4).alias("mean_abs"), F.round(F.percentile(a, F.lit(0.5)), 4).alias("median_abs"), F.round(F.max(a), 4).alias("max_abs"), pct(0.1).alias("within_100"), pct(0.2).alias("within_200"), F.round(F.avg("d"), 4).alias("offset"))


def silence_audit(words: DataFrame, frames: DataFrame) -> DataFrame:
    """Words that begin in silence or early: level at their first frame against their peak, and the delay to 15 % of it.

    words: track, word_id, start_s, end_s of at least 40 ms.  frames: track, t, rms.
    """
    from .joins import interval_join

    j = interval_join(frames.select("track", "t", "rms"), words.filter(F.col("end_s") - F.col("start_s") >= 0.04).select("track", "word_id", "start_s", "end_s"), "t", 5.0)
    g = j.groupBy("track", "word_id", "start_s").agg(F.max("rms").alias("peak"), F.min_by("rms", "t").alias("first"), F.array_sort(F.collect_list(F.struct("t", "rms"))).alias("fr"))
    reach = F.get(F.filter("fr", lambda x: x["rms"] >= F.col("peak") * 0.15), F.lit(0))["t"]
    return g.select("track", "word_id", (ratio(F.col("first"), F.col("peak")) < 0.10).alias("in_silence"), F.coalesce(reach - F.col("start_s") > 0.10, F.lit(False)).alias("early"))
