"""Registered queries of lyrics, timing and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import lyrics as L
from ..operators import series as T
from . import views as V

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_STAMP = "'[' || lpad((line_idx % 7)::VARCHAR, 2, '0') || ':' || lpad(((line_idx * 5) % 60)::VARCHAR, 2, '0') || '.' || CASE WHEN line_idx % 3 = 0 THEN '25' ELSE '125' END || ']' || CASE WHEN line_idx % 5 = 4 THEN ' ' ELSE ' ' || replace(text, chr(10), ' ') END"


def _lrc(spark, sf):
    """One timed text for each song, made of its lines; every fifth has a stamp and no words."""
    i = F.col("line_idx")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    words = F.when(i % 5 == 4, " ").otherwise(F.concat(F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" "))))
    line = F.concat(F.lit("["), two(i % 7), F.lit(":"), two((i * 5) % 60), F.lit("."), F.when(i % 3 == 0, "25").otherwise("125"), F.lit("]"), words)
    lines = V.lyric_lines(spark, sf).select("song", F.struct("line_idx", line.alias("line")).alias("x"))
    return lines.groupBy("song").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


@query("parse_lrc", V.with_views(
    f"""WITH s AS (SELECT song, (row_number() OVER (PARTITION BY song ORDER BY line_idx) - 1)::INTEGER AS line_no, trim({_STAMP}) AS raw FROM lines),
        m AS (SELECT song, line_no, trim(regexp_extract(raw, '^\\[(\\d{{1,2}}):(\\d{{2}})\\.(\\d{{2,3}})\\](.*)', 4)) AS text, regexp_extract(raw, '^\\[(\\d{{1,2}}):', 1)::INTEGER * 60 + regexp_extract(raw, ':(\\d{{2}})\\.', 1)::INTEGER
          + CASE WHEN len(regexp_extract(raw, '\\.(\\d{{2,3}})\\]', 1)) = 2 THEN regexp_extract(raw, '\\.(\\d{{2,3}})\\]', 1)::INTEGER * 10 ELSE regexp_extract(raw, '\\.(\\d{{2,3}})\\]', 1)::INTEGER END / 1000.0::DOUBLE AS start_s FROM s)
        SELECT * FROM (SELECT song, line_no, text, start_s, coalesce(lead(start_s) OVER (PARTITION BY song ORDER BY start_s, line_no), start_s + 5.0::DOUBLE) AS end_s FROM m) WHERE text <> ''""", "lines"))
def parse_lrc(spark, sf):
    return L.parse_lrc(_lrc(spark, sf))


_WORDS = r"""wd AS (SELECT song, line_idx, text, start_s AS ls, end_s AS le, w.i::INTEGER - 1 AS word_idx, w.word FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM lines),
  LATERAL (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS i) w),
  tm AS (SELECT *, sum(len(word)) OVER (PARTITION BY song, line_idx) AS total, coalesce(sum(len(word)) OVER (PARTITION BY song, line_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, lead(word) OVER (PARTITION BY song, line_idx ORDER BY word_idx) IS NULL AS is_last FROM wd),
  words AS (SELECT song, line_idx, text, word_idx, word, ls, le, round(ls + (le - ls) * upto / total, 6) AS start_s, round(CASE WHEN is_last THEN le ELSE ls + (le - ls) * upto / total + (le - ls) * len(word) / total * 0.95::DOUBLE END, 6) AS end_s FROM tm)"""


def _words(spark, sf):
    return L.time_words(V.lyric_lines(spark, sf), ["song", "line_idx"])


@query("word_timing", V.with_views("SELECT song, line_idx, word_idx, word, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM words", "lines", more=_WORDS))
def word_timing(spark, sf):
    return _words(spark, sf).select("song", "line_idx", "word_idx", "word", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


_SOUND = """CASE WHEN w[1:2] IN ('kn','gn','mn') THEN 'nasal' WHEN w[1:2] IN ('wr','wh') THEN 'approximant' WHEN w[1:2] IN ('th','sh') THEN 'fricative' WHEN w[1:2] IN ('ps','pn','pt','gh') THEN 'vowel' WHEN w[1:2] = 'ch' OR w[1] = 'j' THEN 'affricate'
  WHEN w[1] = 'c' THEN CASE WHEN w[2] IN ('e','i','y') THEN 'fricative' ELSE 'plosive' END WHEN w[1] IN ('q','b','d','g','k','p','t') THEN 'plosive' WHEN w[1] IN ('x','f','h','s','z') THEN 'fricative'
  WHEN w[1] IN ('m','n') THEN 'nasal' WHEN w[1] IN ('l','r','w','y') THEN 'approximant' WHEN w[1] IN ('a','e','i','o','u') THEN 'vowel' ELSE 'unknown' END"""
_LEAD = "CASE sound WHEN 'plosive' THEN 0.055::DOUBLE WHEN 'affricate' THEN 0.045 WHEN 'fricative' THEN 0.025 WHEN 'nasal' THEN 0.02 WHEN 'approximant' THEN 0.02 WHEN 'vowel' THEN 0.005 ELSE 0.04 END"


@query("word_sounds", V.with_views(
    f"""WITH a AS (SELECT song, line_idx, word_idx, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS token, lower(regexp_replace(word, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g')) AS w FROM words)
        SELECT song, line_idx, word_idx, token, {_SOUND} AS sound FROM a""", "lines", more=_WORDS))
def word_sounds(spark, sf):
    """Normalised tokens and the class of their first sound."""
    return _words(spark, sf).select("song", "line_idx", "word_idx", L.token_norm(F.col("word")).alias("token"), L.first_sound(F.col("word")).alias("sound"))


@query("strip_markers", V.with_views(
    r"""SELECT song, line_idx, trim(regexp_replace(regexp_replace('[Verse]' || chr(10) || text || chr(10) || chr(10) || chr(10) || '[Chorus 2]' || chr(10) || 'end', '(?m)^\s*\[[^\]\n]*\]\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS plain FROM lines""", "lines"))
def strip_markers(spark, sf):
    full = F.concat(F.lit("[Verse]\n"), "text", F.lit("\n\n\n[Chorus 2]\nend"))
    return V.lyric_lines(spark, sf).select("song", "line_idx", L.strip_markers(full).alias("plain"))


@query("word_raster", V.with_views(
    "SELECT song, count(DISTINCT f) AS frames, min(f) AS \"first\", max(f) AS \"last\" FROM (SELECT song, unnest(range(floor(start_s * 10)::BIGINT, ceil(end_s * 10)::BIGINT)) AS f FROM words) GROUP BY song", "lines", more=_WORDS))
def word_raster(spark, sf):
    return L.rasterise(_words(spark, sf), 10.0).groupBy("song").agg(F.count("*").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


@query("lyric_activity", V.with_views(
    """WITH tl AS (SELECT song AS track, f * 0.5::DOUBLE + 0.001::DOUBLE AS t FROM (SELECT song, unnest(range(0, floor(max(end_s) * 2)::BIGINT + 1)) AS f FROM words GROUP BY song)),
       sg AS (SELECT tl.track, tl.t, l.line_idx, l.text FROM tl LEFT JOIN lines l ON l.song = tl.track AND tl.t >= l.start_s AND tl.t < l.end_s - 0.7::DOUBLE),
       wi AS (SELECT sg.track, sg.t, sg.line_idx, any_value(sg.text) AS text, min(w.word_idx) FILTER (sg.t >= w.start_s + 0.1::DOUBLE AND sg.t < w.end_s) AS held, max(w.word_idx) FILTER (w.end_s <= sg.t) AS past FROM sg LEFT JOIN words w ON w.song = sg.track AND w.line_idx = sg.line_idx GROUP BY ALL)
       SELECT wi.track, round(wi.t, 3) AS t, coalesce(w.word, '') AS active_word, coalesce(w.word_idx, -1)::INTEGER AS active_word_index, CASE WHEN w.word IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS word_confidence,
         floor(CASE WHEN held IS NOT NULL THEN (wi.t - w.start_s - 0.1::DOUBLE) / greatest(w.end_s - w.start_s - 0.1::DOUBLE, 1e-6) WHEN past IS NOT NULL THEN 1 ELSE 0 END * 1000 + 1e-6) / 1000 AS word_progress, coalesce(w.word, '') <> '' AS word_active, coalesce(wi.text, '') <> '' AS phrase_active
       FROM wi LEFT JOIN words w ON w.song = wi.track AND w.line_idx = wi.line_idx AND w.word_idx = coalesce(wi.held, wi.past)""", "lines", more=_WORDS))
def lyric_activity(spark, sf):
    """Every half second: lines end early and words begin late, so there are times between lines and between words."""
    w = _words(spark, sf).select(F.col("song").alias("track"), F.col("line_idx").alias("idx"), "word_idx", "word", "start_s", "end_s", "confidence")
    times = w.groupBy("track").agg(F.max("end_s").alias("m")).withColumn("f", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") * 2).cast("int")))).select("track", (F.col("f") * 0.5 + 0.001).alias("t"))
    lines = V.lyric_lines(spark, sf).select(F.col("song").alias("track"), F.col("line_idx").alias("idx"), "text", "start_s", (F.col("end_s") - 0.7).alias("end_s"))
    out = L.lyric_activity(times, lines, w.withColumn("start_s", F.col("start_s") + 0.1))
    return out.drop("active_segment").withColumns({"t": F.round("t", 3), "word_progress": F.floor(F.col("word_progress") * 1000 + 1e-6) / 1000.0})


@query("gap_fill", V.with_views(
    """WITH k AS (SELECT *, CASE WHEN word_idx % 4 IN (1, 2) THEN NULL ELSE start_s END AS s, CASE WHEN word_idx % 4 IN (1, 2) THEN NULL ELSE end_s END AS e, 0.5::DOUBLE + (word_idx % 3) / 10.0::DOUBLE AS c FROM words),
       h AS (SELECT song, line_idx, min(s) AS first_heard, max(e) AS last_heard, avg(greatest(0.03::DOUBLE, e - s)) FILTER (e > s) AS heard_dur, count(*) AS nw FROM k GROUP BY ALL),
       g AS (SELECT k.*, h.* EXCLUDE (song, line_idx), last_value(e IGNORE NULLS) OVER w AS la, first_value(s IGNORE NULLS) OVER (PARTITION BY k.song, k.line_idx ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ra, count(s) OVER w AS island
             FROM k JOIN h ON h.song = k.song AND h.line_idx = k.line_idx WINDOW w AS (PARTITION BY k.song, k.line_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       t AS (SELECT *, sum(len(word)) OVER p AS total, coalesce(sum(len(word)) OVER (PARTITION BY song, line_idx, island, s IS NULL ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, word_idx = max(word_idx) OVER p AS closes,
               count(*) OVER p * coalesce(heard_dur, greatest(0.06::DOUBLE, (le - ls) / nw)) AS need, greatest(ls, coalesce(first_heard, ls) - 0.6::DOUBLE) AS fst, least(le, coalesce(last_heard, le) + 0.6::DOUBLE) AS lst FROM g WINDOW p AS (PARTITION BY song, line_idx, island, s IS NULL)),
       u AS (SELECT *, CASE WHEN la IS NOT NULL THEN la WHEN ra IS NULL THEN fst ELSE greatest(fst, ra - need * 1.2::DOUBLE) END AS l, CASE WHEN ra IS NOT NULL THEN ra WHEN la IS NULL THEN lst ELSE least(lst, la + need * 1.2::DOUBLE) END AS r0 FROM t),
       v AS (SELECT *, least(l + greatest(0.06::DOUBLE, need), coalesce(ra, le)) AS r1 FROM u),
       x AS (SELECT *, CASE WHEN r0 > l + 1e-4 THEN r0 WHEN r1 > l + 1e-4 THEN r1 ELSE l + 0.06::DOUBLE END AS r FROM v)
       SELECT song, line_idx, word_idx, word, floor(round(CASE WHEN s IS NOT NULL THEN s ELSE l + (r - l) * upto / total END, 6) * 1000) / 1000 AS start_s,
         floor(round(CASE WHEN s IS NOT NULL THEN e WHEN closes THEN r ELSE l + (r - l) * upto / total + (r - l) * len(word) / total * 0.95::DOUBLE END, 6) * 1000) / 1000 AS end_s, CASE WHEN s IS NOT NULL THEN c ELSE 0.65::DOUBLE END AS confidence FROM x""", "lines", more=_WORDS))
def gap_fill(spark, sf):
    """Lines of which half of the words weren't heard; the others count as all that was."""
    from pyspark.sql import Window

    lost = (F.col("word_idx") % 4).isin(1, 2)
    w = _words(spark, sf).withColumns({"start_s": F.when(lost, None).otherwise(F.col("start_s")), "end_s": F.when(lost, None).otherwise(F.col("end_s")), "confidence": F.lit(0.5) + F.col("word_idx") % 3 / 10.0})
    heard = F.collect_list(F.when(~lost, F.struct("start_s", "end_s"))).over(Window.partitionBy("song", "line_idx"))
    lines = V.lyric_lines(spark, sf).select("song", "line_idx", F.col("start_s").alias("line_start"), F.col("end_s").alias("line_end"))
    out = L.fill_gaps(w.withColumn("heard", heard).join(lines, ["song", "line_idx"]), ["song", "line_idx"])
    return out.withColumns({c: F.floor(F.col(c) * 1000) / 1000.0 for c in ("start_s", "end_s")})


_CORR = """corr_ AS (SELECT song, line_idx, CASE WHEN line_idx % 3 = 2 THEN 'other' ELSE '  ' || text END AS text, word_idx, CASE WHEN line_idx % 11 = 3 THEN 'verified' WHEN line_idx % 2 = 0 THEN 'corrected' ELSE 'auto' END AS status,
  start_s + 0.1::DOUBLE * (line_idx % 3 - 1) AS s, end_s + 0.1::DOUBLE AS e FROM words)"""


def _corrections(spark, sf):
    lines = V.lyric_lines(spark, sf).select("song", "line_idx", "text")
    w = _words(spark, sf).join(lines, ["song", "line_idx"])
    i = F.col("line_idx")
    c = w.select("song", "line_idx", F.when(i % 3 == 2, "other").otherwise(F.concat(F.lit("  "), "text")).alias("text"), "word_idx", F.when(i % 11 == 3, "verified").when(i % 2 == 0, "corrected").otherwise("auto").alias("status"), (F.col("start_s") + 0.1 * (i % 3 - 1)).alias("start_s"), (F.col("end_s") + 0.1).alias("end_s"))
    return w, c


@query("apply_corrections", V.with_views(
    """SELECT w.song, w.line_idx, w.word_idx, round(CASE WHEN trim(c.text) = trim(w.text) AND c.status = 'corrected' THEN c.s ELSE w.start_s END, 6) AS start_s, round(CASE WHEN trim(c.text) = trim(w.text) AND c.status = 'corrected' THEN c.e ELSE w.end_s END, 6) AS end_s,
       CASE WHEN c.status = 'auto' THEN 'auto' WHEN trim(c.text) <> trim(w.text) THEN 'mismatched' ELSE c.status END AS outcome FROM words w JOIN corr_ c USING (song, line_idx, word_idx)""", "lines", more=_WORDS + ", " + _CORR))
def apply_corrections(spark, sf):
    out = L.apply_corrections(*_corrections(spark, sf))
    return out.select("song", "line_idx", "word_idx", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "outcome")


@query("alignment_quality", V.with_views(
    """SELECT w.song, count(*) AS n, round(avg(abs(c.s - w.start_s)), 4) AS mean_abs, round(quantile_cont(abs(c.s - w.start_s), 0.5), 4) AS median_abs, round(max(abs(c.s - w.start_s)), 4) AS max_abs, round(100.0::DOUBLE * count(*) FILTER (round(abs(c.s - w.start_s), 6) <= 0.1) / count(*), 1) AS within_100,
       round(100.0::DOUBLE * count(*) FILTER (abs(c.s - w.start_s) <= 0.2) / count(*), 1) AS within_200, round(avg(c.s - w.start_s), 4) AS "offset" FROM words w JOIN corr_ c USING (song, line_idx, word_idx) WHERE c.status = 'corrected' GROUP BY w.song""", "lines", more=_WORDS + ", " + _CORR))
def alignment_quality(spark, sf):
    w, c = _corrections(spark, sf)
    moved = c.filter("status = 'corrected'").join(w.select("song", "line_idx", "word_idx", F.col("start_s").alias("original_start_s")), ["song", "line_idx", "word_idx"])
    moved = moved.withColumn("start_s", F.col("original_start_s") + F.round(F.col("start_s") - F.col("original_start_s"), 6)).withColumn("start_s", F.round("start_s", 9))
    out = L.alignment_quality(moved.withColumns({"start_s": F.round(F.col("start_s") - F.col("original_start_s"), 6), "original_start_s": F.lit(0.0)}))
    return out


@query("correction_template", V.with_views(
    """WITH earlier AS (SELECT song, line_idx, CASE WHEN line_idx % 5 = 2 THEN text || '!' ELSE text END AS text, CASE line_idx % 4 WHEN 1 THEN 'verified' WHEN 2 THEN 'corrected' ELSE 'auto' END AS status FROM lines)
       SELECT l.song, l.line_idx, coalesce(e.status, 'auto') AS status FROM lines l LEFT JOIN earlier e ON e.song = l.song AND e.line_idx = l.line_idx AND e.text = l.text AND e.status <> 'auto'""", "lines"))
def correction_template(spark, sf):
    """Earlier work on phrases of which every fifth has another text by now."""
    lines = V.lyric_lines(spark, sf)
    i = F.col("line_idx") % 4
    text = F.when(F.col("line_idx") % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    earlier = lines.select("song", "line_idx", text.alias("text"), F.when(i == 1, "verified").when(i == 2, "corrected").otherwise("auto").alias("status"))
    return L.merge_template(lines.select("song", "line_idx", "text", F.lit("auto").alias("status")), earlier).select("song", "line_idx", "status")


@query("taps", V.with_views(
    """WITH c AS (SELECT * REPLACE (floor(start_s * 1000) / 1000 AS start_s, floor(end_s * 1000) / 1000 AS end_s), max(line_idx) OVER (PARTITION BY song) AS last_line FROM words),
       o AS (SELECT *, row_number() OVER w AS i, coalesce(lead(line_idx) OVER w <> line_idx, true) AS closes FROM c WINDOW w AS (PARTITION BY song ORDER BY line_idx, word_idx)),
       tp AS (SELECT song, i, floor(start_s * 100) / 100 + 0.03::DOUBLE AS t FROM o WHERE song % 2 = 1 OR line_idx < last_line), tq AS (SELECT song, t, row_number() OVER w AS i, lead(t) OVER w AS nt FROM tp WINDOW w AS (PARTITION BY song ORDER BY t)),
       j AS (SELECT o.*, tq.t, tq.nt FROM o LEFT JOIN tq ON tq.song = o.song AND tq.i = o.i)
       SELECT song, line_idx, word_idx, round(coalesce(t, start_s), 3) AS start_s, round(CASE WHEN t IS NOT NULL THEN greatest(round(CASE WHEN closes OR nt IS NULL THEN le ELSE nt - 0.05 END, 3), round(t + 0.02, 3)) ELSE end_s END, 3) AS end_s, t IS NOT NULL AS tapped,
       CASE WHEN max(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY song, line_idx) = 1 THEN 'corrected' ELSE 'auto' END AS status FROM j""", "lines", more=_WORDS))
def taps(spark, sf):
    """All words, tapped or not; in songs of even number the last line is left untapped."""
    from pyspark.sql import Window

    lines = V.lyric_lines(spark, sf).select("song", "line_idx", F.col("end_s").alias("line_end"))
    w = _words(spark, sf).join(lines, ["song", "line_idx"]).withColumns({c: F.floor(F.col(c) * 1000) / 1000.0 for c in ("start_s", "end_s")})
    t = w.withColumn("last_line", F.max("line_idx").over(Window.partitionBy("song"))).filter("song % 2 = 1 OR line_idx < last_line")
    return L.taps_to_words(w, t.select("song", (F.floor(F.col("start_s") * 100) / 100 + 0.03).alias("t")))


@query("token_similarity", None)
def token_similarity(spark, sf):
    """Similarity of each word with the next of its line, by an Arrow function over distinct pairs."""
    from pyspark.sql import Window

    w = _words(spark, sf).withColumn("a", L.token_norm(F.col("word")))
    p = w.select("song", "line_idx", "word_idx", "a", F.lead("a").over(Window.partitionBy("song", "line_idx").orderBy("word_idx")).alias("b")).filter("b IS NOT NULL")
    return L.token_similarity(p)


@query("sequence_alignment", None)
def sequence_alignment(spark, sf):
    """Aligns each line's tokens with a damaged copy of them."""
    t = V.lyric_lines(spark, sf).select("song", "line_idx", F.filter(F.transform(F.split("text", r"\s+"), L.token_norm), lambda x: x != "").alias("left"))
    return L.align_words(t.withColumn("right", F.transform(F.filter("left", lambda x, i: i % 5 != 2), lambda x, i: F.when(i % 7 == 3, F.concat(x, F.lit("s"))).otherwise(x))))


@query("forced_alignment", None)
def forced_alignment(spark, sf):
    """Lines against their own words as a recogniser heard them: some lost, some with another ending."""
    from pyspark.sql import Window

    lines = V.lyric_lines(spark, sf).select(F.col("song").alias("track"), F.col("line_idx").alias("idx"), "text", "start_s", "end_s")
    w = L.time_words(lines, ["track", "idx"])
    word = F.when(F.col("word_idx") % 7 == 3, F.concat("word", F.lit("s"))).otherwise(F.col("word"))
    pos = F.row_number().over(Window.partitionBy("track").orderBy("idx", "word_idx"))
    return L.forced_alignment(lines, w.filter("word_idx % 5 <> 2").select("track", pos.alias("pos"), word.alias("word"), (F.col("start_s") + 0.02).alias("start_s"), (F.col("end_s") + 0.02).alias("end_s"), F.lit(0.9).alias("confidence")))


@query("merge_stats", V.with_views(
    """SELECT song, count(DISTINCT line_idx) AS lines_total, count(DISTINCT line_idx) FILTER (m) AS lines_with_coverage, count(DISTINCT line_idx) - count(DISTINCT line_idx) FILTER (m) AS lines_fallback, count(*) AS total_words, count(*) FILTER (m) AS matched_words,
       count(*) - count(*) FILTER (m) AS interpolated_words, round(count(*) FILTER (m) / count(*)::DOUBLE, 4) AS matched_word_ratio FROM (SELECT *, word_idx % 4 NOT IN (1, 2) AND line_idx % 6 <> 5 AS m FROM words) GROUP BY song""", "lines", more=_WORDS))
def merge_stats(spark, sf):
    return L.merge_statistics(_words(spark, sf).withColumn("matched", ~(F.col("word_idx") % 4).isin(1, 2) & (F.col("line_idx") % 6 != 5)))


@query("tier_choice", V.with_views(
    """WITH t AS (SELECT song, line_idx, CASE WHEN song % 7 = 3 THEN NULL WHEN song % 3 = 0 THEN 'synced' WHEN song % 5 = 1 THEN 'forced' WHEN song % 2 = 0 THEN 'merge' ELSE 'proportional' END AS tier FROM lines)
       SELECT song, line_idx, tier FROM t WHERE tier IS NOT NULL UNION ALL SELECT DISTINCT song, CAST(NULL AS INTEGER), 'error' FROM t WHERE tier IS NULL""", "lines"))
def tier_choice(spark, sf):
    """Lines of each song by the first of four tiers that gave any; every seventh song has none."""
    lines = V.lyric_lines(spark, sf).select("song", F.col("line_idx").cast("int").alias("line_idx"))
    ok = lines.filter("song % 7 <> 3")
    return L.fallback_chain(lines, [("synced", ok.filter("song % 3 = 0")), ("forced", ok.filter("song % 5 = 1")), ("merge", ok.filter("song % 2 = 0")), ("proportional", ok)])


_FOUND = """found AS (SELECT song, CASE WHEN song % 7 <> 0 THEN round(avg(CASE WHEN (word_idx + song) % 10 < 3 + song % 7 THEN 1.0::DOUBLE ELSE 0 END), 4) END AS matched, CASE WHEN song % 7 <> 0 THEN count(DISTINCT line_idx) END AS lines_total,
  CASE WHEN song % 7 <> 0 THEN count(DISTINCT line_idx) FILTER (line_idx % 8 < song % 5) END AS fallback, CASE WHEN song % 6 <> 0 THEN (song % 13 - 6) / 20.0::DOUBLE END AS off, CASE WHEN song % 6 <> 0 THEN (song % 5) * 0.0075::DOUBLE END AS gain, CASE WHEN song % 9 = 4 THEN 1 ELSE 0 END AS errors FROM words GROUP BY song)"""


@query("quality_flags", V.with_views(
    """WITH d AS (SELECT *, abs(off) >= 0.03 AND 0.05::DOUBLE + (song % 11) / 100.0::DOUBLE >= 0.08 AND (gain >= 0.01 OR abs(off) >= 0.10 AND gain >= 0.005) AS applied FROM found)
       SELECT song, coalesce(applied, false) AS applied, array_to_string(list_sort(list_filter([CASE WHEN matched < 0.65 THEN 'low_word_match_ratio' END, CASE WHEN lines_total > 0 AND fallback / lines_total::DOUBLE > 0.35 THEN 'many_lines_without_whisper_coverage' END, CASE WHEN abs(off) >= 0.25 THEN 'large_global_offset_detected' END,
         CASE WHEN NOT applied AND gain >= 0.02 THEN 'offset_not_applied_low_confidence' END, CASE WHEN NOT applied AND gain < 0.02 AND abs(off) >= 0.05 THEN 'offset_detected_but_not_applied' END, CASE WHEN errors > 0 THEN 'backend_fallback_used' END], lambda x: x IS NOT NULL)), ',') AS flags FROM d""", "lines", more=_WORDS + ", " + _FOUND))
def quality_flags(spark, sf):
    """Doubts about each song's alignment, with stand-in measurements of merging and calibration; some songs lack one."""
    s = F.col("song")
    merged = lambda x: F.when(s % 7 != 0, x)
    g = _words(spark, sf).groupBy("song").agg(
        F.round(F.avg(F.when((F.col("word_idx") + s) % 10 < 3 + s % 7, 1.0).otherwise(0.0)), 4).alias("m"), F.countDistinct("line_idx").alias("n"), F.countDistinct(F.when(F.col("line_idx") % 8 < s % 5, F.col("line_idx"))).alias("k")
    )
    g = g.select("song", merged(F.col("m")).alias("matched_word_ratio"), merged(F.col("n")).alias("lines_total"), merged(F.col("k")).alias("lines_fallback"), F.when(s % 6 != 0, (s % 13 - 6) / 20.0).alias("offset_s"), F.when(s % 6 != 0, s % 5 * 0.0075).alias("improvement"), F.when(s % 9 == 4, 1).otherwise(0).alias("backend_errors"))
    g = g.withColumn("applied", F.coalesce(S.calibration_applies(F.col("offset_s"), F.lit(0.05) + s % 11 / 100.0, F.col("improvement")), F.lit(False)))
    return L.quality_flags(g).select("song", "applied", F.array_join("flags", ",").alias("flags"))


@query("onset_snap", V.with_views(
    f"""WITH v AS (SELECT track, note_id, onset_s + 0.05::DOUBLE AS s, offset_s + 0.05::DOUBLE AS e, ['pa', 'Chip', 'sun', 'my', '"Wrap', 'and', 'very'][note_id % 7 + 1] AS word FROM notes WHERE layer = 'vocals'),
       y AS (SELECT *, {_SOUND} AS sound FROM (SELECT *, lower(regexp_replace(word, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g')) AS w FROM v)), w AS (SELECT *, {_LEAD} AS lead_in FROM y), f AS (SELECT w.*, n.onset_s AS o FROM w ASOF LEFT JOIN (SELECT DISTINCT track, onset_s FROM notes) n ON w.track = n.track AND w.s <= n.onset_s),
       c AS (SELECT *, greatest(s, o - lead_in) AS ns FROM f), d AS (SELECT *, coalesce(o - s <= 2.0 AND ns - s >= 0.02 AND e - ns >= 0.05, false) AS snapped FROM c)
       SELECT track, note_id, round(CASE WHEN snapped THEN ns ELSE s END, 6) AS start_s, snapped FROM d""", "notes"))
def onset_snap(spark, sf):
    """Vocal notes as words that snap to the next onset of any layer within 2 s, less the lead-in of their first sound."""
    n = V.notes(spark, sf)
    word = F.element_at(F.array(*map(F.lit, ["pa", "Chip", "sun", "my", '"Wrap', "and", "very"])), (F.col("note_id") % 7 + 1).cast("int"))
    w = n.filter("layer = 'vocals'").select("track", "note_id", word.alias("word"), (F.col("onset_s") + 0.05).alias("start_s"), (F.col("offset_s") + 0.05).alias("end_s"))
    out = L.snap_to_onsets(w, n.select("track", F.col("onset_s").alias("t")), within=2.0)
    return out.select("track", "note_id", F.round("start_s", 6).alias("start_s"), "snapped")


@query("silence_audit", V.with_views(
    """WITH j AS (SELECT n.track, n.note_id AS word_id, n.onset_s AS s, f.t, f.rms FROM notes n JOIN frames f ON f.track = n.track AND f.t >= n.onset_s AND f.t < n.offset_s), g AS (SELECT track, word_id, s, max(rms) AS peak, arg_min(rms, t) AS fst FROM j GROUP BY ALL)
       SELECT g.track, g.word_id, CASE WHEN g.peak > 0 THEN g.fst / g.peak ELSE 0 END < 0.10 AS in_silence, coalesce(min(j.t) FILTER (j.rms >= g.peak * 0.15) - g.s > 0.10, false) AS early FROM g JOIN j ON j.track = g.track AND j.word_id = g.word_id GROUP BY g.track, g.word_id, g.s, g.peak, g.fst""", "notes", "frames"))
def silence_audit(spark, sf):
    w = V.notes(spark, sf).select("track", F.col("note_id").alias("word_id"), F.col("onset_s").alias("start_s"), F.col("offset_s").alias("end_s"))
    return L.silence_audit(w, V.frames(spark, sf))


@query("beat_align", V.with_views(
    """WITH a AS (SELECT n.note_id, n.track, n.onset_s, b.beat_idx AS i0 FROM notes n ASOF LEFT JOIN beats b ON b.track = n.track AND n.onset_s >= b.t)
       , c AS (SELECT note_id, onset_s, CASE WHEN i0 IS NULL THEN 0 WHEN i0 = 719 THEN 719 WHEN onset_s - i0 <= i0 + 1 - onset_s THEN i0 ELSE i0 + 1 END AS beat_idx FROM a)
       SELECT note_id, beat_idx::INTEGER AS beat_idx, round((onset_s - beat_idx) - floor(onset_s - beat_idx), 4) AS beat_phase FROM c""", "notes", "beats"))
def beat_align(spark, sf):
    n = V.notes(spark, sf)
    return J.beat_align(n, V.beats(n), "onset_s").select("note_id", "beat_idx", "beat_phase")


@query("drop_decay", V.with_views(
    """SELECT b.track, b.beat_idx, round(coalesce(exp(-(b.t - n.onset_s) / 2.5), 0), 6) AS pulse FROM beats b ASOF LEFT JOIN (SELECT DISTINCT track, onset_s FROM notes WHERE layer = 'drums') n ON n.track = b.track AND b.t >= n.onset_s""", "notes", "beats"))
def drop_decay(spark, sf):
    """Exponential decay since the last drum note at each beat; 0 before the first."""
    n = V.notes(spark, sf)
    j = J.as_of(V.beats(n), n.filter("layer = 'drums'"), "t", "onset_s", "last")
    return j.select("track", "beat_idx", F.round(F.coalesce(F.exp(-(F.col("t") - F.col("last")) / 2.5), F.lit(0.0)), 6).alias("pulse"))


@query("boundary_pulse", V.with_views(
    """WITH p AS (SELECT track, beat_idx, t + (track % 4) * 0.2::DOUBLE AS t FROM beats), a AS (SELECT p.track, p.beat_idx, max(0.85::DOUBLE * 0.5 * (1 + cos(pi() * abs(p.t - s.start_s) / 0.6::DOUBLE))) AS x FROM p JOIN activity s ON s.track = p.track AND s.start_s >= 1e-3 AND abs(p.t - s.start_s) < 0.6 GROUP BY ALL),
       b AS (SELECT p.track, p.beat_idx, max(0.40::DOUBLE * 0.5 * (1 + cos(pi() * abs(p.t - s.start_s - 30) / 0.35::DOUBLE))) AS x FROM p JOIN activity s ON s.track = p.track AND abs(p.t - s.start_s - 30) < 0.35 GROUP BY ALL)
       SELECT p.track, p.beat_idx, round(coalesce(a.x, 0), 6) AS section_pulse, round(coalesce(b.x, 0), 6) AS subsection_pulse FROM p LEFT JOIN a USING (track, beat_idx) LEFT JOIN b USING (track, beat_idx)""", "beats", "activity"))
def boundary_pulse(spark, sf):
    """Pulses at the begins of sections (not the first) and, weaker, in their middles, at times beside the beats."""
    n = V.notes(spark, sf)
    p = V.beats(n).withColumn("t", F.col("t") + F.col("track") % 4 * 0.2)
    at = V.activity(n).select("track", F.col("start_s").alias("t"))
    p = T.boundary_pulse(p, at.filter("t >= 1e-3"), "section_pulse", 0.6, 0.85)
    p = T.boundary_pulse(p, at.withColumn("t", F.col("t") + 30), "subsection_pulse", 0.35, 0.40)
    return p.select("track", "beat_idx", F.round("section_pulse", 6).alias("section_pulse"), F.round("subsection_pulse", 6).alias("subsection_pulse"))


@query("interp_signal", V.with_views(
    """WITH p AS (SELECT note_id, track, onset_s AS t FROM notes WHERE track IN (SELECT track FROM frames)), a AS (SELECT p.*, f.t AS t0, f.onset AS x0 FROM p ASOF LEFT JOIN frames f ON f.track = p.track AND p.t >= f.t), b AS (SELECT a.*, f.t AS t1, f.onset AS x1 FROM a ASOF LEFT JOIN frames f ON f.track = a.track AND a.t <= f.t)
       SELECT note_id, round(coalesce(x0 + (x1 - x0) * CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END, x0, x1), 6) AS value FROM b""", "notes", "frames"))
def interp_signal(spark, sf):
    f = V.frames(spark, sf)
    n = V.notes(spark, sf).join(f.select("track").distinct(), "track", "left_semi").select("track", "note_id", F.col("onset_s").alias("t"))
    return J.interpolate(n, f, "t", "onset").select("note_id", F.round("value", 6).alias("value"))
