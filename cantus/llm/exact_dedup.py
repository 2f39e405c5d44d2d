"""Exact deduplication with a log-structured merge index of text digests.

Rows enter memtables of a bounded number of rows; each memtable is flushed as
a run sorted by digest.  Compaction merges runs into a level: one entry per
digest with the smallest and the largest identifier and the number of rows,
and beside it a filter, a bitmap of its digests.  A later batch becomes a
level of its own; two levels are merged by grouping just those entries that
the other level's filter may hold, and a look-up reads the entries only for
digests that the filter may hold.  A digest that more than one row carries is
a hit, and hits are verified byte by byte against the text of the row that
stays, so that equal digests of different texts would still come out as
different texts.

Only DataFrame functions are used: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, save

#: Rows of a memtable, and so of a run.
MEMTABLE_ROWS = 1 << 16
#: Bits of a filter for each value, and its bounds: 4 KB to 32 MB, so it may be broadcast.
BITS_PER_VALUE, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 28
#: bitmap_construct_agg keeps 32,768 bits in a bucket.
_BUCKET = 32768
#: Rows of one digest that are verified in one task, about.
SALT_ROWS = 256


@dataclass
class Filter:
    """A bitmap of values: rows (bucket, bits) of ``size`` bits in all.  Beyond MOST_BITS / 16 values more and more pass; none is lost."""

    rows: DataFrame
    size: int


@dataclass
class Level:
    """``entries``: digest, least_id, most_id, n, sorted by digest in each file; ``filter``: of their digests."""

    entries: DataFrame
    filter: Filter


def digest_of(text: Column) -> Column:
    """SHA-256 of a text with A-Z lower-cased; a null is the empty text."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


# Filters ---------------------------------------------------------------------


def _bit(value: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(size))


def filter_of(rows: DataFrame, column: str) -> Filter:
    """The filter of all values of ``column``, sized by how many rows there are."""
    wanted = max(LEAST_BITS, BITS_PER_VALUE * rows.count())
    size = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    bit = _bit(F.col(column), size)
    bits = rows.groupBy((bit / _BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg((bit % _BUCKET).cast("long")).alias("bits"))
    return Filter(save(bits, "filter"), size)


def probe(rows: DataFrame, column: str, of: Filter, held: bool = True) -> DataFrame:
    """The rows whose value the filter may hold, or with ``held`` false those that it surely doesn't hold.

    The filter is bounded by MOST_BITS, so it is broadcast.
    """
    bit, bucket, bits = (free_name(rows, x) for x in ("__bit", "__bucket", "__bits"))
    placed = rows.withColumn(bit, _bit(F.col(column), of.size)).withColumn(bucket, (F.col(bit) / _BUCKET).cast("int"))
    joined = placed.join(F.broadcast(of.rows.toDF(bucket, bits)), bucket, "left")
    byte = f"conv(hex(substring({bits}, cast(({bit} % {_BUCKET}) div 8 as int) + 1, 1)), 16, 10)"
    has = F.coalesce(F.expr(f"shiftright(cast({byte} as int), cast({bit} % 8 as int)) & 1") == 1, F.lit(False))
    return joined.filter(has if held else ~has).select(rows.columns)


# The index -------------------------------------------------------------------


def flush_runs(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(run, digest, doc_id): memtables of at most ``memtable_rows`` rows in their order of arrival, each sorted by digest."""
    at = F.monotonically_increasing_id()  # task << 33 | row
    run = F.shiftleft(F.shiftright(at, 33), 24) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / memtable_rows)
    rows = docs.select(run.alias("run"), digest_of(F.col("text")).alias("digest"), "doc_id")
    return save(rows.sortWithinPartitions("run", "digest"), "digest-runs")


def _level(entries: DataFrame) -> Level:
    entries = save(entries.sortWithinPartitions("digest"), "digest-entries")
    return Level(entries, filter_of(entries, "digest"))


def compact(runs: DataFrame) -> Level:
    """Merges runs: one entry per digest."""
    return _level(runs.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"), F.count("*").alias("n")))


def build(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> Level:
    return compact(flush_runs(docs, memtable_rows))


def merge(a: Level, b: Level) -> Level:
    """One level of two; only entries that the other's filter may hold are grouped again."""
    both = probe(a.entries, "digest", b.filter).unionByName(probe(b.entries, "digest", a.filter))
    merged = both.groupBy("digest").agg(F.min("least_id").alias("least_id"), F.max("most_id").alias("most_id"), F.sum("n").alias("n"))
    return _level(merged.unionByName(probe(a.entries, "digest", b.filter, held=False)).unionByName(probe(b.entries, "digest", a.filter, held=False)))


def copies_of(batch: DataFrame, stored: DataFrame, level: Level) -> DataFrame:
    """Rows of a later batch (doc_id, text) whose text a stored document has: doc_id, copy_of (the smallest identifier), text_sha256.

    stored: the documents behind ``level``.  Hits are verified on the whole
    texts; a digest's stored text is read once, by its smallest identifier.
    """
    mine = batch.select("doc_id", ascii_lower(F.col("text")).alias("norm"), digest_of(F.col("text")).alias("digest"))
    found = probe(mine, "digest", level.filter).join(level.entries.select("digest", F.col("least_id").alias("copy_of")), "digest")
    wanted = found.select("digest", "copy_of").distinct()
    theirs = stored.select(F.col("doc_id").alias("copy_of"), ascii_lower(F.col("text")).alias("kept_norm"), digest_of(F.col("text")).alias("digest"))
    texts = theirs.join(wanted, theirs["digest"].eqNullSafe(wanted["digest"]) & theirs["copy_of"].eqNullSafe(wanted["copy_of"]), "left_semi").groupBy("digest").agg(F.first("kept_norm").alias("kept_norm"))
    return found.join(texts, "digest").filter("norm = kept_norm").select("doc_id", "copy_of", F.lower(F.hex("digest")).alias("text_sha256"))


# Groups ----------------------------------------------------------------------


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't in ``gone``, columns as they are.

    gone: doc_id, and text_sha256 if rows of one id are to be told apart by
    their texts (lower-cased A-Z).  Rows outside the filter of what goes stay
    where they are; only the rest is shuffled to be compared exactly.
    """
    by_text = "text_sha256" in gone.columns
    gone = gone.select(F.col("doc_id").alias("__gone"), (F.col("text_sha256") if by_text else F.lit(None).cast("string")).alias("__text")).distinct()
    held = filter_of(gone, "__gone")
    same = F.col("doc_id").eqNullSafe(F.col("__gone"))
    if by_text:
        same &= F.lower(F.hex(digest_of(F.col("text")))) == F.col("__text")
    stay = probe(docs, "doc_id", held).join(gone, same, "left_anti")
    return probe(docs, "doc_id", held, held=False).unionByName(stay)


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    groups = save(exact_groups(docs, keep).select("doc_id", "kept", "text_sha256"), "exact-groups")
    held = filter_of(groups.filter("NOT kept"), "doc_id")
    sha, nth = free_name(docs, "__sha"), free_name(docs, "__nth")
    suspects = probe(docs, "doc_id", held).withColumn(sha, F.lower(F.hex(digest_of(F.col("text")))))
    kept = groups.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col(sha) == F.col("__kept_sha"))
    first = F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.lit(0)))
    stay = suspects.join(kept, same, "left_semi").withColumn(nth, first).filter(F.col(nth) == 1).select(docs.columns)
    return probe(docs, "doc_id", held, held=False).unionByName(stay)


def exact_groups(docs: DataFrame, keep: str = "largest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Groups of equal texts; equal means identical after lower-casing A-Z.

    docs: doc_id, text and any other columns (they are ignored, whatever
    their names).  Returns one row per input row: doc_id, keep_id,
    group_size, kept, text_sha256.

    A null text counts as the empty text.  Repeated rows with one doc_id
    and one text count as rows of the group, and just one of them is kept.
    A null doc_id is below all others: such a row stays only in a group
    without another id.  An empty table gives an empty result.

    Texts of one digest are dealt to several tasks, about SALT_ROWS to each,
    and the text of the row that stays goes to all of them.
    """
    docs = docs.select("doc_id", "text")
    entries = build(docs, memtable_rows).entries
    winner = "most_id" if keep == "largest" else "least_id"
    hits = save(entries.filter("n > 1").select("digest", F.col(winner).alias("keep_id"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "hits")
    texts = docs.select("doc_id", ascii_lower(F.col("text")).alias("norm"), digest_of(F.col("text")).alias("digest"))
    suspects = save(probe(texts, "digest", filter_of(hits, "digest")).join(hits, "digest"), "digest-hits")
    stays = suspects.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("norm").alias("kept_norm"), F.max("salts").alias("salts"))
    stays = stays.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    verified = dealt.join(stays, ["digest", "salt"]).select("digest", "doc_id", F.when(F.col("norm") != F.col("kept_norm"), F.col("norm")).alias("other"))
    # Dealt anew by id, so that a join partition of one hot digest can be split.
    verified = save(verified.repartition("doc_id").groupBy("digest", "other", "doc_id").agg(F.count("*").alias("copies")), "verified-hits")
    pick = F.max if keep == "largest" else F.min
    classes = verified.groupBy("digest", "other").agg(pick("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    same = (F.col("v.digest") == F.col("c.digest")) & F.col("v.other").eqNullSafe(F.col("c.other"))
    several = verified.alias("v").join(classes.alias("c"), same).select("v.digest", "v.doc_id", "v.copies", "c.keep_id", "c.group_size")
    several = several.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    single = entries.filter("n = 1").select("digest", F.col("most_id").alias("doc_id"), F.col("most_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).alias("nth"))
    return several.unionByName(single).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
