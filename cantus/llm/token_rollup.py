"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder with one sub-folder per batch and kind:

``facts``   signed rows (doc_id, source, lang, version, tokens, sign)
``deltas``  their sums by source, lang and version
``commits`` an empty-bodied marker, written when both others are complete

A batch inserts, deletes or revises documents.  A delete takes back what the
store holds of a document under that version, a revision takes that back and
adds the new count.  Totals are the sums of the deltas of committed batches,
so a batch that failed half-way counts for nothing and is written again, and
a batch that is committed already is left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The character class of the words that ``count_words`` counts.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Tokens of the version ``words-1``: runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def count_with(path: str) -> Callable[[Column], Column]:
    """Tokens by a ``tokenizers`` file, without special tokens."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from .packing import tokenizer

        tok = tokenizer(path)
        for texts in batches:
            yield pa.array([len(x) // 4 for i in range(0, len(texts), 128) for x in tok.many(texts.slice(i, 128).to_pylist())], pa.int64())

    return count


class Rollup:
    """A store of token counts in ``folder``, which all executors must reach."""

    KEYS = ("source", "lang", "version")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, kind: str, batch: str) -> str:
        return f"{self.folder}/{kind}/{batch}"

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def committed(self) -> list[str]:
        """Names of committed batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def _read(self, kind: str) -> DataFrame | None:
        paths = [self._path(kind, b) for b in self.committed()]
        return self.spark.read.parquet(*paths) if paths else None

    def present(self, version: str, ids: DataFrame | None = None) -> DataFrame | None:
        """What the store holds under a version: (doc_id, source, lang, tokens, copies); only of the documents ``ids`` (doc_id), if given.

        Signed rows of other documents are dropped before anything is grouped.
        """
        facts = self._read("facts")
        if facts is None:
            return None
        mine = facts.filter(F.col("version") == version)
        if ids is not None:
            mine = mine.join(ids, "doc_id", "left_semi")
        held = mine.groupBy("doc_id", "source", "lang", "tokens").agg(F.sum("sign").alias("copies"))
        return held.filter("copies <> 0")

    def apply(self, batch: str, version: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None, counter: Callable[[Column], Column] = count_words) -> bool:
        """Commits a batch once; False if it was committed before.

        inserts, revisions: doc_id, source, lang, text.  deletes: doc_id.
        Other columns are ignored.  All inserted rows count, repeated ones
        too.  Deleting an unknown or null id does nothing; revising one
        inserts it.  Nulls in source or lang are a group of their own.
        """
        if self._exists(self._path("commits", batch)):
            return False
        signed = []
        for rows in (inserts, revisions):
            if rows is not None:
                signed.append(rows.select("doc_id", "source", "lang", F.lit(version).alias("version"), counter(F.col("text")).cast("long").alias("tokens"), F.lit(1).cast("long").alias("sign")))
        gone = [rows.select("doc_id") for rows in (deletes, revisions) if rows is not None]
        held = self.present(version, gone[0].union(gone[-1]).distinct()) if gone else None
        if held is not None:
            signed.append(held.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens", (-F.col("copies")).alias("sign")))
        if not signed:
            return False
        facts = signed[0]
        for more in signed[1:]:
            facts = facts.unionByName(more)
        facts.write.mode("overwrite").parquet(self._path("facts", batch))
        written = self.spark.read.schema(facts.schema).parquet(self._path("facts", batch))
        sums = written.groupBy(*self.KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(self._path("deltas", batch))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._path("commits", batch))
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; groups without a document are left out."""
        deltas = self._read("deltas")
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long")
        return deltas.groupBy(*self.KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")
