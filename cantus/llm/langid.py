"""Language identification by words first, then shorter and shorter character n-grams.

Known words score by their log frequency in each language.  An unseen word is
covered from left to right by the longest known character n-grams (four
characters, then three, two, one), each scored by its log frequency.

The model is fitted on a bounded sample of labelled rows, chosen by a hash of
the identifier: about ``sample_rows`` of each language, and of all languages
together about ``max_rows``.  Every word of these rows counts, so the model is
bounded by them and ships with the tasks; prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_remainder, small_batches, trim

WORD = regex.compile(r"\p{L}+")
UNDETERMINED = "und"


class Model:
    """Log frequencies of words and n-grams by language: numbers of rows of one table each, so a process holds it lightly."""

    def __init__(self, counts: list[tuple[str, str, int]], docs: dict[str, int], longest: int = 4):
        """counts: (lang, word, n); docs: labelled rows by language, for the prior."""
        self.langs = sorted(docs, key=lambda x: (-docs[x], x))
        at = {x: i for i, x in enumerate(self.langs)}
        self.longest = longest
        tables: list[dict[str, list[int]]] = [{} for _ in range(longest + 1)]  # 0: words; n: n-grams
        none = [0] * len(self.langs)
        for lang, word, n in counts:
            j = at[lang]
            tables[0].setdefault(word, none[:])[j] += n
            for size in range(1, longest + 1):
                for i in range(len(word) - size + 1):
                    tables[size].setdefault(word[i : i + size], none[:])[j] += n
        self.rows = [{w: i for i, w in enumerate(t)} for t in tables]
        self.logs = [self._logs(np.array(list(t.values()), float).reshape(len(t), len(self.langs))) for t in tables]
        rows = sum(docs.values())
        self.prior = np.log(np.array([docs[x] / rows for x in self.langs])) if self.langs else np.empty(0)
        self.cache: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        values = counts + 0.5
        return np.log(values / values.sum(axis=0)).astype(np.float32) if len(counts) else values.astype(np.float32)

    def unseen(self, word: str) -> tuple[float, ...]:
        """Backoff: at each place the longest known n-gram, then on behind it."""
        found = self.cache.get(word)
        if found is None:
            total, i = np.zeros(len(self.langs)), 0
            while i < len(word):
                for size in range(min(self.longest, len(word) - i), 0, -1):
                    if (row := self.rows[size].get(word[i : i + size])) is not None:
                        total += self.logs[size][row]
                        break
                i += size
            if len(self.cache) >= 50_000:
                self.cache.clear()
            found = self.cache[word] = tuple(total)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its posterior probability); ``und`` and 0 without a letter or a model."""
        words = WORD.findall((text or "").lower())
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        rows = list(map(self.rows[0].get, words))
        known = [r for r in rows if r is not None]
        total = self.prior + self.logs[0][known].sum(axis=0, dtype=float)
        if len(known) < len(rows):
            total += np.array([self.unseen(w) for w, r in zip(words, rows, strict=True) if r is None]).sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, sample_rows: int = 1000, max_rows: int = 20_000) -> Model:
    """Learns from the rows with a text, a lang and an id whose crc32 modulo 5 isn't 0.

    sample_rows: about how many rows of each language are used; max_rows: of
    all languages together, with an equal share for each.  All their words
    count, whole texts and rare words included.
    """
    labelled = docs.select("doc_id", "text", "lang").filter((id_remainder("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not rows:
        return Model([], {})
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample_rows = min(sample_rows, max_rows / len(rows))
    below = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, int((1 << 30) * min(1.0, sample_rows / n)))])
    taken = share < F.try_element_at(below, F.col("lang"))
    words = labelled.filter(taken).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    found = zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)
    return Model(sorted(found, key=lambda x: (-x[2], x[0], x[1])), rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score added in front of clashes (a clash is replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )
        trim()

    return docs.select(keep).mapInArrow(run, schema)


def identify(docs: DataFrame, sample_rows: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang, ...).

    A text that is null or has no letter is ``und`` with score 0; so is every
    text if no labelled row exists.  A row with a null id is predicted but
    never learned from, and its held_out is false.  Ties go to the language
    with more labelled rows, then by name.  Repeated rows give repeated rows.
    """
    model = fit(docs, sample_rows)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
