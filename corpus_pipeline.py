"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything
that its predecessor kept; its result is written as Parquet and read again as
the next one's docs.  All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.llm import exact_dedup, jaccard_join, langid, packing, pseudonyms
from cantus.llm.queries import tokenizer_path
from cantus.llm.shared import save, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found and drops documents whose language can't be determined."""
    found = langid.predict(docs, langid.fit(docs)).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest id of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of documents linked by a Jaccard index of 0.75.

    Rows are told apart by id and text, so rows that share an id are judged
    one by one; a row without an id stays only in a group without others.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.lower(F.hex(exact_dedup.digest_of(F.col("text")))).alias("text_sha256"))
    groups = save(jaccard_join.jaccard_components(docs.select(row.alias("doc_id"), "text")), "near-groups")
    return exact_dedup.without(docs, groups.filter("doc_id <> component_id").select("doc_id.doc_id", "doc_id.text_sha256"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by format-preserving pseudonyms."""
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark), count=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: Language models, keyed permutations and tokenisation can't be said in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
