"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard_join, kd_topk, langid, lattice, packing, pseudonyms, secrets, suffix_tree
from .shared import new_path, table
from .token_rollup import Rollup, count_with, count_words

TOKENIZERS = None  #: folder of the public tokenizers; None: where the installed package keeps them


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def _rollup(spark: SparkSession, sf_dir: str, counters: dict) -> DataFrame:
    """Batches over all documents under each tokenizer version: a load, a deletion, a revision, and two of them once more.

    Documents whose id is 3 modulo 10 are deleted.  Those with 5 are revised:
    their text is doubled and their language becomes ``xx``; those with 13
    modulo 20 are revised after their deletion, that is put in again.  The
    repeated batches change nothing.
    """
    docs = table(spark, sf_dir, "documents")
    gone = docs.filter(F.pmod("doc_id", F.lit(10)) == 3)
    doubled = docs.filter(F.pmod("doc_id", F.lit(10)) == 5).withColumns({"text": F.concat_ws(" ", "text", "text"), "lang": F.lit("xx")})
    back = docs.filter(F.pmod("doc_id", F.lit(20)) == 13).select(doubled.columns)
    store = Rollup(spark, new_path(spark, "token-rollup"))
    for version, counter in counters.items():
        load = {"version": version, "inserts": docs, "counter": counter}
        revise = {"version": version, "revisions": doubled.unionByName(back), "counter": counter}
        store.apply(f"load-{version}", **load)
        store.apply(f"take-{version}", version, deletes=gone)
        store.apply(f"revise-{version}", **revise)
        store.apply(f"load-{version}", **load)
        store.apply(f"revise-{version}", **revise)
    return store.totals()


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, {"words-1": count_words, "word_bpe_49k-1": count_with(tokenizer_path("word_bpe_49k.json"))})


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup with the tokenizer that SQL can express."""
    return _rollup(spark, sf_dir, {"words-1": count_words})


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonyms.session_key(spark))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the text again."""
    docs, pieces = table(spark, sf_dir, "documents").select("doc_id", "text"), lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    found = lattice.decode(lattice.encode(docs, pieces), pieces)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.length("decoded").cast("long").alias("decoded_chars"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_NORM}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * c >= 75 * (a.n + b.n - c)
), r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

WORD_ROLLUP_SQL = r"""
WITH n AS (SELECT doc_id, source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS tokens FROM documents),
now AS (SELECT source, CASE WHEN doc_id % 10 = 5 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 10 = 5 THEN 2 * tokens ELSE tokens END AS tokens FROM n WHERE doc_id % 10 <> 3 OR doc_id % 20 = 13)
SELECT source, lang, 'words-1' AS version, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM now GROUP BY source, lang
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_kd_topk": op1_kd_topk,
        "op2_token_rollup": op2_token_rollup,
        "word_rollup": word_rollup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_secret_scan": op4_secret_scan,
        "op5_suffix_tree": op5_suffix_tree,
        "op6_pack": op6_pack,
        "op7_pseudonyms": op7_pseudonyms,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_language": op9_language,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    """SQL by query; the pipeline's stages 1, 4 and 5 can't be said in SQL, so it has none."""
    return {"op1_kd_topk": OP1_SQL, "word_rollup": WORD_ROLLUP_SQL, "op3_jaccard_join": OP3_SQL, "op8_exact_dedup": OP8_SQL}
