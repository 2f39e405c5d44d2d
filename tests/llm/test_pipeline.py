"""The pipeline against the composition of brute-force stages."""

import zlib

import corpus_pipeline
from cantus.llm import langid
from cantus.llm.packing import WordTokenizer
from cantus.llm.pseudonyms import Pseudonymiser
from cantus.llm.queries import tokenizer_path

from .test_first_ops import lower
from .test_jaccard import brute, corpus


def documents(spark):
    rows = [(i, t, ("en", "de")[i % 2], "src%d" % (i % 3), len(t or "")) for i, t in corpus(5, 150)]
    rows += [(500, rows[3][1].upper(), "en", "src0", 1), (501, None, "en", None, None), (502, "12 34 !!", None, "s", 8), (503, "mail a.b@c.org or +1 (269) 555-3296 now", "en", "s", 39)]
    rows += [rows[7], (None, "words without an id at all", None, None, None), (rows[9][0], "another text of an id that is there already " * 3, "en", "s", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline(spark, tmp_path):
    rows, df = documents(spark)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t, *_ in rows if langid.WORD.search(t or "")]
    best = {}
    for i, t in kept:
        k = lower(t)
        if k not in best or (-1 if i is None else i) >= (-1 if best[k][0] is None else best[k][0]):
            best[k] = (i, t)
    near = brute(list(best.values()))
    stay = {d for d, _, c in near if d == c}
    spark.conf.set("spark.cantus.pii.key", "a key of the test")
    p, tok = Pseudonymiser(b"a key of the test"), WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    twice = rows[-1][0]
    want = {i: tok.whole(p.replace(t)[0]) + b"\1\0\0\0" for i, t in best.values() if i in stay and i != twice}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert any(r["doc_id"] == twice for r in got)
    got = [r for r in got if r["doc_id"] != twice]
    assert {r["doc_id"] for r in got} == set(want)
    for i, ids in want.items():
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) // 4
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    assert any("a.b@c.org" in t for _, t, *_ in rows if t) and not stage.filter("text LIKE '%a.b@c.org%'").count()


def test_empty(spark):
    _, df = documents(spark)
    docs = df.limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, "")
    assert docs.count() == 0
