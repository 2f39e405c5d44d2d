"""The lattice against the sentencepiece library, and Viterbi against all segmentations."""

import numpy as np
import pytest
import sentencepiece

from cantus.llm import lattice
from cantus.llm.lattice import Pieces, decode, encode, encode_words
from cantus.llm.queries import tokenizer_path

TEXTS = [
    "hello  world", " a\nb\n\nc", "▁x", "日本語\U0001f600 und mehr", "", None, "  ", "a b ", "The quick, brown fox. It's 12.5% (more) ...", "x" * 300, "ab" * 2000 + "\n" + "=" * 130,
    "word " * 30000, "<s> <0x0A> </s> <unk>", "Zürich straße über façade", "    indented\tcode_name = foo(bar)", "é combining", "0123456789" * 30,
]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(tokenizer_path("piece_bpe_32k.model"))


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_equals_library(spark, monkeypatch, pieces, block):
    monkeypatch.setattr(lattice, "BLOCK_BYTES", block)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = [*enumerate(TEXTS), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    got = [(r["doc_id"], r["ids"], r["decoded"]) for r in decode(encode(df, pieces), pieces).collect()]
    want = [(i, sp.encode(t or ""), t) for i, t in rows]
    key = lambda x: (str(x[0]), len(x[1]))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2], w
        if w[2] is not None and "▁" not in w[2]:
            assert g[2] == w[2]


def test_heap_equals_fold(spark, pieces):
    rng = np.random.default_rng(0)
    words = sorted({"".join(rng.choice(list("abcdeinrst▁.,é日"), rng.integers(1, 12))) for _ in range(300)})
    got = {r["word"]: r["ids"] for r in encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    assert got == {w: pieces.one(w) for w in words}


def test_viterbi(spark):
    texts = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "a", "b", "ab", "ba", "aba", "bb"]
    scores = [0.0] * 257 + [-1.5, -1.7, -2.0, -2.6, -3.1, -3.3]
    p = Pieces(texts, scores, [2] + [6] * 256 + [1] * 6, unigram=True).ready()
    best = {}
    words = ["a", "abab", "bbab", "abba", "babab", "acb", "z", "ab" * 40]

    def score(w):
        if not w:
            return 0.0
        if w not in best:
            best[w] = max(score(w[:-k]) + (scores[p.ids[w[-k:]]] if w[-k:] in p.ids else lattice.UNKNOWN) for k in (1, 2, 3) if k <= len(w) and (k == 1 or w[-k:] in p.ids))
        return best[w]

    for r in encode_words(spark.createDataFrame([(w,) for w in words], "word string"), p).collect():
        found = sum(scores[i] if i > 256 else lattice.UNKNOWN for i in r["ids"])
        assert abs(found - score(r["word"])) < 1e-9 and r["ids"] == p.one(r["word"])


def test_empty(spark, pieces):
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"), pieces), pieces).count() == 0
