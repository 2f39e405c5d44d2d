"""Pseudonyms and the token rollup."""

import re
from collections import Counter
from datetime import date

import pytest

from cantus.llm import pseudonyms as P
from cantus.llm.packing import WordTokenizer
from cantus.llm.queries import tokenizer_path
from cantus.llm.token_rollup import Rollup, count_with

KEY = b"test key"


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 10, 97, 1000):
        out = [P.permute(i, size, KEY, "t") for i in range(size)]
        assert sorted(out) == list(range(size))
    assert [P.permute(i, 1000, KEY, "t") for i in range(9)] != [P.permute(i, 1000, b"other", "t") for i in range(9)]


VALUES = {
    "card": ["4349000490986231", "4111 1111 1111 1111", "4111-1111-1111-1111"], "nanp": ["+1 (269) 555-3296", "+1 269-555-3296"], "ipv4": ["67.190.110.215"],
    "email": ["Some.Body+x9@mail3.example.com"], "iso_date": ["1984-02-29"], "short_date": ["29.02.1984", "2/29/1984"], "long_date": ["29 February 1984", "February 29, 1984", "Feb 29, 1984", "3 Sep 2021"],
    "ssn": ["123-45-6789"], "dashed_date": ["29-02-1984", "2-13-1984"], "ipv6": ["2001:db8::8a2e:370:7334", "fe80:0:0:0:1:2:3:4"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], "phone": ["+49 30 901820"], "local_phone": ["(269) 555-3296"],
}


def test_values_keep_their_format():
    p = P.Pseudonymiser(KEY)
    for kind, values in VALUES.items():
        for v in values:
            if kind == "card" and P.luhn(re.sub(r"\D", "", v)[:-1]) != int(v[-1]):
                continue
            text = f"before {v}, after"
            new, kinds = p.replace(text)
            assert kinds == {kind: 1}, v
            got = new[7:-7]
            assert got != v and v not in new
            if kind not in ("ipv4", "ipv6", "long_date", "short_date", "dashed_date"):
                assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", got)))[:5] == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", v)))[:5] or kind == "iban"
                assert len(got) == len(v)
            assert p.replace(f"x {v} y")[0] == f"x {got} y"  # linked, and still a valid value of its kind
            assert [k for *_, k, _ in p.spans(f"x {got} y")] == [kind], got


def test_equal_values_in_other_formats_stay_linked():
    p = P.Pseudonymiser(KEY)
    digits = {re.sub(r"\D", "", p.replace(v)[0]) for v in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111")}
    assert len(digits) == 1
    days = [P.iso_date("1984-02-29", KEY), P.long_date("29 February 1984", KEY), P.long_date("February 29, 1984", KEY), P.short_date("29.02.1984", KEY)]
    d = date.fromisoformat(days[0])
    assert days[1:] == [f"{d.day} {P.MONTHS[d.month - 1]} {d.year}", f"{P.MONTHS[d.month - 1]} {d.day}, {d.year}", f"{d.day:02d}.{d.month:02d}.{d.year}"]


def test_nothing_is_cut():
    p = P.Pseudonymiser(KEY)
    name = "ab1." * 200 + "x"
    new, kinds = p.replace(f"to {name}@mail.example.com now")
    assert kinds == {"email": 1} and all(new[k : k + 12] != f"to {name}"[k : k + 12] for k in range(3, 780, 40)) and new.endswith(".com now")
    for old in ("1850-01-02", "2101-05-05", "0001-01-01", "9999-12-31", "1499-12-31"):
        got, kinds = p.replace(f"on {old}.")
        assert kinds == {"iso_date": 1} and got[3:-1] != old and date.fromisoformat(got[3:-1])
        assert abs(int(got[3:7]) - int(old[:4])) <= 200
    long = b"k" * 64
    assert [P.permute(i, 10**6, long + b"1", "t") for i in range(5)] != [P.permute(i, 10**6, long + b"2", "t") for i in range(5)]
    assert p.replace("at 12:30:45 and a::b::c")[1] == {}


def test_pseudonyms_need_a_key(spark):
    df = spark.createDataFrame([(1, "x@y.org")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        P.pseudonymise(df, "")
    spark.conf.unset(P.KEY_SETTING)
    first = P.session_key(spark)
    assert len(first) == 64 and P.session_key(spark) == first
    spark.conf.unset(P.KEY_SETTING)
    assert P.session_key(spark) != first


@pytest.mark.parametrize("text", ["", None, "no data here", "version 3.0 of 4.0", "4111111111111112", "1999-02-30", "300.1.1.1", "a" * 200_000 + "@", "1 " * 100_000, "@" * 50_000, "000-12-3456", "42", "x@y", "in 1984 and 2024"])
def test_clean_texts_stay(text):
    assert P.Pseudonymiser(KEY).replace(text) == (text, Counter())


def test_neighbours():
    p = P.Pseudonymiser(KEY)
    card = "411111111111111" + str(P.luhn("411111111111111"))
    text = f"a.b.97@mail2.example.com +1 (345) 555-3341 {card} 10.0.0.1."
    new, kinds = p.replace(text)
    assert kinds == {"email": 1, "nanp": 1, "card": 1, "ipv4": 1}
    assert not any(v in new for v in ("a.b.97", "(345) 555-3341", card, "10.0.0.1"))


def test_frame(spark):
    rows = [(1, "mail x.y@z.org", 14, "k"), (2, None, None, "k"), (2, None, None, "k"), (None, "clean", 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_pii string")
    got = P.pseudonymise(df, KEY).collect()
    assert sorted((r["doc_id"] or 0, r["n_pii"]) for r in got) == [(0, 0), (1, 1), (2, 0), (2, 0)]
    assert P.pseudonymise(df.limit(0), KEY).count() == 0


def test_rollup(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "a", "s", None), (3, None, "t", "de"), (3, "x y", "t", "de"), (None, "q", None, None)], "doc_id long, text string, source string, lang string")
    r = Rollup(spark, f"file://{tmp_path}/store")
    assert r.totals().count() == 0
    get = lambda: {(x["source"], x["lang"], x["version"]): (x["docs"], x["tokens"]) for x in r.totals().collect()}
    assert r.apply("b1", "words-1", inserts=docs)
    first = {("s", "en", "words-1"): (1, 3), ("s", None, "words-1"): (1, 1), ("t", "de", "words-1"): (2, 2), (None, None, "words-1"): (1, 1)}
    assert get() == first
    assert not r.apply("b1", "words-1", inserts=docs)  # replayed
    assert get() == first
    new = spark.createDataFrame([(1, "a b c d e", "s", "fr"), (9, "new", "s", "fr")], docs.schema)
    assert r.apply("b2", "words-1", revisions=new, deletes=docs.filter("doc_id = 3 OR doc_id IS NULL"))
    assert get() == {("s", "fr", "words-1"): (2, 6), ("s", None, "words-1"): (1, 1), (None, None, "words-1"): (1, 1)}
    path = tokenizer_path("word_bpe_49k.json")
    assert r.apply("b3", "bpe", inserts=docs, counter=count_with(path))
    tok = WordTokenizer(path)
    assert get()[("s", "en", "bpe")] == (1, len(tok.whole("a b c")) // 4)
    (tmp_path / "store/facts/b4").mkdir()  # a batch that broke off counts for nothing
    assert r.committed() == ["b1", "b2", "b3"] and len(get()) == 7


def test_registered_rollup_against_brute_force(spark):
    """Deletions that last, revisions of text and language, and batches that come twice."""
    from cantus.llm.queries import op2_token_rollup

    sf, path = "/root/testdata/sf0.001", tokenizer_path("word_bpe_49k.json")
    tok, want = WordTokenizer(path), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r["doc_id"] % 10 == 3 and r["doc_id"] % 20 != 13:
            continue
        revised = r["doc_id"] % 10 == 5
        text = " ".join(x for x in (r["text"], r["text"]) if x is not None) if revised else r["text"] or ""
        for version, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text))), ("word_bpe_49k-1", len(tok.whole(text)) // 4)):
            key = (r["source"], "xx" if revised else r["lang"], version)
            docs, tokens = want.get(key, (0, 0))
            want[key] = (docs + 1, tokens + n)
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in op2_token_rollup(spark, sf).collect()}
    assert got == want


def test_rollup_long_texts_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "w " * 300_000, "s", "en", 7, 8, 9), (1, "w " * 300_000, "s", "en", 7, 8, 9)], "doc_id long, text string, source string, lang string, tokens int, sign int, copies int")
    r = Rollup(spark, f"{tmp_path}/store")
    r.apply("a", "words-1", inserts=df)
    assert [(x["docs"], x["tokens"]) for x in r.totals().collect()] == [(2, 600_000)]
    r.apply("b", "words-1", deletes=df)
    assert r.totals().count() == 0


def test_rollup_empty(spark, tmp_path):
    r = Rollup(spark, f"{tmp_path}/store")
    assert r.apply("b", "words-1", inserts=spark.createDataFrame([], "doc_id long, text string, source string, lang string"))
    assert r.totals().count() == 0
