"""Exact dedup, language identification and packing against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantus.llm import exact_dedup, langid, packing
from cantus.llm.queries import tokenizer_path

DOCS = [
    (1, "Same Text", "en", "clash"), (2, "same text", "en", "clash"), (3, "Same  text", "en", None), (4, None, None, None), (5, "", "de", "x"),
    (5, "", "de", "x"), (6, "ÄB", "de", "x"), (7, "äb", "de", "x"), (8, "long " * 30000, "en", "x"), (None, "lonely", None, None), (9, "same TEXT", "fr", "y"),
]
SCHEMA = "doc_id long, text string, lang string, keep_id string"


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, keep):
    rows = exact_dedup.exact_groups(docs, keep).collect()
    groups = {}
    for i, t, *_ in DOCS:
        groups.setdefault(lower(t), []).append(i)
    assert len(rows) == len(DOCS)
    for r in rows:
        text = next(lower(t) for i, t, *_ in DOCS if i == r["doc_id"])
        ids = [i for i in groups[text] if i is not None]
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["group_size"] == len(groups[text])
        assert r["keep_id"] == ((max if keep == "largest" else min)(ids) if ids else None)
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)


def test_exact_groups_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_holds_every_digest(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "unhex(sha2(cast(id AS string), 256)) AS digest")
    some = rows.filter("doc_id % 10 = 0")
    held = exact_dedup.filter_of(some, "digest")
    found = {r["doc_id"] for r in exact_dedup.probe(rows, "digest", held).collect()}
    assert {i for i in range(0, 5000, 10)} <= found and len(found) < 1200
    rest = {r["doc_id"] for r in exact_dedup.probe(rows, "digest", held, held=False).collect()}
    assert rest == set(range(5000)) - found


def test_memtables_are_sorted_and_bounded(docs):
    runs = exact_dedup.flush_runs(docs.coalesce(1), 4).collect()
    by = {}
    for r in runs:
        by.setdefault(r["run"], []).append(bytes(r["digest"]))
    assert sorted(map(len, by.values())) == [3, 4, 4] and all(x == sorted(x) for x in by.values())


def test_levels_merge_and_find_later_copies(spark, docs):
    new = spark.createDataFrame([(20, "SAME text"), (21, "new"), (22, "new"), (23, None), (None, "LONELY"), (24, "äb")], "doc_id long, text string")
    level, later = exact_dedup.build(docs, 4), exact_dedup.build(new, 4)
    entries = lambda x: {bytes(r["digest"]): (r["least_id"], r["most_id"], r["n"]) for r in x.entries.collect()}
    whole = exact_dedup.build(docs.select("doc_id", "text").union(new))
    assert entries(exact_dedup.merge(level, later)) == entries(whole) and len(entries(whole)) == 8
    found = {r["doc_id"]: r["copy_of"] for r in exact_dedup.copies_of(new, docs, level).collect()}
    assert found == {20: 1, 23: 4, None: None, 24: 7}


def test_clashing_names(spark):
    names = ["doc_id", "text", "__bit", "__bucket", "__bits", "__sha", "__nth", "__id", "digest", "salt"]
    df = spark.createDataFrame([(i, ("A", "a", "b")[i % 3], *[f"{n}{i}" for n in names[2:]]) for i in range(9)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    kept = exact_dedup.keep_one(df)
    assert kept.columns == names and {(r["doc_id"], r["__sha"]) for r in kept.collect()} == {(7, "__sha7"), (8, "__sha8")}
    gone = df.filter("doc_id = 8").select("doc_id", F.sha2(F.lit("b"), 256).alias("text_sha256")).union(df.filter("doc_id = 7").select("doc_id", F.lit("another text")))
    assert {r["doc_id"] for r in exact_dedup.without(df, gone).collect()} == set(range(8))


def test_hot_digest_is_dealt_to_several_tasks(spark):
    n = 3 * exact_dedup.SALT_ROWS
    rows = exact_dedup.exact_groups(spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Hot").otherwise("hOT").alias("text")))
    assert [tuple(r) for r in rows.groupBy("keep_id", "group_size").agg(F.count("*"), F.count_if("kept")).collect()] == [(n - 1, n, n, 1)]


def test_keep_one_and_without(docs):
    key = lambda r: (lower(r["text"]), str(r["doc_id"]))
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    best = {}
    for i, t, *_ in DOCS:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    assert sorted(map(key, kept.collect())) == sorted((t, str(None if i < 0 else i)) for t, i in best.items())
    left = exact_dedup.without(docs, docs.filter("doc_id IN (5, 6) OR doc_id IS NULL").select("doc_id"))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4, 7, 8, 9]


def test_language(spark):
    words = {"en": "the river of stone and light", "de": "der fluss aus stein und licht"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation((words[x] + " " + words[x]).split())), x) for i in range(200) for x in [("en", "de")[i % 2]]]
    more = [(1000, None, "en"), (1001, "123 ...", "de"), (1002, "der steinfluss", None), (1003, "THE RIVERS", None), (None, "the light", "de")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows + more, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 205
    assert all(got[i]["lang_pred"] == x for i, _, x in rows)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "de", "en"]
    assert got[1000]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_language_backoff():
    m = langid.Model([("a", "xyz", 5), ("b", "xqq", 5)], {"a": 1, "b": 1})
    assert np.allclose(m.unseen("xyzq"), m.logs[3][m.rows[3]["xyz"]] + m.logs[1][m.rows[1]["q"]])
    assert m.predict("xyzq xyz")[0] == "a"


def test_language_without_labels(spark):
    got = langid.identify(spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


TEXTS = ["Hello, world! it's 12 o'clock", "ÀÉ é straße ΣΑΣ", "", None, "a b c x\x1cy", "é combining İstanbul", "<|endoftext|> special", "w, " * 5000, "the of and. " * 700, "日本語 テキスト", "don't we'll I'm"]


def test_word_tokenizer_equals_library():
    tok = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):
        for t in TEXTS:
            assert tok.ids(t) == tok.whole(t or ""), t


@pytest.mark.parametrize("pool", [packing.POOL, 3])
def test_packing_is_a_partition_of_all_ids(spark, monkeypatch, pool):
    monkeypatch.setattr(packing, "POOL", pool)
    rows = [(i, t) for i, t in enumerate(TEXTS * 9)] + [(3, "again")]
    path = tokenizer_path("word_bpe_49k.json")
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), path, with_ids=True).toPandas()
    tok = packing.WordTokenizer(path)
    whole = {}
    for i, t in rows:
        whole.setdefault(i, []).append(tok.whole(t or "") + b"\x01\0\0\0")
    for i, g in out.groupby("doc_id"):
        if len(whole[i]) == 1:
            g = g.sort_values("start")
            assert b"".join(g["ids"]) == whole[i][0]
            assert (g["start"].values == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
            assert (g["doc_tokens"] == len(whole[i][0]) // 4).all()
    assert out["length"].sum() == sum(len(x) // 4 for v in whole.values() for x in v)
    assert [zlib.crc32(x) for x in out["ids"]] == out["ids_crc32"].tolist()
    padding = 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].values == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
        n = int(g["length"].sum())
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding < 2048 * 4


def test_step_groups_are_balanced():
    rng = np.random.default_rng(1)
    g, load, by_tier = packing.StepGroups(20_000, 4), {}, {}
    for tier in rng.choice(packing.TIERS, 600).tolist():
        k = g.place(tier, tier)
        load[k] = load.get(k, 0) + tier
        by_tier.setdefault(tier, {}).setdefault(k, 0)
        by_tier[tier][k] += tier
    rounds = max(load) // 4 + 1
    assert rounds > 3
    for r in range(rounds):
        now = [load.get(4 * r + i, 0) for i in range(4)]
        assert max(now) - min(now) <= sum(packing.TIERS)
        assert all(max(t.get(4 * r + i, 0) for i in range(4)) - min(t.get(4 * r + i, 0) for i in range(4)) <= tier for tier, t in by_tier.items())
        if r < rounds - 1:
            assert min(now) >= 20_000


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_language_of_few_rows_keeps_its_words(spark):
    rows = [(i, " ".join(f"common{chr(97 + k)}" for k in range(20)), "many") for i in range(200)] + [(1000 + i, "rara avis", "few") for i in range(20)]
    once = [f"only{chr(97 + i)}" for i in range(20)]
    rows += [(2000 + i, w, "few") for i, w in enumerate(once)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=50, max_rows=80)
    assert {"rara", "avis"} <= set(m.rows[0]) and m.predict("rara avis")[0] == "few"
    assert {w for i, w in enumerate(once, 2000) if zlib.crc32(str(i).encode()) % 5} <= set(m.rows[0])  # words that occur once count too


def test_language_held_out_accuracy(spark):
    """Rows that were not learned from, on the given documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    n, right = found.agg(F.count("*"), F.count_if(F.expr("lang = lang_pred"))).first()
    assert n >= 100 and right / n >= 0.97


def test_language_ties_repeats_long_texts_and_clashes(spark):
    rows = [(1, "aa", "x", 1.0, "c"), (2, "bb", "y", 1.0, "c"), (3, "aa bb", None, 1.0, "c"), (3, "aa bb", None, 1.0, "c"), (4, "aa " * 200_000, None, 1.0, "c"), (5, "", None, 1.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.Model([("x", "aa", 1), ("y", "bb", 1)], {"x": 1, "y": 1})
    got = langid.predict(df, model).collect()
    assert len(got) == 6 and sorted(df.columns) == sorted(got[0].asDict())
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))] == ["x", "y", "x", "x", "x", "und"]
