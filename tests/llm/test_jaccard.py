"""The Jaccard join against all pairs by brute force."""

import re

import numpy as np
import pytest

from cantus.llm.components import components
from cantus.llm.jaccard_join import Filter, _frequent, jaccard_components
from cantus.llm.words import block_words, words_of


def sets(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=75):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in comp[find(i)] if x is not None]
        out.append((d, len(s[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n=260):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: list(rng.choice(vocab, k))
    passage, rows = text(40), []
    for i in range(n):
        kind = rng.integers(6)
        if kind == 0 and rows:  # a near copy
            w = (rows[rng.integers(len(rows))][1] or "").split()
            for _ in range(rng.integers(0, 4)):
                if w:
                    w[rng.integers(len(w))] = "edit%d" % rng.integers(1000)
            rows.append((i, " ".join(w)))
        elif kind == 1:  # a member of one family
            w = list(passage)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = "e%d" % rng.integers(50)
            rows.append((i, "\n".join(w)))
        elif kind == 2:  # shares the passage only
            rows.append((i, " ".join(text(int(rng.integers(5, 90))) + passage)))
        else:
            rows.append((i, " ".join(text(int(rng.integers(0, 60))))))
    return rows


@pytest.mark.parametrize("seed,frequent,group", [(1, 24, 256), (2, 4, 8), (3, 1, 3)])
def test_equals_brute_force(spark, seed, frequent, group):
    rows = corpus(seed)
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One Two"), (1004, "one\x0btwo"), (1005, "x " * 60000), (1006, "X " * 50000), (5, "one two"), (None, rows[9][1] + " tail"), (None, "alone here")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, cls string").repartition(5)
    got = [tuple(r) for r in jaccard_components(df, frequent=frequent, group_size=group, bits=1 << 18).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_words_of_long_and_short_texts():
    texts = ["A b", None, "", "word " * 500_000, "x" * 3_000_000 + " y", " a\tB "]
    got = dict(words_of(texts))
    assert [len(got[i]) for i in range(6)] == [2, 0, 0, 500_000, 2, 2]
    assert (got[0] == got[5]).all() and len(np.unique(got[3])) == 1
    assert len(np.unique(block_words(" ".join(map(str, range(100000))).encode())[0])) == 100000


def test_filter():
    f, x = Filter(1 << 16), np.random.default_rng(0).integers(0, 1 << 63, 2000).astype(np.uint64)
    f.add(x[:1000])
    assert f.holds(x[:1000]).all() and f.holds(x[1000:]).mean() < 0.05


def test_ranges_without_a_key(spark):
    """Blocks that hold no key of some hash ranges: few short texts, and more ranges than shingles."""
    rows = [(1, "one two three"), (2, "a b c d e f"), (3, "A b c d e f"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_components(df).collect()), key=str) == brute(rows)
    often, n = _frequent(df, 5, 1, 400, 1 << 22, 1 << 18)
    held = set.union(*(sets(t) for _, t in rows))
    assert n == sum(len(sets(t)) for _, t in rows) and len(held) == 3 and often.data.any()
