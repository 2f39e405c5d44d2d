"""The suffix tree against a direct evaluation with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cantus.llm import suffix_tree
from cantus.llm.suffix_tree import Settings


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), "</END/>"]


def brute(rows, s, mod=10):
    held = [i is None or zlib.crc32(str(i).encode()) % mod == 0 for i, _ in rows]
    docs = [tokens(t) for _, t in rows]
    train = [d for d, h in zip(docs, held) if not h]
    unigrams = Counter(w for d in train for w in d)
    n, v = sum(unigrams.values()), len(unigrams)
    counts = [defaultdict(Counter) for _ in range(s.depth + 1)]
    for d in train:
        padded = ["<START>", *d]
        for t, w in enumerate(d):
            for k in range(1, s.depth + 1):
                if t + 1 - k >= 0:
                    counts[k][tuple(padded[t + 1 - k : t + 1])][w] += 1
    seen = [{c: sum(x.values()) for c, x in counts[k].items()} for k in range(s.depth + 1)]
    kept = [set() for _ in range(s.depth + 1)]

    def base(w):
        return (unigrams[w] + 0.1) / (n + 0.1 * (v + 1))

    def prob(ctx, w, longest):
        p = base(w)
        for k in range(1, longest + 1):
            c = ctx[-k:]
            if len(c) == k and c in kept[k]:
                p = (counts[k][c][w] + s.strength * p) / (seen[k][c] + s.strength)
        return p

    for k in range(1, s.depth + 1):
        for c, x in counts[k].items():
            if seen[k][c] < s.least or any(seen[j][c[:j]] < s.least for j in range(1, k)):
                continue
            if k > 1 and not usable(c, seen, s):
                continue
            g = sum(m * math.log((m - 1 + s.strength * prob(c, w, k - 1)) / (seen[k][c] - 1 + s.strength) / prob(c, w, k - 1)) for w, m in x.items())
            if g >= s.gain and g >= s.divergence * seen[k][c]:
                kept[k].add(c)
    out = []
    for (i, _), h, d in zip(rows, held, docs):
        padded = ("<START>", *d)
        sc = sum(math.log10(prob(padded[: t + 1], w, s.depth)) for t, w in enumerate(d))
        out.append((i, h and i is not None, len(d), sum(unigrams[w] > 0 for w in d), n, sum(math.log10(base(w)) for w in d), sc))
    return out, kept


def usable(c, seen, s):
    """Every context that this one was grown from was a candidate too."""
    return all(seen[len(c[:j])].get(c[:j], 0) >= s.least for j in range(1, len(c))) and all(seen[1].get(c[j : j + 1], 0) >= s.least for j in range(len(c) - 1))


@pytest.mark.parametrize("depth,blocks", [(1, 1 << 21), (2, 1 << 21), (2, 300), (3, 700)])
def test_equals_brute_force(spark, monkeypatch, depth, blocks):
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", blocks)
    rng = np.random.default_rng(depth)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(150):
        w, text = 0, []
        for _ in range(int(rng.integers(0, 40))):
            w = (w * 3 + int(rng.integers(0, 3))) % 12 if rng.random() < 0.7 else int(rng.integers(12))
            text.append(words[w].upper() if rng.random() < 0.1 else words[w])
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, " \n"), (502, "new " * 50000), (7, "w1 w2 w3"), (None, "w1 w2 w9")]
    s = Settings(depth=depth, least=5, strength=2.0, divergence=0.01, gain=1.0)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train string").repartition(3)
    got = [tuple(r) for r in suffix_tree.score(df, s).collect()]
    want, kept = brute(rows, s)
    assert all(kept[1:3][:depth]), "the test needs retained contexts"
    got.sort(key=lambda r: (str(r[0]), r[2]))
    want.sort(key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-5)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-11)


def test_empty(spark):
    assert suffix_tree.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
