"""Language-model scoring with a probabilistic suffix tree over words.

States of the tree are contexts of up to ``depth`` words.  A context is a
candidate if it occurs often enough in the training documents, and it is
retained if its next-symbol distribution diverges from that of its parent:
the training text must be coded shorter with it than without it, where each
occurrence is coded by all others (leave-one-out), so chance repeats don't
count.  Distributions are smoothed towards the longest retained suffix and at
the root towards the smoothed word frequencies, so they sum to one.  A token
is scored by the state of the longest retained suffix of what precedes it.

Nothing of the model is broadcast: it grows with the corpus.  Documents are
gathered in blocks.  A block asks for the counts that it needs with its own
training counts in the same message: sorted distinct keys in ranges of the
hash.  Each range adds up what all blocks sent and answers every block in its
own order.  Frequent contexts are spread over the ranges by the hash of
context and symbol together, and their divergences are sums over blocks, so
no context meets in one task.  Depth d takes two such rounds: counts, then
divergences (sent together with the counts of depth d + 1).
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_remainder, release, save, small_batches
from .words import mix, words_of

_U = np.uint64
END = mix(np.array([0x6C62272E07BB0142], np.uint64))
START = mix(np.array([0x62B821756295C58D], np.uint64))
#: Tokens of a block, about.
BLOCK_TOKENS = 1 << 20
#: Key bits that are kept; two keys that agree on them are counted as one.
KEY_BITS = 56


@dataclass(frozen=True)
class Settings:
    """depth: words of the longest context; least: training occurrences of a candidate context;
    strength: weight of the parent's distribution in counts; divergence: nats an occurrence must gain on average;
    gain: nats that all occurrences together must gain."""

    depth: int = 2
    least: int = 8
    strength: float = 4.0
    divergence: float = 0.01
    gain: float = 3.0


def _key(kind: int, x: np.ndarray) -> np.ndarray:
    """Keys of one kind; the lowest bit tells words (1) from all other keys (0)."""
    with np.errstate(over="ignore"):
        k = mix(x + _U((kind + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(64 - KEY_BITS)
    return (k | _U(1)) if kind == 0 else (k & ~_U(1))


def _blocks(docs: DataFrame, mod: int) -> DataFrame:
    """(block, ids, train, sizes, codes, words): tokens of about BLOCK_TOKENS words as numbers of the block's own words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "ids", "train", "sizes", "codes", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial, kind = TaskContext.get().partitionId() << 32, 0, None
        ids, train, sizes, tokens, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            codes, words = pd.factorize(np.concatenate(tokens))
            planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            cols = [[base + serial], [ids], [train], [sizes], [zstandard.ZstdCompressor(level=1).compress(planes.tobytes())], [words.tobytes()]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            kind = b.schema.field("doc_id").type
            known = zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), strict=True)
            for (i, tr), (_, w) in zip(known, words_of(t.as_py() for t in b.column("text")), strict=True):
                ids.append(i)
                train.append(tr)
                sizes.append(len(w) + 1)
                tokens += [w, END]
                size += len(w) + 1
                if size >= BLOCK_TOKENS:
                    yield out()
                    serial += 1
                    ids, train, sizes, tokens, size = [], [], [], [], 0
        if ids:
            yield out()

    rows = docs.select("doc_id", "text", F.coalesce(id_remainder("doc_id", mod) != 0, F.lit(False)).alias("train"))
    return rows.mapInArrow(run, f"block long, ids array<{id_type}>, train array<boolean>, sizes array<long>, codes binary, words binary")


class _Block:
    """Tokens of a block."""

    def __init__(self, row: dict):
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], int)
        n = int(self.sizes.sum())
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.uint8).reshape(4, n)
        self.codes = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.train = np.repeat(np.array(row["train"], bool), self.sizes)
        self.first = np.zeros(n, bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True

    def before(self, x: np.ndarray, at_start) -> np.ndarray:
        """What ``x`` has one token earlier in the same text."""
        out = np.roll(x, 1)
        out[self.first] = at_start
        return out


@dataclass
class _Asked:
    """Distinct keys of one kind, which positions they stand for, and what they bring."""

    at: np.ndarray  # positions
    code: np.ndarray  # the key of each position
    keys: np.ndarray
    values: np.ndarray

    def spread(self, totals: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        out[self.at] = totals[self.code]
        return out


def _ask(at: np.ndarray, group: np.ndarray, key_of, values: np.ndarray) -> _Asked:
    """Positions ``at`` by equal ``group``; key_of(positions) hashes one position of each group."""
    code, _ = pd.factorize(group)
    fresh = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0) if len(code) else np.empty(0, int)
    return _Asked(at, code, key_of(at[fresh]), np.bincount(code, weights=values, minlength=len(fresh)))


def _play(b: _Block, s: Settings, total_docs: int, n: float, v: float) -> Generator[tuple[np.ndarray, np.ndarray], np.ndarray, dict]:
    """Yields (keys, values) of each round and is sent the totals of these keys; returns the scores."""
    size, everyone, train = len(b.codes), np.arange(len(b.codes)), b.train.astype(np.float64)
    hashes = b.words[b.codes]
    wide = len(b.words) + 1

    def entries(d: int, at: np.ndarray, group: np.ndarray, context: np.ndarray) -> _Asked:
        with np.errstate(over="ignore"):
            return _ask(at, group[at] * wide + b.codes[at], lambda x: _key(2 * d, context[x] * _U(0xD6E8FEB86659FD93) + hashes[x]), train[at])

    group = b.before(b.codes, len(b.words))  # the context of d words as a number of this block, and as a hash
    last = b.before(hashes, START[0])
    context = mix(last)
    words = _Asked(everyone, b.codes, _key(0, b.words), np.bincount(b.codes, weights=train, minlength=len(b.words)))
    entry = entries(1, everyone, group, context)
    totals = yield np.concatenate([words.keys, entry.keys]), np.concatenate([words.values, entry.values])
    count = words.spread(totals, size)
    c = entry.spread(totals[len(words.keys) :], size)
    parent = base = (count + 0.1) / (n + 0.1 * (v + 1))
    seen = b.before(count, float(total_docs))  # occurrences of the context
    usable = seen >= s.least
    for d in range(1, s.depth + 1):
        model = (c + s.strength * parent) / (seen + s.strength)
        others = (np.maximum(c - 1, 0) + s.strength * parent) / (np.maximum(seen - 1, 0) + s.strength)
        at = np.flatnonzero(usable)
        gain = np.where(b.train[at], np.log(others[at] / parent[at]), 0.0)
        state = _ask(at, group[at], lambda x, d=d, context=context: _key(2 * d + 1, context[x]), gain)
        sent = [state]
        if d < s.depth:  # entries of contexts that are one word longer
            longer = b.before(usable & (c >= s.least), False)
            numbers = np.full(size, -1)
            numbers[entry.at] = entry.code
            group = b.before(numbers, -1)
            last = b.before(last, START[0])
            with np.errstate(over="ignore"):
                context = mix(context * _U(0x9FB21C651E98DF25) + last)
            entry = entries(d + 1, np.flatnonzero(longer), group, context)
            sent.append(entry)
        totals = yield np.concatenate([x.keys for x in sent]), np.concatenate([x.values for x in sent])
        gained = state.spread(totals, size)
        kept = usable & (gained >= s.gain) & (gained >= s.divergence * seen)
        parent = np.where(kept, model, parent)
        if d < s.depth:
            seen, usable = b.before(c, 0.0), longer
            c = entry.spread(totals[len(state.keys) :], size)
    starts = np.cumsum(b.sizes) - b.sizes
    add = np.add.reduceat
    return {"n_tokens": b.sizes, "n_known": add((count > 0).astype(np.int64), starts), "base_score": add(np.log10(base), starts), "score": add(np.log10(parent), starts)}


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _kind(round_: int) -> str:
    """Word counts are answered as doubles; later rounds' counts and divergences as single floats."""
    return "<f4" if round_ else "<f8"


def _planes(x: np.ndarray, kind: str) -> bytes:
    width = int(kind[-1])
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes()


def _from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(int(kind[-1]), -1).T).view(kind).ravel()


def _pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences and their values, byte planes compressed."""
    return np.int64(len(keys)).tobytes() + _squeeze(_planes(np.diff(keys, prepend=_U(0)), "<u8") + _planes(values, "<f4"))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    raw = np.frombuffer(_spread(data[8:]), np.uint8)
    return np.cumsum(_from_planes(raw[: 8 * n], "<u8"), dtype=np.uint64), _from_planes(raw[8 * n :], "<f4").astype(np.float64)


_ANSWER = "block long, round int, part int, n long, data binary, words long, total double"


def _add_up(round_: int):
    """One range of keys: totals over all blocks, answered to each block in the order of its own keys."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        blocks = t.column("block").to_pylist()
        sent = [_unpack(x) for x in t.column("data").to_pylist()]
        keys = np.concatenate([k for k, _ in sent])
        order = np.argsort(keys, kind="stable")
        group = np.cumsum(np.concatenate([[False], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.empty(0, int)
        place = np.empty(len(keys), int)
        place[order] = group
        total = np.bincount(place, weights=np.concatenate([v for _, v in sent])) if len(keys) else np.empty(0)
        first = np.zeros(len(total), np.uint64)
        first[place] = keys
        words = (first & _U(1)).astype(bool) & (total > 0)
        ends = np.cumsum([0, *[len(k) for k, _ in sent]])
        data = [_squeeze(_planes(total[place[a:b]], _kind(round_))) for a, b in zip(ends, ends[1:], strict=False)]
        k = len(blocks)
        return pa.table(
            {
                "block": pa.array([*blocks, -1], pa.int64()), "round": pa.array([round_] * (k + 1), pa.int32()), "part": pa.array([key[0].as_py()] * (k + 1), pa.int32()),
                "n": pa.array([*np.diff(ends).tolist(), 0], pa.int64()), "data": pa.array([*data, None], pa.binary()), "words": pa.array([0] * k + [int(words.sum())], pa.int64()), "total": pa.array([0.0] * k + [float(total[words].sum())], pa.float64()),
            }
        )

    return run


def _round(s: Settings, rounds: int, parts: int, total_docs: int, n: float, v: float):
    """A block's next messages, or its scores after the last round."""

    def messages(block: int, keys: np.ndarray, values: np.ndarray) -> pa.Table:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        cuts = np.append(np.searchsorted(keys, (np.arange(parts, dtype=np.float64) * (2.0**KEY_BITS / parts)).astype(np.uint64)), len(keys))
        data = [_pack(keys[a:z], values[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"block": pa.array([block] * parts, pa.int64()), "part": pa.array(range(parts), pa.int32()), "data": pa.array(data, pa.binary())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from messages(row["block"], *next(_play(_Block(row), s, total_docs, n, v))).to_batches()

    def later(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        b = _Block(row)
        game = _play(b, s, total_docs, n, v)
        sent = next(game)
        for r in range(rounds):
            mine = answers.filter(pc.equal(answers.column("round"), r)).sort_by("part")
            came = [_from_planes(np.frombuffer(_spread(x), np.uint8), _kind(r)) for x in mine.column("data").to_pylist()]
            totals = np.empty(len(sent[0]))
            totals[np.argsort(sent[0], kind="stable")] = np.concatenate(came)
            try:
                sent = game.send(totals)
            except StopIteration as end:
                return pa.table({"doc_id": pa.array(b.ids, block.schema.field("ids").type.value_type), **{k: pa.array(x) for k, x in end.value.items()}})
        return messages(row["block"], *sent)

    return later if rounds else first


def score(docs: DataFrame, settings: Settings = Settings(), mod: int = 10) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Learns from the rows whose crc32 of the id modulo ``mod`` isn't 0.  Words
    are runs of characters other than 0x20 and 0x09-0x0D with A-Z
    lower-cased, and every text ends with one end token; a null text is
    empty.  A row with a null id is scored but not learned from, and its
    held_out is false.  Repeated rows count and are scored one by one.  An
    empty table gives an empty result.
    """
    s = settings
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, -(-size // (1 << 24)))
    blocks = save(_blocks(docs, mod), "text-blocks")
    total_docs = blocks.agg(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0
    message = "block long, part int, data binary"
    answers, n, v = None, 0.0, 0.0
    for r in range(s.depth + 1):
        step = _round(s, r, parts, total_docs, n, v)
        if r == 0:
            sent = blocks.mapInArrow(step, message)
        else:
            sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(step, message)
        new = save(sent.groupBy("part").applyInArrow(_add_up(r), _ANSWER), "answers")
        if r == 0:
            row = new.filter("block < 0").agg(F.sum("words"), F.sum("total")).first()
            v, n = float(row[0] or 0), float(row[1] or 0)
        new = new.filter("block >= 0").select("block", "round", "part", "data")
        answers = new if answers is None else answers.union(new)
    del sent, new
    release(docs.sparkSession)
    schema = f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_round(s, s.depth + 1, parts, total_docs, n, v), schema)
    held_out: Column = F.coalesce(id_remainder("doc_id", mod) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
