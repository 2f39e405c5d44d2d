"""Hierarchical multi-length packing of token ids.

Documents are tokenised and packed in the task that reads them, so no token
is shuffled.  Each document gives whole windows of the longest tier, and its
rest is routed to the shortest tier that holds it.  Tiers are packed from
long to short: the longest rest opens a window, whole shorter rests fill its
gap best fit first, and the last gap is filled by cutting a rest.  What is
left in the end of a task is closed as one window, so padding is less than
one window for each task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Context sizes; the last is the longest window.
TIERS = (256, 512, 1024, 2048)
#: Rests that a task holds before it packs them; bounds memory to about POOL * 1024 ids.
POOL = 4096
#: Documents that are tokenised together.
TOGETHER = 128
#: Word cache of a tokeniser process.
CACHE = 1_000_000

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids (little-endian 32 bit), tokens of the document


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file that never joins across white space.

    White-space separated words are looked up in a cache that stops growing
    at CACHE words; the words that it lacks are encoded together as one text
    and cut where a token ends a pre-token.  Texts that hold a special token's string are encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text.  The words that the cache lacks are learnt for all texts at once."""
        get = self.cache.get
        found: list[list[bytes]] = []
        holes: list[tuple[list, int, bytes]] = []
        for t in texts:
            if t and any(s in t for s in self.special):
                found.append([self.whole(t)])
                continue
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            ids = list(map(get, words))
            found.append(ids)
            if None in ids:
                i, n = ids.index(None), ids.count(None)
                for k in range(n):
                    holes.append((ids, i, words[i]))
                    if k < n - 1:
                        i = ids.index(None, i + 1)
        learnt = self._learn({w for _, _, w in holes})
        for ids, i, w in holes:
            ids[i] = learnt[w]
        if len(self.cache) < CACHE:
            self.cache.update(learnt)
        return [b"".join(x) for x in found]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words.  A word of letters, with full stops and commas behind it or not, is its letters' ids and theirs."""
        out: dict[bytes, bytes] = {}
        tailed: list[tuple[bytes, bytes, bytes]] = []
        fresh: dict[bytes, bytes | None] = {}
        for w in words:
            core = w.rstrip(b".,")
            if not (core.isalpha() or core and not core.isascii() and self._letters(core)):
                out[w] = self.whole(w.decode("utf-8", "surrogatepass"))
                continue
            known = self.cache.get(core)
            if known is None:
                fresh[core] = None
            else:
                out[core] = known
            if len(core) < len(w):
                tailed.append((w, core, w[len(core) :]))
        cores = list(fresh)
        for i in range(0, len(cores), 4000):
            part = cores[i : i + 4000]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a word that isn't one pre-token: ask for each alone
                out.update((w, self.whole(w.decode())) for w in part)
                continue
            data, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * stops).tolist(), strict=True):
                out[w] = data[at:end]
                at = end
        for w, core, tail in tailed:
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail.decode())
            out[w] = out[core] + self.tails[tail]
        return out

    @staticmethod
    def _letters(core: bytes) -> bool:
        s = core.decode("utf-8", "surrogatepass")
        return s.isalpha() and s == s.lower()


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process, so that tasks share its word cache."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class Packer:
    """Packs the pieces of one task; ``emit`` gets (window number, tier, pieces with offsets)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.window = tiers, tiers[-1]
        self.pools: list[list[tuple[int, int, Piece]]] = [[] for _ in tiers]  # (length, serial, piece), sorted
        self.serial = self.count = 0

    def _route(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        if n:
            self.serial += 1
            insort(self.pools[next(i for i, t in enumerate(self.tiers) if n <= t)], (n, self.serial, piece), key=lambda x: x[:2])

    def add(self, doc_id: object, ids: bytes) -> Iterator[tuple[int, list[Piece]]]:
        total, at, step = len(ids) // 4, 0, self.window
        while total - at >= step:
            yield step, [(doc_id, at, ids[4 * at : 4 * (at + step)], total)]
            at += step
        self._route((doc_id, at, ids[4 * at :], total))
        self.count += 1

    def held(self) -> int:
        return sum(map(len, self.pools))

    def _largest(self, most: int) -> Piece | None:
        """The largest rest of at most ``most`` tokens, from the longest tier that has one."""
        for i in range(len(self.pools) - 1, -1, -1):
            if (at := bisect_right(self.pools[i], most, key=lambda x: x[0])) > 0:
                return self.pools[i].pop(at - 1)[2]
        return None

    def _cut(self, size: int) -> Piece | None:
        """The first ``size`` tokens of the shortest rest that is longer; its own rest is routed again."""
        for pool in self.pools:
            if pool and pool[-1][0] > size:
                doc_id, start, ids, total = pool.pop(bisect_right(pool, size, key=lambda x: x[0]))[2]
                self._route((doc_id, start + size, ids[4 * size :], total))
                return doc_id, start, ids[: 4 * size], total
        return None

    def pack(self, final: bool) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows of every tier, long tiers first; with ``final`` also what is left, as one window."""
        for tier in reversed(range(len(self.tiers))):
            size = self.tiers[tier]
            while self.pools[tier] and sum(x[0] for x in self._some(size)) >= size:
                pieces, room = [], size
                while room:
                    piece = self._largest(room) or self._cut(room)
                    pieces.append(piece)
                    room -= len(piece[2]) // 4
                yield size, pieces
        if final and self.held():
            rest = [x[2] for pool in reversed(self.pools) for x in pool]
            self.pools = [[] for _ in self.tiers]
            yield self.window, rest

    def _some(self, enough: int) -> Iterator[tuple[int, int, Piece]]:
        got = 0
        for pool in self.pools:
            for x in pool:
                if got >= enough:
                    return
                got += x[0]
                yield x


class StepGroups:
    """Deals sequences to ``lanes`` open step groups at a time, each tier's to the group that has the least of that tier.

    So the groups of one round have about as many tokens, and as many of each
    tier: they differ by less than the sum of all tiers.  A round ends when
    every group of it has ``tokens``, or with the task.
    """

    def __init__(self, tokens: int, lanes: int = 4):
        self.tokens, self.lanes, self.first = tokens, lanes, 0
        self._open()

    def _open(self) -> None:
        self.load = [0] * self.lanes
        self.by_tier: dict[int, list[int]] = {}

    def place(self, tier: int, n: int) -> int:
        mine = self.by_tier.setdefault(tier, [0] * self.lanes)
        at = min(range(self.lanes), key=lambda g: (mine[g], self.load[g], g))
        mine[at] += n
        self.load[at] += n
        group = self.first + at
        if min(self.load) >= self.tokens:
            self.first += self.lanes
            self._open()
        return group


SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, with_ids: bool = False, group_tokens: int = 1 << 19) -> DataFrame:
    """Pieces of packed sequences, one row per piece.

    docs: doc_id, text and any other columns, which are ignored.  A document
    is its ids and then ``end_id``; a null text is empty and so gives one id.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier, step_group and, with ``with_ids``, ids (little-endian
    unsigned 32 bit).  Step groups have about ``group_tokens`` tokens, and groups
    that are filled at the same time are balanced, in all and in each tier.
    Repeated rows are packed once each; an empty table gives no piece.

    The sequence number is the number of the task's input partition in the
    upper bits and a serial number in the lower 36; a task that is run again
    after a lost executor gives the same numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        tok, packer = tokenizer(tokenizer_path), Packer(tiers)
        tail = np.array([end_id], "<u4").tobytes()
        cols: list[list] = [[] for _ in range(10)]
        serial, groups = 0, StepGroups(group_tokens)
        kind = None

        def put(windows: Iterator[tuple[int, list[Piece]]]) -> None:
            nonlocal serial
            for tier, pieces in windows:
                offset, group = 0, base + groups.place(tier, sum(len(x[2]) // 4 for x in pieces))
                for doc_id, start, ids, total in pieces:
                    n = len(ids) // 4
                    for c, v in zip(cols, (doc_id, start, n, zlib.crc32(ids), total, base + serial, offset, tier, group, ids if with_ids else None), strict=True):
                        c.append(v)
                    offset += n
                serial += 1

        def batch() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            for c in cols:
                c.clear()
            return out

        for b in batches:
            kind = b.schema.field("doc_id").type
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tok.many(part.column("text").to_pylist()), strict=True):
                    put(packer.add(doc_id, ids + tail))
                if packer.held() >= POOL:
                    put(packer.pack(False))
                if len(cols[0]) >= 5000:
                    yield batch()
        put(packer.pack(True))
        if cols[0]:
            yield batch()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(run, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))
    return out if with_ids else out.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, tier, step_group, tokens and padding (none at a power of two)."""
    out = pieces.groupBy("sequence_id", "tier", "step_group").agg(F.sum("length").alias("tokens"))
    n = F.col("tokens")
    return out.withColumn("padding", F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(TIERS[-1]) - n))

