"""SentencePiece encoding and decoding as a relational lattice.

A normalised text is cut into words wherever no piece holds the two characters
around a place, so that no piece crosses a cut.  Distinct words only are
encoded: their substrings of bounded length are exploded, equi-joined to the
piece table (which is bounded by the model and broadcast), grouped by word as
the edges of its lattice, and folded by Spark's higher-order ``aggregate``.

The fold follows the model's type.  For unigram models it is Viterbi: the best
score and its last edge for each place from left to right.  For BPE models the
best path of scores is not what the model defines, so the fold applies merges
over the lattice: of all edges that join two neighbouring pieces the one with
the best score, the leftmost of equals, until none is left.  Characters
without a piece become byte pieces.

Texts are kept in blocks as numbers of the block's distinct words, so words
meet documents again by one equi-join of (block, number, word) with the
encoded words, whose answers are packed by block within each task: they grow
with the blocks' distinct words, and a block gets nothing from a task that has
none of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_table, release, save, small_batches, trim

SPACE = "▁"
#: Words with more characters are merged by a heap in Arrow batches: a fold is quadratic in a word's length, and places have 8 bits.
LONG = 240
#: Bytes of a block's texts, about.
BLOCK_BYTES = 24 << 20
#: The rank of two neighbours without an edge; all ranks are below.
NO_EDGE = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Pieces:
    """The piece table of a model file.

    rank: dense ranks of scores, 0 for the best; ids: by piece text, normal pieces only; bytes_: ids of the byte pieces.
    """

    texts: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    unigram: bool = False
    prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Pieces:
        out = cls()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                out.texts.append(p[1].decode())
                out.scores.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
                out.kinds.append(p.get(3, 1))
            elif number == 2:
                out.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                n = dict(_fields(value))
                out.prefix = bool(n.get(3, 1))
                if n.get(4, 1) or n.get(2):
                    raise ValueError("only models with the identity normaliser that keep white space are known")
        return out.ready()

    def ready(self) -> Pieces:
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in (1, 4)}
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {t: order[self.scores[i]] for t, i in self.ids.items()}
        self.bytes_ = [next((i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == 6 and t == f"<0x{b:02X}>"), 0) for b in range(256)]
        self.longest = max(map(len, self.ids), default=1)
        inner = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.pairs = np.unique(np.array([ord(a) << 21 | ord(b) for a, b in inner] or [-1], np.int64))
        ascii_ = np.arange(128)
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = self.far_apart(*np.meshgrid(ascii_, ascii_, indexing="ij"))
        self.apart = self.apart.ravel()
        if len(self.ids) >= NO_EDGE:
            raise ValueError(f"more than {NO_EDGE - 1} pieces")
        return self

    def far_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no piece holds the characters left and right (code points) side by side."""
        both = np.where(left == 0x20, ord(SPACE), left) << 21 | np.where(right == 0x20, ord(SPACE), right)
        at = np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)
        return self.pairs[at] != both

    def one(self, word: str) -> list[int]:
        """Ids of a word by a heap of merges, or by Viterbi for a unigram model; for words beyond LONG."""
        if self.unigram:
            return self._viterbi(word)
        import heapq

        n = len(word)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := self.rank.get(word[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prv[i] >= 0 and (r := self.rank.get(word[prv[i] : stop])) is not None:
                heapq.heappush(heap, (r, prv[i], stop))
        return [x for i in range(n) if alive[i] for x in self._emit(word[i : end[i]])]

    def _emit(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes_[b] for b in piece.encode()]

    def _viterbi(self, word: str) -> list[int]:
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - self.longest), j):
                got = self.ids.get(word[i:j])
                score = self.scores[got] if got is not None else UNKNOWN if j == i + 1 else -np.inf
                if best[i][0] + score > best[j][0]:
                    best[j] = (best[i][0] + score, i)
        out, j = [], len(word)
        while j:
            out.append(word[best[j][1] : j])
            j = best[j][1]
        return [x for p in reversed(out) for x in self._emit(p)]

    def frame(self, spark) -> DataFrame:
        rows = [(t, i, self.rank[t], self.scores[i]) for t, i in self.ids.items()]
        return spark.createDataFrame(rows, "piece string, id int, rank int, score double")


#: Score of a character that no piece holds, in unigram models.
UNKNOWN = -100.0


def encode_words(words: DataFrame, pieces: Pieces, tasks: int = 16) -> DataFrame:
    """(word, ids) for distinct words, by the lattice, in ``tasks`` tasks so that no task's edges spill."""
    spark = words.sparkSession
    short = words.filter(F.length("word") <= LONG)
    # Dealt by word once: exploding and the broadcast join keep that, so grouping needs no shuffle.
    starts = short.filter("word <> ''").repartition(tasks, "word").select("word", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("i"))
    spans = starts.select("word", "i", F.explode(F.expr(f"sequence(1, least({pieces.longest}, length(word) - i))")).alias("n"))
    lattice = spans.select("word", F.expr("i * 256 + i + n").alias("span"), "n", F.expr("substring(word, i + 1, n)").alias("piece"))
    # A character without a piece keeps its row, so that its word has a group.
    found = lattice.join(F.broadcast(pieces.frame(spark)), "piece", "left").filter("id IS NOT NULL OR n = 1")
    if pieces.unigram:
        edge = F.when(F.col("id").isNotNull(), F.struct("span", F.struct("id", "score").alias("e")))
        grouped = found.groupBy("word").agg(F.collect_list(edge).alias("e")).select("word", F.length("word").alias("n"), F.map_from_entries("e").alias("edges"))
        cuts, chosen = _viterbi_fold(), "e.id"
    else:  # an edge is one number: its span, the rank and the id
        edge = F.expr("shiftleft(cast(span AS bigint), 44) + shiftleft(cast(rank AS bigint), 24) + id")
        grouped = found.groupBy("word").agg(F.collect_list(edge).alias("e"))
        grouped = grouped.select("word", F.length("word").alias("n"), F.expr("map_from_arrays(transform(e, x -> cast(shiftright(x, 44) AS int)), e)").alias("edges"))
        cuts, chosen = _merge_fold(), "cast(e & 16777215 AS int)"
    table = f"array({', '.join(map(str, pieces.bytes_))})"
    hexed = "hex(encode(substring(word, cuts[q] + 1, cuts[q + 1] - cuts[q]), 'UTF-8'))"
    raw = f"transform(array({hexed}), h -> transform(sequence(1, length(h) div 2), k -> {table}[cast(conv(substring(h, 2 * k - 1, 2), 16, 10) AS int)]))[0]"
    ids = f"flatten(transform(sequence(0, size(cuts) - 2), q -> transform(array(try_element_at(edges, cuts[q] * 256 + cuts[q + 1])), e -> if(e IS NULL, {raw}, array({chosen})))[0]))"
    folded = grouped.withColumn("cuts", F.expr(cuts)).select("word", F.expr(ids).alias("ids"))

    def merge_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.one(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return folded.unionByName(words.filter(F.length("word") > LONG).select("word").mapInArrow(merge_long, "word string, ids array<int>"))


def _merge_fold() -> str:
    """Cut places after all merges: each step joins the two neighbours with the best edge over them.

    The state has one number for each two neighbours, from left to right: the
    rank of the edge over both (NO_EDGE without one), then where the first
    begins, where they meet and where the second ends.  So the least number is
    the best edge, the leftmost of equals, and a step looks up the ranks of
    the two pairs beside it only.
    """
    rank = lambda i, j: f"coalesce(shiftright(try_element_at(edges, cast(({i}) * 256 + ({j}) AS int)), 24) & {NO_EDGE - 1}, {NO_EDGE})"
    pair = lambda i, m, j: f"(shiftleft({rank(i, j)}, 24) + ({i}) * 65536 + ({m}) * 256 + ({j}))"
    first, meet, last = (lambda x, k=k: f"(shiftright({x}, {k}) & 255)" for k in (16, 8, 0))
    begin = f"if(n < 2, cast(array() AS array<bigint>), transform(sequence(0L, cast(greatest(n - 2, 0) AS bigint)), q -> {pair('q', 'q + 1', 'q + 2')}))"
    beside = f"CASE WHEN {last('x')} = {meet('m')} THEN {pair(first('x'), meet('x'), last('m'))} WHEN {first('x')} = {meet('m')} THEN {pair(first('m'), meet('x'), last('x'))} ELSE x END"
    merged = f"transform(filter(s, x -> x <> m), x -> {beside})"
    step = f"transform(array(array_min(s)), m -> if(m IS NULL OR m >= {NO_EDGE << 24}, s, {merged}))[0]"
    return f"aggregate(sequence(1, greatest(n - 1, 1)), {begin}, (s, k) -> {step}, s -> concat(array(0), transform(s, x -> cast({meet('x')} AS int)), array(n)))"


def _viterbi_fold() -> str:
    """Cut places of the best path: (score, last cut) for each place, then back from the end."""
    came = (
        "array_max(filter(transform(sequence(greatest(0, j - 256), j - 1), i -> struct(best[i].score + coalesce(try_element_at(edges, i * 256 + j).score, "
        f"if(j - i = 1, {UNKNOWN}D, NULL)) AS score, -i AS at)), x -> x.score IS NOT NULL))"
    )
    best = f"aggregate(sequence(1, n), array(struct(0.0D AS score, 0 AS at)), (best, j) -> concat(best, array({came})))"
    back = "aggregate(sequence(1, n), array(n), (c, k) -> if(c[0] = 0, c, concat(array(-best[c[0]].at), c)))"
    return f"transform(array({best}), best -> {back})[0]"


def _units(texts: pa.StringArray, pieces: Pieces) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of all texts, one after the other, and how many each text has.

    A word ends wherever no piece holds the two characters around a place, so
    the words of a text lie side by side in its bytes; nulls have none.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if pieces.prefix:
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    cut = np.empty(size, bool)
    cut[0] = True
    cut[1:] = pieces.apart[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
    odd = np.flatnonzero((raw[1:] & 0xC0 != 0x80) & ((raw[1:] >= 0x80) | (raw[:-1] >= 0x80))) + 1
    if len(odd):  # places beside a character of several bytes
        cut[odd] = pieces.far_apart(_code_points(raw, _char_before(raw, odd)), _code_points(raw, odd))
    cut[ends[ends < size]] = True  # where the next text begins
    places = np.flatnonzero(cut).astype(np.int32)
    counts = np.diff(np.searchsorted(places, np.append(0, ends)))
    places = np.append(places, np.int32(size))
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)]), counts


def _char_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the character before each place begins."""
    before = at - 1
    for _ in range(3):
        before = np.where(raw[before] & 0xC0 == 0x80, before - 1, before)
    return before


def _code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that begin at the given places."""
    lead = raw[at].astype(np.int64)
    more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(more > 0, lead & (0x3F >> more), lead)
    for k in range(1, 4):
        nth = raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64)
        point = np.where(more >= k, point << 6 | nth & 0x3F, point)
    return point


#: Numbers below are one byte; others are this byte and, apart, three more.
_ESCAPE = 240


def _squeeze(codes: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent, compressed."""
    big = codes >= _ESCAPE
    rest = (codes[big] - _ESCAPE).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    raw = np.int64(len(codes)).tobytes() + np.where(big, _ESCAPE, codes).astype(np.uint8).tobytes() + rest.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _spread(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    codes = raw[8 : 8 + n].astype("<u4")
    rest = raw[8 + n :].reshape(3, -1).astype("<u4")
    codes[codes == _ESCAPE] = rest[0] + (rest[1] << 8) + (rest[2] << 16) + _ESCAPE
    return codes


def _blocks(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Two rows for about BLOCK_BYTES of texts: kind ``codes`` (block, ids, sizes, codes), the texts as numbers of the
    block's distinct words of which the commonest has 0, and kind ``words`` (block, words)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "kind", "ids", "sizes", "codes", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial = TaskContext.get().partitionId() << 32, 0
        ids, sizes, units, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            encoded = pa.chunked_array(units, pa.binary()).combine_chunks().dictionary_encode()
            if isinstance(encoded, pa.ChunkedArray):
                encoded = encoded.combine_chunks()
            first = encoded.indices.to_numpy()
            order = np.argsort(-np.bincount(first, minlength=len(encoded.dictionary)), kind="stable")
            number = np.empty(len(order), "<u4")
            number[order] = np.arange(len(order), dtype="<u4")
            words = pc.replace_substring(encoded.dictionary.take(pa.array(order)).cast(pa.string()), " ", SPACE)
            one = lambda x, spots: pa.ListArray.from_arrays(pa.array([*spots, len(x)], pa.int32()), x)  # noqa: E731  # at the row of its kind; none in the other
            return pa.RecordBatch.from_arrays(
                [pa.array([base + serial] * 2), pa.array(["codes", "words"]), pa.concat_arrays([one(pa.concat_arrays(ids), [0]), one(ids[0][:0], [0])]), pa.concat_arrays([one(pa.array(np.concatenate(sizes)), [0]), one(pa.array([], pa.int64()), [0])]), pa.array([_squeeze(number[first]), None], pa.binary()), one(words, [0, 0])],
                names,
            )

        for b in batches:
            found, counts = _units(b.column("text"), pieces)
            ids.append(b.column("doc_id"))
            sizes.append(counts)
            units.append(found)
            size += b.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield out()
                serial += 1
                ids, sizes, units, size = [], [], [], 0
        if ids:
            yield out()
        ids, sizes, units = [], [], []
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, kind string, ids array<{id_type}>, sizes array<long>, codes binary, words array<string>")


def _planes(*columns: np.ndarray) -> bytes:
    """Compressed byte planes of numbers below 2^32."""
    flat = np.concatenate(columns).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T))


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, k, ids) as messages (block, n, data), one for each block among some 2^18 rows: the k, the numbers of ids, the ids."""
    held, rows = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("block", "ascending"), ("k", "ascending")]))
        block, k, lists = t.column("block").to_numpy(), t.column("k").to_numpy(), t.column("ids").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block))
        data = [_planes(k[a:b], np.diff(ends[a : b + 1]), flat[ends[a] : ends[b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(np.diff(cuts).astype(np.int32)), pa.array(data, pa.binary())], ["block", "n", "data"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 1 << 18:
            yield from out()
            held, rows = [], 0
    if rows:
        yield from out()
    held = []
    trim()


def _assemble(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
    """The ids of a block's texts from the ids of its words."""
    codes = _spread(block.column("codes")[0].as_py())
    parts = [(n, _from_planes(d)) for n, d in zip(answers.column("n").to_pylist(), answers.column("data").to_pylist(), strict=True)]
    joined = [np.concatenate([np.empty(0, "<u4"), *x]) for x in ([p[:n] for n, p in parts], [p[n : 2 * n] for n, p in parts], [p[2 * n :] for n, p in parts])]
    by_message = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, joined[1])), pa.int32()), pa.array(joined[2].view("<i4")))
    by_word = by_message.take(pa.array(np.argsort(joined[0])))
    found = by_word.take(pa.array(codes)) if len(codes) else by_word.slice(0, 0)
    ends = np.cumsum(np.concatenate([[0], block.column("sizes")[0].values.to_numpy()]))
    offsets = pa.array(found.offsets.to_numpy()[ends] if len(codes) else ends, pa.int32())
    out = pa.table({"doc_id": block.column("ids")[0].values, "ids": pa.ListArray.from_arrays(offsets, found.values)})
    trim()
    return out


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text, ...), ids as the model's own encoder gives them.

    A null or empty text has no ids.  Repeated rows and null ids are rows
    like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = save(_blocks(docs, pieces), "word-blocks", ["kind"])
    asked = blocks.filter("kind = 'words'").select("block", F.posexplode("words").alias("k", "word"))
    encoded = save(encode_words(asked.select("word").distinct(), pieces, max(12, size >> 22)), "encoded-words")
    answers = save(asked.join(encoded, "word").select("block", "k", "ids").mapInArrow(_pack, "block long, n int, data binary"), "word-answers")
    drop_table(encoded)
    drop_table(blocks, "kind=words")
    release(spark)
    texts = blocks.filter("kind = 'codes'").select("block", "ids", "sizes", "codes")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces, column: str = "ids") -> DataFrame:
    """Adds ``decoded``: pieces joined, byte pieces as UTF-8, meta spaces as spaces, the dummy prefix dropped.

    Null ids give null, no ids the empty text.  Control pieces give nothing.
    """
    raw = [bytes([pieces.bytes_.index(i)]) if k == 6 else b"" if k == 3 else t.replace(SPACE, " ").encode() for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True))]
    lead = pieces.prefix
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def texts(ids: pa.ListArray, table: pa.BinaryArray) -> pa.Array:
        flat = table.take(ids.flatten())
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        offsets = ends[np.cumsum(np.concatenate([[0], sizes]))].astype(np.int32)
        data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
        joined = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), data or pa.py_buffer(b"")])
        if lead:
            joined = pc.if_else(pc.starts_with(joined, " "), pc.binary_replace_slice(joined, 0, 1, b""), joined)
        try:
            out = joined.cast(pa.string())
        except pa.ArrowInvalid:  # ids that no encoder gave
            out = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(raw, pa.binary())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, texts(b.column(column), table)], schema.names)

    return encoded.mapInArrow(run, schema)
