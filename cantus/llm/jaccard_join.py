"""N-gram Jaccard self-join with a token-group matrix.

Documents are sets of word shingles; equal sets form one class.  The join
looks for all pairs of classes with ``100 * intersection >= percent * union``.

1. Document frequencies of all shingles are counted over all documents, in
   sorted blocks.  The frequent ones go to a filter of a fixed size; the
   order "rare before frequent, then by hash" is the same for everybody.
2. Two sets that link share a shingle among the first
   ``n - ceil(percent * n / 100) + 1`` of each in that order.  Rare shingles
   of those prefixes give candidate pairs; at most ``frequent`` documents
   hold one, so no list is long.  A pair stays if the shared part of both
   prefixes and what may follow them can reach the overlap that it needs.
3. Sets that consist of frequent shingles mostly are members of families of
   similar documents.  The best representative of each family is compared
   with its members first.  Then the token-group matrix: members of each
   family are dealt into groups of at most ``group_size``, and each group
   stores the union of its frequent prefix tokens.  A query's overlap with
   the union bounds its overlap with any member, and only groups that can
   qualify are opened for it.
   Group pairs whose members are all connected already need no look.
4. Every candidate is verified on its whole sets of hashes.

Nothing is capped: lists above ``frequent`` take step 3 instead of step 2.
Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import save, small_batches, trim
from .words import mix, shingle_set, words_of

_U = np.uint64


class Filter:
    """A Bloom filter over 64-bit hashes; its bits are fixed, so it can be shipped."""

    def __init__(self, bits: int = 1 << 26, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            a, b = mix(hashes ^ _U(0xA0761D6478BD642F)), mix(hashes + _U(0xE7037ED1A0B428DB)) | _U(1)
            return [(a + _U(i) * b) % _U(self.bits) for i in range(4)]

    def add(self, hashes: np.ndarray) -> None:
        for p in self._places(hashes):
            np.bitwise_or.at(self.data, p >> _U(3), (1 << (p & _U(7))).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in self._places(hashes):
            found &= (self.data[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1
        return found


def _ship(spark, rows: DataFrame, column: str, bits: int) -> Filter:
    """A filter of the values of ``column``, gathered in pieces whose number depends on ``bits`` only."""
    piece = min(bits, 1 << 20)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(bits)
        for b in batches:
            p = np.unique(np.concatenate(f._places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64))], ["place"])

    spots = rows.select(F.col(column).cast("long")).mapInArrow(places, "place long").distinct()

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        data = np.zeros(piece // 8, np.uint8)
        p = t.column("place").to_numpy() % piece
        np.bitwise_or.at(data, p >> 3, (1 << (p & 7)).astype(np.uint8))
        return pa.table({"part": [key[0].as_py()], "data": [zlib.compress(data.tobytes(), 1)]})

    out = Filter(bits)
    for r in spots.withColumn("part", F.floor(F.col("place") / piece)).groupBy("part").applyInArrow(fold, "part long, data binary").collect():
        out.data[r["part"] * piece // 8 : (r["part"] + 1) * piece // 8] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, words in words_of(t.as_py() for t in batch.column("text")):
        yield i, shingle_set(words, width)


def _class_of(s: np.ndarray) -> int:
    """The class of equal sets: a 64-bit hash that doesn't depend on order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + _U(len(s))], np.uint64)).view(np.int64)[0])


# Step 1: document frequencies ------------------------------------------------

#: Shingles are counted by their upper KEY_BITS bits; a shared key only makes a shingle count as frequent.
KEY_BITS = 40
#: Keys of a block before it is sorted and sent off.
BLOCK_KEYS = 1 << 20


def _frequent(docs: DataFrame, width: int, over: int, parts: int, max_frequent: int, bits: int) -> tuple[Filter, int]:
    """The filter of shingle keys that more than ``over`` documents hold, and the number of shingles.

    The ``max_frequent`` most frequent keys are taken at most, for the
    filter's size; the threshold then rises for everybody.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)  # a key that a third of the block has is sent once
            cuts = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.float64) * ((1 << KEY_BITS) / parts)).astype(np.uint64))
            planes = lambda x, width, kind: x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize)[:, :width].T.tobytes()
            data = [zlib.compress(planes(np.diff(keys[a:b], prepend=_U(0)), 5, "<u8") + planes(n[a:b], 4, "<u4"), 1) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(data, pa.binary())], ["part", "keys"])

        for b in batches:
            for _, s in _sets(b, width):
                held.append(s >> _U(64 - KEY_BITS))
                size += len(s)
                if size >= BLOCK_KEYS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
        held = []
        trim()

    def count(key: tuple, t: pa.Table) -> pa.Table:
        all_keys, all_n = [], []
        for x in t.column("keys").to_pylist():
            planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(9, -1)
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, :5] = planes[:5].T
            all_keys.append(np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64))
            all_n.append(np.ascontiguousarray(planes[5:].T).view("<u4").ravel())
        keys, n = np.concatenate(all_keys), np.concatenate(all_n)
        del all_keys, all_n
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        total = np.add.reduceat(n, first) if len(first) else n
        often = total > over
        keys, found = keys[first[often]].astype(np.int64), total[often]
        trim()
        return pa.table({"key": np.append(keys, -1), "n": np.append(found, n.sum())})

    sent = docs.select("text").mapInArrow(blocks, "part int, keys binary")
    counts = save(sent.groupBy("part").applyInArrow(count, "key long, n long"), "shingle-counts")
    total = counts.filter("key < 0").agg(F.sum("n")).first()[0] or 0
    often = counts.filter("key >= 0")
    by_n = often.groupBy(F.least(F.floor(F.log2("n") * 4), F.lit(200)).alias("level")).count().orderBy(F.desc("level")).collect()
    taken, level = 0, None
    for r in by_n:
        if taken + r["count"] > max_frequent and taken:
            break
        taken, level = taken + r["count"], r["level"]
    chosen = often.filter(F.floor(F.log2("n") * 4) >= F.lit(level if level is not None else 0))
    return _ship(docs.sparkSession, chosen, "key", bits), total


# Step 2: prefixes ------------------------------------------------------------


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The overlap from which two sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


_PREFIX = "kind string, doc_id {id}, cls long, n long, hot long, part int, rare binary, frequent array<long>"


def _prefixes(docs: DataFrame, width: int, percent: int, often: Filter, parts: int) -> DataFrame:
    """Rows of two kinds: ``doc`` (one for each row) and ``rare`` (blocks of prefix shingles by hash range)."""
    shipped = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, names = shipped.value, ["kind", "doc_id", "cls", "n", "hot", "part", "rare", "frequent"]
        held: list[tuple[np.ndarray, int, int, int]] = []
        size = 0

        def rare_blocks(kind: pa.DataType) -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            who = np.repeat(np.arange(len(held), dtype=np.uint64), [len(x[0]) for x in held])
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            table = np.array([x[1:] for x in held], np.int64).reshape(-1, 3)
            cuts = np.searchsorted(h, (np.arange(parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
            cuts = np.append(cuts, len(h))
            data = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                used, local = np.unique(who[a:b], return_inverse=True)
                data.append(np.array([b - a, len(used)], np.int64).tobytes() + h[a:b].tobytes() + local.astype(np.int32).tobytes() + table[used.astype(int)].tobytes())
            k = len(data)
            nulls = pa.nulls
            return pa.RecordBatch.from_arrays(
                [pa.array(["rare"] * k), nulls(k, kind), nulls(k, pa.int64()), nulls(k, pa.int64()), nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(data, pa.binary()), nulls(k, pa.list_(pa.int64()))],
                names,
            )

        kind = None
        for b in batches:
            kind = b.schema.field("doc_id").type
            cls, ns, hots, frequent = [], [], [], []
            for _, s in _sets(b, width):
                n = len(s)
                c = _class_of(s)
                p = prefix_size(n, percent)
                # The prefix: rare shingles in hash order, then frequent ones; look no farther than needed.
                hot = f.holds(s >> _U(64 - KEY_BITS)) if n else np.empty(0, bool)
                rare = s[~hot][:p]
                often_here = s[hot][: p - len(rare)]
                if len(rare):
                    held.append((rare, c, n, len(often_here)))
                    size += len(rare)
                cls.append(c)
                ns.append(n)
                hots.append(len(often_here))
                frequent.append(often_here.view(np.int64))
            k = len(cls)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * k), b.column("doc_id"), pa.array(cls, pa.int64()), pa.array(ns, pa.int64()), pa.array(hots, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(frequent, pa.list_(pa.int64()))],
                names,
            )
            if size >= BLOCK_KEYS:
                yield rare_blocks(kind)
                held, size = [], 0
        if size:
            yield rare_blocks(kind)
        held = []
        trim()

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, _PREFIX.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _rare_pairs(percent: int):
    """Pairs of classes that share rare prefix shingles of one hash range, and how many."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        hashes, cls, ns, hots = [], [], [], []
        for x in t.column("rare").to_pylist():
            k, m = np.frombuffer(x, np.int64, 2)
            at = 16 + 8 * k
            local = np.frombuffer(x, np.int32, k, at)
            docs = np.frombuffer(x, np.int64, 3 * m, at + 4 * k).reshape(-1, 3)[local]
            hashes.append(np.frombuffer(x, np.uint64, k, 16))
            cls.append(docs[:, 0])
            ns.append(docs[:, 1])
            hots.append(docs[:, 2])
        h, c, n, hot = map(np.concatenate, (hashes, cls, ns, hots))
        if not len(h):
            return pa.table({x: np.empty(0, np.int64) for x in ("a", "b", "na", "nb", "hot_a", "hot_b", "shared")})
        order = np.lexsort((c, h))
        h, c, n, hot = h[order], c[order], n[order], hot[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])  # a class counts once
        h, c, n, hot = h[fresh], c[fresh], n[fresh], hot[fresh]
        _, who = np.unique(c, return_inverse=True)  # classes of this range as small numbers
        some = np.empty(who.max() + 1, int)
        some[who] = np.arange(len(c))
        found = []
        step = 1
        while True:  # members of one list lie next to each other
            i = np.flatnonzero(h[step:] == h[:-step])
            if not len(i):
                break
            j = i + step
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            found.append(who[i[fits]] * len(some) + who[j[fits]])
            step += 1
        if found:
            pairs, shared = np.unique(np.concatenate(found), return_counts=True)
            i, j = some[pairs // len(some)], some[pairs % len(some)]
            cols = [c[i], c[j], n[i], n[j], hot[i], hot[j], shared.astype(np.int64)]
        else:
            cols = [np.empty(0, np.int64)] * 7
        trim()
        return pa.table(dict(zip(("a", "b", "na", "nb", "hot_a", "hot_b", "shared"), cols, strict=True)))

    return run


def _enough(percent: int):
    """Whether shared prefix shingles and what may lie behind the prefixes can reach the needed overlap."""
    na, nb = F.col("na"), F.col("nb")
    needed = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent) - F.lit(1e-9))
    behind = lambda n: F.ceil(F.lit(percent) * n / 100 - F.lit(1e-9)) - 1
    return F.col("shared") + F.least("hot_a", "hot_b") + F.greatest(behind(na), behind(nb)) >= needed


# Step 4: verification --------------------------------------------------------


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def _class_sets(docs: DataFrame, reps: DataFrame, width: int, bits: int) -> DataFrame:
    """(cls, tokens): whole shingle sets of the documents whose id is in ``reps`` (doc_id), and of few more."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(_ship(spark, reps.select(F.xxhash64("doc_id").alias("k")), "k", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shipped.value
        for b in batches:
            b = b.filter(pa.array(f.holds(b.column("k").to_numpy().view(np.uint64))))
            cls, tokens = [], []
            for _, s in _sets(b, width):
                cls.append(_class_of(s))
                tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(tokens, pa.binary())], ["cls", "tokens"])

    return docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(run, "cls long, tokens binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok, pa.bool_())), b.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    wide = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


# Step 3: families of similar documents ---------------------------------------


def _open_groups(percent: int):
    """Candidate pairs between the members of two token groups (sides 0 and 1; one group alone has side 0 only).

    A group stores the union of the frequent prefix tokens of its members.
    Pairs that share a smaller token are left to that token's groups.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        token = np.array([key[0].as_py()], np.int64).view(np.uint64)[0]
        side, cls, comp, n = (t.column(c).to_numpy() for c in ("side", "cls", "comp", "n"))
        lists = t.column("frequent").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy().view(np.uint64)
        starts = np.cumsum(size) - size
        store = np.flatnonzero(side == side.max())
        held = np.concatenate([flat[starts[i] : starts[i] + size[i]] for i in store])
        owner = np.repeat(np.arange(len(store)), size[store])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        union, ends = held[first], np.append(first[1:], len(held))  # the matrix: token of the union -> members
        behind = -(-percent * n // 100) - 1  # what a set holds behind its prefix
        a, b = [], []
        for q in np.flatnonzero(side == 0):
            needed = _needed(n[q], n[store], percent) - np.maximum(behind[q], behind[store])
            mine = flat[starts[q] : starts[q] + size[q]]
            at = np.searchsorted(union, mine)
            at[at == len(union)] = 0
            at = at[union[at] == mine]
            if len(at) < needed.min():
                continue  # no member can share enough with the query
            lo, counts = first[at], ends[at] - first[at]
            spots = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            shared = np.bincount(owner[spots], minlength=len(store))
            early = np.bincount(owner[spots], weights=np.repeat(union[at] < token, counts), minlength=len(store))
            open_ = (shared >= needed) & (shared > 0) & (early == 0) & (comp[store] != comp[q])
            open_ &= 100 * np.minimum(n[q], n[store]) >= percent * np.maximum(n[q], n[store])
            a += [cls[q]] * int(open_.sum())
            b += cls[store][open_].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _family_pairs(classes: DataFrame, percent: int, group_size: int) -> DataFrame:
    """Candidate pairs of classes in different components that share a frequent prefix shingle.

    classes: cls, n, comp, frequent.
    """
    members = classes.select("cls", "n", "comp", F.explode("frequent").alias("token"))
    mixed = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    order = Window.partitionBy("token").orderBy("comp", "n", "cls")
    dealt = save(members.join(mixed, "token").withColumn("g", ((F.row_number().over(order) - 1) / group_size).cast("long")), "token-groups")
    groups = dealt.groupBy("token", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = (groups.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("g", "lo", "hi", "least", "most")]) for k in "01")
    apart = F.expr("g0 <= g1 AND NOT (lo0 = hi0 AND lo1 = hi1 AND lo0 = lo1)")
    fits = (F.lit(100) * F.col("most1") >= F.lit(percent) * F.col("least0")) & (F.lit(100) * F.col("most0") >= F.lit(percent) * F.col("least1"))
    pairs = x.join(y, "token").filter(apart & fits).select("token", "g0", "g1")
    sides = [F.struct(F.lit(0).alias("side"), F.col("g0").alias("g")), F.struct(F.lit(1).alias("side"), F.col("g1").alias("g"))]
    both = F.when(F.col("g0") == F.col("g1"), F.array(sides[0])).otherwise(F.array(*sides))
    wanted = pairs.select("token", "g0", "g1", F.explode(both).alias("s")).select("token", "g0", "g1", "s.side", "s.g")
    opened = wanted.join(dealt.select("token", "g", "cls"), ["token", "g"]).join(classes, "cls")
    found = opened.groupBy("token", "g0", "g1").applyInArrow(_open_groups(percent), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# The join --------------------------------------------------------------------


def class_links(docs: DataFrame, width: int = 5, percent: int = 75, frequent: int = 24, group_size: int = 256, bits: int = 1 << 25, max_frequent: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id, cls, n of every row, and (id, root) of all classes with links.

    frequent: more documents than this make a shingle frequent (step 3).
    bits: size of the shipped filters; max_frequent: frequent shingles that go to one.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-size // (1 << 24)))
    often, _ = _frequent(docs, width, frequent, parts, max_frequent, bits)
    found = save(_prefixes(docs, width, percent, often, parts), "prefixes", ["kind"])
    rows = found.filter("kind = 'doc'")
    rare = found.filter("kind = 'rare'").select("part", "rare")
    shared = rare.groupBy("part").applyInArrow(_rare_pairs(percent), "a long, b long, na long, nb long, hot_a long, hot_b long, shared long")
    summed = shared.groupBy("a", "b").agg(F.sum("shared").alias("shared"), *[F.max(c).alias(c) for c in ("na", "nb", "hot_a", "hot_b")])
    pairs = save(summed.filter(_enough(percent)).select("a", "b"), "candidates")

    centre = F.col("hot") / (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100 - F.lit(1e-9)) + 1)
    families = save(rows.filter("hot > 0").select("cls", "n", centre.alias("centre"), "frequent").dropDuplicates(["cls"]), "families")
    member = families.select("cls", "n", "centre", F.explode("frequent").alias("token"))
    best = member.groupBy("token").agg(F.max(F.struct("centre", "cls", "n")).alias("best")).select("token", F.col("best.cls").alias("b"), F.col("best.n").alias("nb"))
    star = member.join(best, "token").filter(F.col("cls") != F.col("b")).filter(F.lit(100) * F.least("n", "nb") >= F.lit(percent) * F.greatest("n", "nb"))
    first = save(pairs.union(star.select(F.least("cls", "b"), F.greatest("cls", "b"))).distinct(), "pairs")
    reps = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))

    def linked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        sets = _class_sets(docs, reps.join(wanted, "cls"), width, bits).join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
        return save(_verify(pairs, save(sets, "sets"), percent), "links")

    links = linked(first)
    roots = components(links)
    placed = families.join(roots.toDF("cls", "root"), "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("comp"), "frequent")
    more = save(_family_pairs(placed, percent, group_size), "pairs")
    if more.limit(1).count():
        roots = components(links.union(linked(more)))
    return rows.select("doc_id", "cls", "n"), roots


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, **more) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text, ...).

    Words are runs of characters other than 0x20 and 0x09-0x0D with A-Z
    lower-cased.  A text with fewer than ``width`` words is one shingle; a
    null text or one without words has none and links with nothing.  Rows
    that repeat, also with one doc_id, are rows of their own.  A row with a
    null id links like others but never names a component of rows with ids.
    An empty table gives an empty result.
    """
    rows, roots = class_links(docs, width, percent, **more)
    linked = rows.join(roots.toDF("cls", "root"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "cls").alias("root"))
    linked = save(linked, "linked")
    some = linked.filter("n_shingles > 0")
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).filter("size > 1").drop("size")
    out = some.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(linked.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
