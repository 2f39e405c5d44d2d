"""Exact top-k inner products by KD-trees per shard.

Vectors are dealt into shards of a bounded size, queries into blocks of a
bounded size, and every block meets every shard once.  A shard builds a
KD-tree: median splits on the widest dimension down to small leaves, each
node with the tight bounding box of its vectors.  The traversal is
best-first: of all open nodes it takes the one whose box allows the most
above the queries' kth score, opens leaves for just the queries that can
still gain, and raises their kth score.  Each block first searches one seed
shard, whose kth scores are propagated to all other shards as the start.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

LEAF = 64
#: Queries that traverse a tree together.
TOGETHER = 128
_LEAST = -(1 << 62)


class Tree:
    """KD-tree over the rows of ``x`` (whole numbers, held as int64)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.lo, self.hi, self.kids, self.rows = x, [], [], [], []
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.lo)
            part = x[rows]
            lo, hi = part.min(axis=0), part.max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([-1, -1])
            if parent is not None:
                self.kids[parent][side] = me
            spread = hi - lo
            if len(rows) <= leaf or not len(spread) or not spread.max():
                self.rows.append(rows)
                continue
            self.rows.append(None)
            half = len(rows) // 2
            order = np.argpartition(part[:, int(np.argmax(spread))], half)
            todo += [(rows[order[:half]], me, 0), (rows[order[half:]], me, 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The greatest inner product that each node's box allows each query."""
        return _dot(np.maximum(q, 0), self.hi) + _dot(np.minimum(q, 0), self.lo)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: by floating point where that is exact, else by integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, rows) of the k best rows of each query; ``ids`` ascend; -1 where fewer reach ``start``.

    Ties go to the smaller id, that is to the smaller row.
    """
    n = len(q)
    best = np.full((n, k), _LEAST, np.int64)
    who = np.full((n, k), -1, np.int64)
    kth = start.copy()
    limit = tree.bounds(q)
    slack = lambda node, rows: int((limit[rows, node] - kth[rows]).max())
    everyone = np.arange(n)
    open_nodes = [(-slack(0, everyone), 0)] if n and len(ids) else []
    while open_nodes:
        _, node = heapq.heappop(open_nodes)
        rows = everyone[limit[:, node] >= kth]
        if not len(rows):
            continue
        if tree.rows[node] is None:
            for kid in tree.kids[node]:
                heapq.heappush(open_nodes, (-slack(kid, rows), kid))
            continue
        leaf = np.sort(tree.rows[node])
        score = np.concatenate([best[rows], _dot(q[rows], tree.x[leaf])], axis=1)
        row = np.concatenate([who[rows], np.broadcast_to(leaf, (len(rows), len(leaf)))], axis=1)
        order = np.lexsort((row, -score), axis=1)[:, :k]
        best[rows] = np.take_along_axis(score, order, axis=1)
        who[rows] = np.take_along_axis(row, order, axis=1)
        kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
    return best, who


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(t), -1) if len(t) else flat.reshape(0, 0)


def _meet(k: int, seed: bool):
    """Searches one shard for one block; the seed search returns kth scores, the other one candidates."""

    def run(key: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
        found = [[], [], []]
        if len(queries) and len(shard):
            shard = shard.sort_by("vec_id")
            ids, x = shard.column("vec_id").to_numpy(), _matrix(shard)
            tree = Tree(x)
            q, qid = _matrix(queries), queries.column("query_id").to_numpy()
            start = queries.column("kth").fill_null(_LEAST).to_numpy()
            near = np.argsort(q[:, int(np.argmax(np.ptp(q, axis=0)))], kind="stable") if q.shape[1] else np.arange(len(q))
            for at in range(0, len(q), TOGETHER):
                part = near[at : at + TOGETHER]
                score, row = search(tree, ids, q[part], start[part], k + 1)  # one more: the query itself may be found
                ok = (row >= 0) & (score >= start[part][:, None])
                ok &= ids[np.maximum(row, 0)] != qid[part][:, None]
                ok &= np.cumsum(ok, axis=1) <= k
                if seed:
                    full = ok.sum(axis=1) == k
                    kth = np.where(ok, score, np.iinfo(np.int64).max).min(axis=1)
                    found[0] += qid[part][full].tolist()
                    found[2] += kth[full].tolist()
                else:
                    i, j = np.nonzero(ok)
                    found[0] += qid[part][i].tolist()
                    found[1] += ids[row[i, j]].tolist()
                    found[2] += score[i, j].tolist()
        if seed:
            return pa.table({"query_id": pa.array(found[0], pa.int64()), "kth": pa.array(found[2], pa.int64())})
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    return run


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows that hold a null or non-finite one are left out.

    A null id is left out.  Of rows with one id the one with the greatest vector stays.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine)
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.max("v").alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """The k greatest integer inner products of each query with all other vectors.

    vectors: vec_id, embedding and any other columns.  Returns query_id,
    rank (from 1), vec_id, score; ties go to the smaller vec_id; a query with
    fewer partners returns all.  Vectors meet vectors of their own length
    only.  An empty table gives an empty result.  Shards and blocks bound the
    memory of a task: both have about as many rows as named, whatever the
    input's size.
    """
    rows = quantised(vectors, scale).withColumn("dim", F.size("v"))
    rows = save(rows, "vectors")
    n, nq = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // block_rows))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("v"), F.col("dim").alias("dim"), spread("vec_id", blocks).alias("block"))
    stored = rows.select("vec_id", "v", "dim", spread("vec_id", shards).alias("shard"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    key = ["dim", "block", "shard"]

    seeds = queries.select("*", F.lit(None).cast("long").alias("kth"), (F.col("block") % shards).alias("shard"))
    homes = stored.filter(F.col("shard") < blocks).withColumn("block", F.explode(F.sequence(F.col("shard"), F.lit(blocks - 1), F.lit(shards))))
    kth = seeds.groupBy(key).cogroup(homes.groupBy(key)).applyInArrow(_meet(k, True), "query_id long, kth long")
    ready = queries.join(kth, "query_id", "left").withColumn("shard", every(shards))
    found = ready.groupBy(key).cogroup(stored.withColumn("block", every(blocks)).groupBy(key)).applyInArrow(_meet(k, False), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

