"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and one equi-join over edges; a node with
very many neighbours is pre-aggregated before its shuffle, and adaptive
execution splits its side of the join.  Each round is written to the shared
folder, so lost executors repeat a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, each once."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    return _oriented(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return _oriented(moved.union(least))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any integers -> (id, root): the least reachable id of every id that has an edge."""
    edges = save(_oriented(edges.toDF("u", "v")), "edges")
    state = _state(edges)
    while state[0]:
        edges = save(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.toDF("id", "root").union(roots)
