"""Connected components of an edge table by alternating large-star and small-star steps.

All state is in DataFrames staged in the shared folder; no edge or label reaches the driver. Each step joins
edges with the smallest neighbour of a node, so a node with very many neighbours is a skewed join side (which
adaptive execution splits), never one task's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("u", F.least("u", "m").alias("m"))
    out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    hooked = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return hooked.unionByName(own).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge table (u, v); label: the smallest node of its component.

    Self loops and repeated edges are harmless; an empty table gives an empty result. Raises if the edges have
    not become stars after ``most_rounds`` rounds (their number grows with the logarithm of the longest path).
    """
    now = R.stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        after = R.stage(_small_star(_large_star(now)), "edges")
        R.unstage(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
