"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.session import cut, forget


def _with_least(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """(u, v, m): the rows with the least node among u and its neighbours in ``sides``."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return rows.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))  # the greater neighbours alone are moved
    return _with_least(up, both).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, down).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))  # a union would have the join twice in the plan
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); ``root`` is the least node of its component. Edges from a
    node to itself, or with a null end, are no links, and a node that has no other ones is not among the rows; repeated
    edges count once; no edges give no rows.

    Both halves of a round are written to the shared folder, so a lost executor costs at most one of them. No neighbourhood is ever
    collected: a hub is a key of a minimum and of an equi-join, which Spark can split."""
    edges = cut(edges.where("u <> v").distinct())
    known = None
    for _ in range(rounds):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == known or not state[0]:
            break
        known, before = state, edges
        wide = cut(_large(edges))  # apart, each plan is a third of the one of both
        edges = cut(_small(wide))
        forget(before)
        forget(wide)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
