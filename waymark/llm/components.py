"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a group-by minimum and a join; no neighbourhood is ever gathered into one row or task. The
number of rounds grows with the logarithm of the number of nodes; each round is a table in the
shared folder, so lineage stays short and a lost executor repeats one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(moved.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, staged: Staged, name: str, rounds: int = 60) -> DataFrame:
    """(node, part) for every node of ``edges`` (a, b): part is the smallest node reachable."""
    now = staged.put(edges.select("a", "b"), f"{name}-0")
    last = None
    for i in range(1, rounds + 1):
        now = staged.put(_small_star(_large_star(now)), f"{name}-{i}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        staged.drop(f"{name}-{i - 1}")
        if mark == last or not mark[0]:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("part")).union(now.select(F.col("a").alias("node"), F.col("a").alias("part")).distinct())
