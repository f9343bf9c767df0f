"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, Workspace, hot_join


def _stars(edges: DataFrame, total: int) -> DataFrame:
    """One large-star then small-star round over (u, v) with u > v; every node keeps a path to its component's minimum."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m0"), F.count("*").alias("n")).select("u", F.least("u", "m0").alias("m"), (F.col("n") * HOT_SHARE >= 2 * total).alias("hot"))
    # large star: the neighbours above u point at the least of u and all its neighbours
    large = hot_join(both.filter("v > u"), least, "u", F.col("hot"), ["m"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: u and its neighbours below it point at the least of them
    down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "m", (F.col("n") * HOT_SHARE >= total).alias("hot"))
    moved = hot_join(large, down, "u", F.col("hot"), ["m"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(down.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of ``edges`` (u, v) the least node it is connected with.

    Undirected; loops, repeated and null edges are ignored; an empty table gives an empty one. Rounds are written to
    the shared folder, which cuts the lineage; only a count and a checksum of a round come to the driver.
    """
    now = edges.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = work.table(now, "edges"), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last, seen = now, mark
        now = work.table(_stars(last, mark[0]), "edges")
        work.drop(last)
    raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
