"""Connected components of an edge table, with joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for all ends of edges (a long, b long); root is the least node of the component.

    Alternating large-star and small-star rounds: each round connects neighbours to the least node that one of them
    knows, so the number of rounds grows with the logarithm of the longest path. Minima are aggregated before they are
    shuffled and joins have one row per node on one side, so a node with very many neighbours can be split. Rounds end
    when an edge checksum stays; only that number reaches the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    checksum = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())
    current = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = checksum(current)
    for _ in range(most_rounds):
        if not before[0]:
            break
        near = both(current)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: neighbours above a node point to the least that the node knows
        large = near.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: the node and its lower neighbours point to the least of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        current = saved(small.unionByName(lowest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        after = checksum(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # when rounds change nothing, every node points straight at the least of its component
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
