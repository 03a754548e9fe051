"""Trees made from trees: scaled, with short edges collapsed, with polytomies resolved, and subsampled.

A tree is an edge table (node, parent, brlen, is_leaf) as in distances; one table may hold many trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.operators.ancestry import doubled
from cladewright.operators.distances import pruned
from cladewright.operators.ordering import numbered

COLUMNS = ("node", "parent", "brlen", "is_leaf")


def scale_factors(tree: DataFrame) -> DataFrame:
    """(root, height): the greatest length from a root, its own edge not counted, down to a node."""
    return doubled(tree)[0].groupBy("root").agg(F.max("height").alias("height"))


def scaled(tree: DataFrame, height: float = 1.0) -> DataFrame:
    """(node, parent, brlen, is_leaf, rate): each tree with all lengths divided so that it has the given height.

    rate is what lengths were divided by, which is the rate of mutation where the height is a time. A tree without any
    length has a null rate and keeps its lengths.
    """
    places = doubled(tree)[0]
    rates = places.groupBy("root").agg(F.nullif(F.max("height") / height, F.lit(0.0)).alias("rate"))
    told = tree.join(places.select("node", "root"), "node").join(rates, "root")
    return told.select("node", "parent", F.coalesce(F.col("brlen") / F.col("rate"), F.col("brlen")).alias("brlen"), "is_leaf", "rate")


def collapsed(tree: DataFrame, least: float, most_rounds: int = 40) -> DataFrame:
    """The tree without its inner nodes on edges of at most this length: their children hang on the nearest node that stays.

    Children keep their lengths; a null length counts as 0. Leaves and roots stay, whatever their lengths. Rounds grow with
    the logarithm of the longest chain of nodes that go.
    """
    goes = ~F.col("is_leaf") & F.col("parent").isNotNull() & (F.coalesce("brlen", F.lit(0.0)) <= least)
    gone = tree.filter(goes).select("node", F.col("parent").alias("to")).checkpoint()
    # each node that goes points upwards until it points to one that stays
    for _ in range(most_rounds):
        further = gone.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        if gone.join(further, "to", "left_semi").isEmpty():
            break
        gone = gone.join(further, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")).checkpoint()
    else:
        raise ValueError(f"a chain of more than 2**{most_rounds} short edges, or a circle")
    kept = tree.filter(~goes).select(*COLUMNS)
    return kept.join(gone.select(F.col("node").alias("parent"), "to"), "parent", "left").select("node", F.coalesce("to", "parent").alias("parent"), "brlen", "is_leaf")


def resolved(tree: DataFrame, length: float = 0.0) -> DataFrame:
    """(node, parent, brlen, is_leaf, mark): nodes of more than two children parted into pairs by new nodes.

    Of the children in the order of their numbers the first stays; the second and all behind it go below a new node, and so
    on. New nodes have the given length and a true mark; the one right above child c has the number c and the span of all
    numbers. Children of one node are numbered in ranges, so a node may have any number of them.
    """
    span = tree.agg((F.max("node") - F.min("node") + 1).alias("span"))
    child = numbered(tree.filter("parent is not null").select("node", "parent"), ["parent"], ["node"], "r").checkpoint()
    many = child.groupBy("parent").agg(F.max("r").alias("k")).filter("k > 2")
    # the node above each of the second to the last but one is new; it hangs on the new one before it
    sides = child.join(many, "parent").crossJoin(F.broadcast(span))
    before = sides.filter("r < k").select("parent", (F.col("r") + 1).alias("r"), F.when(F.col("r") > 1, F.col("node") + F.col("span")).otherwise(F.col("parent")).alias("above"))
    placed = sides.join(before, ["parent", "r"]).checkpoint()
    new = placed.filter("r < k").select((F.col("node") + F.col("span")).alias("node"), F.col("above").alias("parent"), F.lit(length).alias("brlen"), F.lit(False).alias("is_leaf"), F.lit(True).alias("mark"))
    hung = placed.select("node", F.when(F.col("r") < F.col("k"), F.col("node") + F.col("span")).otherwise(F.col("above")).alias("under"))
    old = tree.select(*COLUMNS).join(hung, "node", "left")
    return old.select("node", F.coalesce("under", "parent").alias("parent"), "brlen", "is_leaf", F.lit(False).alias("mark")).unionByName(new)


def sampled_leaves(tree: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(root, node): n leaves of each tree, or all if it has fewer, any set of n with equal chance.

    They are those of least md5('seed:node'), so that a run again draws the same.
    """
    leaves = tree.filter("is_leaf").select("node").join(doubled(tree)[0].select("node", "root"), "node")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string")))
    return numbered(leaves.withColumn("draw", drawn), ["root"], ["draw", "node"], "r").filter(F.col("r") <= n).select("root", "node")


def subsampled(tree: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Each tree over sampled_leaves(): nodes with one child left are bridged, as pruned() does it."""
    return pruned(tree, sampled_leaves(tree, n, seed).select("node"))
