"""Depths and common ancestors by pointer doubling: rounds grow with the logarithm of a tree's depth, rows with its nodes.

A tree is an edge table (node, parent, brlen, is_leaf) as in distances; one table may hold many trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doubled(tree: DataFrame, most_rounds: int = 40) -> tuple[DataFrame, list[DataFrame]]:
    """((node, root, depth, height), jumps): jumps[k] has (node, above) for the nodes with an ancestor 2**k edges above.

    Each round joins what every node has reached with what that has reached. A node without a row for its parent is an
    error of the table: it is taken as a root.
    """
    known = tree.select(F.col("node").alias("parent"))
    inner = tree.filter("parent is not null").join(known, "parent", "left_semi").select("node", "parent", "brlen")
    start = tree.select("node").join(inner, "node", "left")
    reached = start.select("node", F.coalesce("parent", "node").alias("to"), F.col("parent").isNotNull().cast("int").alias("up"), F.coalesce("brlen", F.lit(0.0)).alias("length")).checkpoint()
    jumps = []
    for k in range(most_rounds):
        jump = reached.filter(F.col("up") == (1 << k)).select("node", F.col("to").alias("above"))
        if jump.isEmpty():
            return reached.select("node", F.col("to").alias("root"), F.col("up").alias("depth"), F.col("length").alias("height")), jumps
        jumps.append(jump)
        further = reached.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("up").alias("more"), F.col("length").alias("added"))
        reached = reached.join(further, "to").select("node", F.col("next").alias("to"), (F.col("up") + F.col("more")).alias("up"), (F.col("length") + F.col("added")).alias("length")).checkpoint()
    raise ValueError(f"a tree deeper than 2**{most_rounds} edges, or a circle")


def common_ancestors(tree: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, lca, n_known, n_unknown) of queries (query, node) with any number of nodes each.

    Nodes that no tree has are counted and passed over; a query without known nodes, or with nodes of several trees, has a
    null lca. Repeated nodes count once. All nodes of a query are lifted to the least depth among them, and then as far as
    they stay apart; their number shrinks as they meet.
    """
    depths, jumps = doubled(tree)
    asked = queries.select("query", "node").distinct()
    placed = asked.join(depths.select("node", "root", "depth"), "node", "left").checkpoint()
    told = placed.groupBy("query").agg(F.count("root").alias("n_known"), F.count_if(F.col("root").isNull()).alias("n_unknown"), F.min("depth").alias("least"), (F.min("root") == F.max("root")).alias("one"))
    at = placed.join(told.filter("one").select("query", "least"), "query").filter("depth is not null").select("query", "node", (F.col("depth") - F.col("least")).alias("left")).checkpoint()
    for k in reversed(range(len(jumps))):
        lifted = at.join(jumps[k], "node", "left").withColumn("go", F.col("left").bitwiseAND(F.lit(1 << k)) > 0)
        at = lifted.select("query", F.when(F.col("go"), F.col("above")).otherwise(F.col("node")).alias("node"), "left").checkpoint()
    at = at.select("query", "node").distinct()
    for k in reversed(range(len(jumps))):
        lifted = at.join(jumps[k], "node", "left")
        # at one depth either all have such an ancestor or none
        apart = lifted.groupBy("query").agg((F.min("above") < F.max("above")).alias("apart"))
        lifted = lifted.join(apart, "query").select("query", F.when(F.col("apart"), F.col("above")).otherwise(F.col("node")).alias("node"))
        at = lifted.distinct().checkpoint()
    ends = at.join(tree.select("node", "parent"), "node").groupBy("query").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min("parent").alias("parent"))
    lca = ends.select("query", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("parent")).alias("lca"))
    return told.select("query", "n_known", "n_unknown").join(lca, "query", "left").select("query", "lca", "n_known", "n_unknown")


def edge_partition(up: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, site, tag): which part of a site's tree the edge above a node belongs to.

    up is the closure (node, ancestor, ...), leaves: node, site, state (null: missing). A leaf is z where it is unmutated,
    '?' where it is missing, else its state. Upwards a node is z if one below it is or two states meet, else the only
    state below it, else '?'. As z goes up to the root, that is said by all leaves below a node at once.
    """
    below = up.select("node", "ancestor").join(leaves.select("node", "site", "state"), "node").groupBy(F.col("ancestor").alias("node"), "site")
    z = (F.min("state") == 0) | (F.min("state") != F.max("state"))
    return below.agg(F.when(F.count("state") == 0, "?").when(z, "z").otherwise(F.min("state").cast("string")).alias("tag"))
