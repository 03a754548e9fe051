"""The walk round a tree: places at which each node is entered and left, as joins whose number grows with the logarithm of
the number of nodes.

A tree is an edge table (node, parent, brlen, is_leaf) as in distances; one table may hold many trees. The walk is a list of
two elements a node, one where it is entered and one where it is left, and each element knows the next; places are found by
doubling how far each element sees. Elements that see the end rest, so that no key of a join is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.operators.ordering import numbered


def tour(tree: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root, ordinal, enter, leave): enter and leave count up along the walk and end with 0, where a root is left.

    What lies below a node is entered and left between the two. Children are visited in the order of their numbers; ordinal
    is a node's place among its siblings, from 1, null for roots. A node whose parent has no row is a root.
    """
    nodes = tree.select("node").distinct()
    child = tree.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent").distinct()
    child = numbered(child, ["parent"], ["node"], "ordinal").checkpoint()
    first = child.filter("ordinal = 1").select(F.col("parent").alias("node"), F.col("node").alias("first"))
    after = child.select("parent", (F.col("ordinal") - 1).alias("ordinal"), F.col("node").alias("next"))
    opened = nodes.join(first, "node", "left")
    # element 2n enters node n, 2n + 1 leaves it
    enter = opened.select((2 * F.col("node")).alias("at"), F.coalesce(2 * F.col("first"), 2 * F.col("node") + 1).alias("to"))
    onward = nodes.join(child, "node", "left").join(after, ["parent", "ordinal"], "left")
    leave = onward.select((2 * F.col("node") + 1).alias("at"), F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1, 2 * F.col("node") + 1).alias("to"))
    ends = F.col("to") == F.col("at")
    seen = enter.unionByName(leave).select("at", "to", F.when(ends, 0).otherwise(1).cast("long").alias("steps"), ends.alias("done")).checkpoint()
    for _ in range(most_rounds):
        walking = seen.filter(~F.col("done"))
        if walking.isEmpty():
            break
        further = seen.select(F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        moved = walking.join(further, "to").select("at", F.col("beyond").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"))
        seen = seen.filter("done").unionByName(moved).checkpoint()
    else:
        raise ValueError(f"a tree of more than 2**{most_rounds} nodes, or a circle")
    side = F.pmod("at", F.lit(2))
    by_node = seen.groupBy(((F.col("at") - side) / 2).cast("long").alias("node"), ((F.col("to") - 1) / 2).cast("long").alias("root"))
    places = by_node.agg(F.max(F.when(side == 0, -F.col("steps"))).alias("enter"), F.max(F.when(side == 1, -F.col("steps"))).alias("leave"))
    return places.join(child.select("node", "ordinal"), "node", "left").select("node", "root", "ordinal", "enter", "leave")


def subtree_sizes(tree: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(node, root, size): the nodes below each node and itself, from the length of its part of the walk."""
    walk = tour(tree) if walk is None else walk
    return walk.select("node", "root", ((F.col("leave") - F.col("enter") + 1) / 2).cast("long").alias("size"))


def newick(tree: DataFrame, label: str = "node", lengths: bool = True) -> DataFrame:
    """(root, newick): one line of Newick text a tree, children in the order of their numbers.

    label is the column that names a node; a null one is left out, and one with blanks or signs of Newick is put between
    quotes. A null length is left out. A tree's text is one value, as its file is one line.
    """
    name = F.col(label).cast("string")
    odd = name.rlike(r"[\s()\[\]':;,]")
    name = F.when(odd, F.concat(F.lit("'"), F.regexp_replace(name, "'", "''"), F.lit("'"))).otherwise(F.coalesce(name, F.lit("")))
    length = F.coalesce(F.concat(F.lit(":"), F.col("brlen").cast("string")), F.lit("")) if lengths else F.lit("")
    told = tour(tree).join(tree.select("node", name.alias("__name"), length.alias("__length")), "node")
    inner = F.col("leave") - F.col("enter") > 1
    opening = F.concat(F.when(F.col("ordinal") > 1, ",").otherwise(""), F.when(inner, "(").otherwise(""))
    closing = F.concat(F.when(inner, ")").otherwise(""), "__name", "__length")
    tokens = told.select("root", F.explode(F.array(F.struct(F.col("enter").alias("at"), opening.alias("token")), F.struct(F.col("leave").alias("at"), closing.alias("token")))).alias("t"))
    texts = tokens.groupBy("root").agg(F.sort_array(F.collect_list("t")).alias("s"))
    return texts.select("root", F.concat(F.array_join("s.token", ""), F.lit(";")).alias("newick"))


def write_newick(tree: DataFrame, path: str, label: str = "node") -> None:
    """A text file, or several, with one tree a line, in the order of the numbers of their roots."""
    newick(tree, label).sort("root").select("newick").write.mode("overwrite").text(path)
