"""Newick texts as edge tables: tokens, their depth by a running count, and parents by a window over each depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A name between quotes, a sign of structure, or a run of other characters.
TOKEN = r"('(?:[^']|'')*'|[(),;]|:[^(),;\[']*|[^(),;:\[']+)"

#: Numbers of nodes left free for each tree.
STRIDE = 1 << 32


def edges(texts: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(tree, node, parent, label, brlen, is_leaf) of texts (tree: a whole number, newick).

    A node's number is stride times its tree's and the place of its token. Notes between brackets go; names lose their
    quotes; an empty name and a missing or odd length are null. A leaf must have a name or a length. Trees without any node,
    and null texts, have no rows.
    """
    plain = F.regexp_replace("newick", r"\[[^\]]*\]", "")
    raw = texts.select("tree", F.posexplode(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(1))).alias("at", "token"))
    raw = raw.withColumn("token", F.regexp_replace("token", r"^\s+|\s+$", "")).filter("token <> ''")
    along = Window.partitionBy("tree").orderBy("at")
    told = raw.withColumns({"up": F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0), "before": F.lag("token").over(along), "after": F.lead("token").over(along), "later": F.lead("token", 2).over(along)})
    told = told.withColumn("depth", F.sum("up").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    sign = lambda c: F.col(c).isin("(", ")", ",", ";")
    name = lambda c: F.col(c).isNotNull() & ~sign(c) & ~F.startswith(c, F.lit(":"))
    closing = F.col("token") == ")"
    # a leaf begins where a name or a length follows an opening, a comma or nothing
    leaf = ~sign("token") & (F.col("before").isNull() | F.col("before").isin("(", ",", ";"))
    label = F.when(closing & name("after"), F.col("after")).when(~closing & name("token"), F.col("token"))
    colon = lambda c: F.when(F.startswith(c, F.lit(":")), F.substring(c, 2, 1 << 20))
    length = F.when(closing, F.coalesce(colon("after"), F.when(name("after"), colon("later")))).otherwise(F.coalesce(colon("token"), colon("after")))
    nodes = told.filter(closing | leaf).select(
        "tree", "at", "depth", closing.alias("closing"), F.regexp_replace(F.regexp_replace(label, "^'|'$", ""), "''", "'").alias("label"), length.try_cast("double").alias("brlen")
    )
    # the parent of a node is the first closing after it of the depth that it lies at
    kids = nodes.select("*", F.col("depth").alias("level"), F.lit(None).cast("int").alias("closes"))
    ends = nodes.filter("closing").select("*", (F.col("depth") + 1).alias("level"), F.col("at").alias("closes"))
    back = Window.partitionBy("tree", "level").orderBy(F.desc("at"), "closes").rowsBetween(Window.unboundedPreceding, -1)
    found = kids.unionByName(ends).withColumn("parent", F.last("closes", ignorenulls=True).over(back)).filter("closes is null")
    number = lambda c: F.col("tree") * F.lit(stride) + F.col(c)
    return found.select("tree", number("at").alias("node"), number("parent").alias("parent"), "label", "brlen", (~F.col("closing")).alias("is_leaf"))


def read_newick(spark, path: str | list[str], stride: int = STRIDE) -> DataFrame:
    """(file, tree, node, parent, label, brlen, is_leaf): the trees of text files, one a line; tree numbers those of all files.

    Files and lines are numbered in order; blank lines are no trees.
    """
    from cladewright.operators.ordering import numbered
    from cladewright.sources.lines import numbered_lines

    rows = numbered_lines(spark, path).filter("trim(value) <> ''").select("file", "line", F.col("value").alias("newick"))
    rows = numbered(rows, [], ["file", "line"], "tree").withColumn("tree", F.col("tree") - 1)
    return edges(rows, stride).join(rows.select("tree", "file"), "tree").select("file", "tree", "node", "parent", "label", "brlen", "is_leaf")
