"""Pieces of SQL that several oracles share."""

#: The closure of tree: each node with its ancestors, and itself, and the length between the two.
CLOSURE = """up AS (SELECT node, node AS ancestor, 0 AS up, CAST(0 AS double) AS length FROM tree UNION ALL
 SELECT up.node, t.parent, up.up + 1, up.length + t.brlen FROM up JOIN tree t ON up.ancestor = t.node WHERE t.parent IS NOT NULL)"""
#: Each node with its root, edges and length to it, from the closure.
DEPTHS = "nd AS (SELECT node, arg_max(ancestor, up) AS root, max(up) AS depth, max_by(length, up) AS height FROM up GROUP BY node)"
