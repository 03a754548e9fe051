"""Pairwise distances of cells and leaves, and tree relations.

A tree is an edge table (node, parent, brlen, is_leaf); the root has a null parent, and its brlen is the edge above it. A
table may hold many trees, with node numbers of their own: each is worked on by itself, in the same jobs. Nodes may have
any number of children, and leaves any depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewright.operators import ancestry, bundles, pairs

#: Cells of a data set that meet in one piece; larger data sets are dealt into pieces, every two of which meet.
PIECE = 1024


def cell_pairs(characters: DataFrame, by: tuple[str, ...], x: Column, y: Column, piece: int = PIECE) -> DataFrame:
    """(by..., a, b, x, y): each pair of cells a < b of a data set with what they have at their common sites, in their order.

    x and y say what is taken of a site's row for a and for b; a cell belongs to one data set. A cell's sites become one
    row before cells meet, so that rows in the shuffle are cells, not sites of pairs, and no pairs are shuffled or stored.
    """
    row = F.sort_array(F.collect_list(F.struct("site", x.alias("x"), y.alias("y")))).alias("row")
    cells = characters.filter("site is not null").groupBy(*by, "cell").agg(row)
    cells = cells.select(*by, "cell", *[F.col(f"row.{c}").alias(c) for c in ("site", "x", "y")])
    cells = cells.withColumn("once", F.size(F.array_distinct("site")) == F.size("site"))
    total = F.count(F.lit(1))
    cells = cells.select("*", total.over(Window.partitionBy(*by)).alias("cells")) if by else cells.crossJoin(F.broadcast(cells.agg(total.alias("cells"))))
    pieces = F.ceil(F.col("cells") / piece)
    cells = cells.withColumn("own", F.pmod(F.xxhash64("cell"), pieces)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    met = [*by, "low", "high"]
    cells = cells.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    one = cells.select(*met, F.col("cell").alias("a"), F.col("own").alias("own_a"), F.col("site").alias("site_a"), "once", "x")
    two = cells.select(*met, F.col("cell").alias("b"), F.col("own").alias("own_b"), F.col("site").alias("site_b"), "y")
    # two pieces meet for the pairs across them only
    pairs = one.join(two, met).filter("a < b and (low = high or own_a <> own_b)")
    # where the sites of both are not the same ones, once each, they are looked up
    plain = F.col("once") & (F.col("site_a") == F.col("site_b"))
    left, right = F.arrays_zip(F.col("site_a").alias("site"), F.col("x").alias("v")), F.arrays_zip(F.col("site_b").alias("site"), F.col("y").alias("v"))
    same = F.flatten(F.transform(left, lambda p: F.transform(F.filter(right, lambda r: r["site"] == p["site"]), lambda r: F.struct(p["v"].alias("x"), r["v"].alias("y")))))
    common = pairs.select(*by, "a", "b", F.when(~plain, same).alias("same"), "x", "y").filter("same is null or size(same) > 0")
    return common.select(*by, "a", "b", *[F.when(F.col("same").isNull(), F.col(c)).otherwise(F.col(f"same.{c}")).alias(c) for c in ("x", "y")])


def kinds_of_sites(pairs: DataFrame, keep: list[str], kind) -> DataFrame:
    """keep... and kinds: the number that kind(x, y) gives each site of cell_pairs()."""
    return pairs.select(*keep, F.zip_with("x", "y", kind).alias("kinds"))


def of_kind(k: int) -> Column:
    """The number of sites of a kind."""
    return (F.size("kinds") - F.size(F.array_remove("kinds", F.lit(k)))).cast("long")


#: Stands for a missing state among coded ones.
MISSING = np.iinfo(np.int64).min


def _states(state) -> tuple[np.ndarray, np.ndarray]:
    """States as numbers, and their classes: 0 zero, 1 mutated, 2 missing, 3 other."""
    value, known = state
    value = value.astype(np.int64)
    return np.where(known, value, MISSING), np.where(known, np.where(value == 0, 0, np.where(value > 0, 1, 3)), 2).astype(np.uint8)


def _kinds(table: dict, x, y) -> np.ndarray:
    """The kind of each site of pairs: table says which, by both classes and whether the states are equal; -1 elsewhere."""
    kinds = np.full(32, -1, np.int8)
    for (u, v, same), kind in table.items():
        kinds[16 * same + 4 * u + v] = kind
    return kinds[(x[0] == y[0]).astype(np.uint8) * np.uint8(16) + x[1] * np.uint8(4) + y[1]]


def _counted(kinds: np.ndarray, start: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n kinds its number of sites in each pair; up to 8 kinds are counted at once in the bytes of a number."""
    if n <= 8 and np.diff(start, append=len(kinds)).max(initial=0) < 256:
        ones = np.append(np.uint64(1) << (np.uint64(8) * np.arange(n, dtype=np.uint64)), np.uint64(0))
        sums = np.add.reduceat(ones[kinds], start)
        return [(sums >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64) for k in range(n)]
    return [np.add.reduceat((kinds == k).astype(np.int64), start) for k in range(n)]


#: Costs of a site by the classes of its states: nothing where equal, 1 beside a zero, else 2.
COSTS = {(u, v, same): 0 if same else 1 if 0 in (u, v) else 2 for u in (0, 1, 3) for v in (0, 1, 3) for same in (0, 1)}


def weighted_hamming(characters: DataFrame, weights: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d): 1 where one of two known states is 0, 2 where both are mutated and differ, over sites known in both.

    weights: site, weight; each site counts with its weight.
    """

    def plain(x, y, start):
        none, one, two = _counted(_kinds(COSTS, x, y), start, 3)
        return [pa.array((one + 2 * two) / np.maximum(none + one + two, 1), pa.float64())]

    def weighed(x, y, start):
        cost = _kinds(COSTS, x, y)
        known = (cost >= 0) & y[3]
        n = np.add.reduceat(known.astype(np.int64), start)
        return [pa.array(np.add.reduceat(np.where(known, cost * y[2], 0.0), start) / np.maximum(n, 1), pa.float64())]

    if weights is None:
        return pairs.pair_results(characters, by, ["state"], _states, plain, "d double")
    told = characters.join(weights.select("site", F.col("weight").cast("double").alias("weight")), "site")
    return pairs.pair_results(told, by, ["state", "weight"], lambda s, w: (*_states(s), *w), weighed, "d double")


#: Classes of a pair's site, by their numbers.
PAIR_KINDS = ("z_z", "z_a", "a_z", "a_a", "a_b", "m_k", "k_m", "m_m")
#: Those of the classes of both states and whether these are equal.
KINDS_OF = {(0, 0, 1): 0, (0, 1, 0): 1, (1, 0, 0): 2, (1, 1, 1): 3, (1, 1, 0): 4, (2, 2, 1): 7} | {(2, k, 0): 5 for k in (0, 1, 3)} | {(k, 2, 0): 6 for k in (0, 1, 3)}


def pair_counts(characters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, ...): numbers of sites by class: both zero, one mutated, same and different mutations, and any missing."""

    def counts(x, y, start):
        return [pa.array(n) for n in _counted(_kinds(KINDS_OF, x, y), start, len(PAIR_KINDS))]

    return pairs.pair_results(characters, by, ["state"], _states, counts, ", ".join(f"{name} long" for name in PAIR_KINDS))


def pairwise_branch_estimates(characters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d_a, d_b): -ln of the share of sites still zero in each among those zero in the other or mutated alone."""
    c = pair_counts(characters, by)
    alone = lambda other: -F.log(F.col("z_z") / F.nullif(F.col("z_z") + F.col(other), F.lit(0)))
    return c.filter("z_z > 0").select("a", "b", alone("a_z").alias("d_a"), alone("z_a").alias("d_b"))


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, ancestor, via, up, length): the closure, each node its own ancestor at 0; one join for each level of depth.

    via is the child of the ancestor on the way, length that between the two.
    """
    level = tree.select("node", F.col("node").alias("ancestor"), F.lit(None).cast("long").alias("via"), F.lit(0).alias("up"), F.lit(0.0).alias("length"))
    step = tree.filter("parent is not null").select(F.col("node").alias("via"), F.col("parent").alias("ancestor"), "brlen")
    out = level
    while True:
        above = level.select("node", F.col("ancestor").alias("via"), "up", "length").join(step, "via")
        level = above.select("node", "ancestor", "via", (F.col("up") + 1).alias("up"), (F.col("length") + F.col("brlen")).alias("length")).checkpoint()
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def node_depths(tree: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, root, depth, height): edges and length between each node and its root; up is the closure, if it is at hand."""
    if up is None:
        return ancestry.doubled(tree)[0]
    far = up.groupBy("node").agg(F.max(F.struct("up", "ancestor", "length")).alias("x"))
    return far.select("node", F.col("x.ancestor").alias("root"), F.col("x.up").alias("depth"), F.col("x.length").alias("height"))


def leaf_lcas(tree: DataFrame) -> DataFrame:
    """(a, b, lca, distance) for each pair of leaves of a tree: each pair is made where two siblings part them."""
    below = ancestors(tree).filter("up > 0").join(tree.filter("is_leaf").select("node"), "node", "left_semi").select("node", "via", "length")
    children = tree.filter("parent is not null").select("parent", "node")
    siblings = children.withColumnRenamed("node", "va").join(children.withColumnRenamed("node", "vb"), "parent").filter("va <> vb")
    a = below.select(F.col("node").alias("a"), F.col("via").alias("va"), F.col("length").alias("la"))
    b = below.select(F.col("node").alias("b"), F.col("via").alias("vb"), F.col("length").alias("lb"))
    return a.join(siblings, "va").join(b, "vb").filter("a < b").select("a", "b", F.col("parent").alias("lca"), (F.col("la") + F.col("lb")).alias("distance"))


def bipartitions(tree: DataFrame) -> DataFrame:
    """(ancestor, root, side, n): sorted leaves below each inner node but the root, as text."""
    up = ancestors(tree)
    inner = tree.filter("parent is not null").select(F.col("node").alias("ancestor"))
    below = up.filter("up > 0").join(tree.filter("is_leaf").select("node"), "node", "left_semi").join(inner, "ancestor", "left_semi")
    side = F.array_join(F.array_sort(F.collect_list("node")).cast("array<string>"), ",").alias("side")
    sides = below.groupBy("ancestor").agg(side, F.count(F.lit(1)).alias("n")).filter("n > 1")
    roots = node_depths(tree, up).select(F.col("node").alias("ancestor"), "root")
    return sides.join(roots, "ancestor").select("ancestor", "root", "side", "n")


def splits(tree: DataFrame, shared: DataFrame) -> DataFrame:
    """(root, split): the ways in which edges part the leaves in shared, for trees without regard to their root.

    Of the two sides that without the least leaf stands for a split; splits of less than two leaves on a side are left
    out, and edges that part the leaves alike are one.
    """
    up = ancestors(tree)
    roots = node_depths(tree, up).select("node", "root")
    leaves = tree.filter("is_leaf").select("node").join(shared, "node", "left_semi").join(roots, "node")
    whole = leaves.groupBy("root").agg(F.count(F.lit(1)).alias("total"), F.min("node").alias("least"), F.array_sort(F.collect_list("node")).alias("every"))
    below = up.join(leaves, "node").groupBy("root", "ancestor").agg(F.array_sort(F.collect_list("node")).alias("side"))
    both = below.join(whole, "root").filter((F.size("side") > 1) & (F.size("side") < F.col("total") - 1))
    other = F.when(F.array_contains("side", F.col("least")), F.array_except("every", "side")).otherwise(F.col("side"))
    return both.select("root", F.array_join(other.cast("array<string>"), ",").alias("split")).distinct()


def split_hashes(tree: DataFrame, shared: DataFrame) -> DataFrame:
    """(root, split): splits() as a pair of numbers each, without lists of leaves.

    A leaf has two hashes of 64 bits; those of a side are put together by exclusive or, which does not mind the order, and
    what all leaves of the tree add up to tells the other side. The side without the least leaf stands for a split. Different
    splits get the same numbers with a chance of one in 2**128 a pair of them.
    """
    up = ancestors(tree)
    roots = node_depths(tree, up).select("node", "root")
    hashes = F.xxhash64("node").alias("h"), F.xxhash64(F.lit("leaf"), "node").alias("g")
    leaves = tree.filter("is_leaf").select("node").join(shared, "node", "left_semi").join(roots, "node").select("node", "root", *hashes)
    summed = F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.count(F.lit(1)).alias("n"), F.min("node").alias("least")
    whole = leaves.groupBy("root").agg(*summed).select("root", F.col("h").alias("whole_h"), F.col("g").alias("whole_g"), F.col("n").alias("total"), F.col("least").alias("first"))
    below = up.select("node", "ancestor").join(leaves, "node").groupBy("root", "ancestor").agg(*summed)
    both = below.join(whole, "root").filter((F.col("n") > 1) & (F.col("n") < F.col("total") - 1))
    side = lambda c: F.when(F.col("least") == F.col("first"), F.col(c).bitwiseXOR(F.col(f"whole_{c}"))).otherwise(F.col(c)).alias(c)
    return both.select("root", F.struct(side("h"), side("g")).alias("split")).distinct()


def robinson_foulds(first: DataFrame, second: DataFrame) -> DataFrame:
    """(root, only_first, only_second, shared, rf): unrooted distance on the leaves that both have, by the first's root.

    Trees correspond where a split or leaf of theirs does; both tables give corresponding trees the same root number. Splits
    are compared by split_hashes().
    """
    leaves = first.filter("is_leaf").select("node").join(second.filter("is_leaf").select("node"), "node", "left_semi")
    a, b = (split_hashes(t, leaves).withColumn("side", F.lit(i)) for i, t in ((1, first), (2, second)))
    met = a.unionByName(b).groupBy("root", "split").agg(F.sum("side").alias("side"))
    out = met.groupBy("root").agg(*[F.count_if(F.col("side") == i).alias(n) for i, n in ((1, "only_first"), (2, "only_second"), (3, "shared"))])
    apart = F.col("only_first") + F.col("only_second")
    return out.withColumn("rf", apart / (apart + 2 * F.col("shared")))


def _states_joined(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """ancestral_states() by joins, for trees that no task should hold."""
    up = ancestors(tree)
    below = up.join(leaves.select("node", "site", "state"), "node").groupBy("ancestor", "site")
    own = below.agg(F.when(F.min("state") == F.max("state"), F.min("state")).when(F.count("state") > 0, F.lit(0)).alias("own"))
    # the nearest node above that has known leaves
    seen = up.join(own, "ancestor").filter("own is not null").groupBy("node", "site").agg(F.min_by("own", "up").alias("state"))
    roots = node_depths(tree, up).select("node", "root")
    every = roots.join(leaves.join(roots, "node").select("root", "site").distinct(), "root")
    return every.join(seen, ["node", "site"], "left").select("node", "site", F.coalesce("state", F.lit(0)).alias("state"))


def _moves_joined(tree: DataFrame, leaves: DataFrame, priors: DataFrame | None) -> DataFrame:
    """small_parsimony() by joins."""
    states = _states_joined(tree, leaves)
    above = states.select(F.col("node").alias("parent"), "site", F.col("state").alias("before"))
    edge = states.join(tree.select("node", "parent"), "node").join(above, ["parent", "site"], "left")
    moved = (F.col("state") != 0) & (F.col("state") != F.coalesce("before", F.lit(0)))
    cost = F.lit(1.0)
    if priors is not None:
        edge, cost = edge.join(priors.select("site", "state", "q"), ["site", "state"], "left"), -F.log("q")
    roots = node_depths(tree, ancestors(tree)).select("node", "root")
    score = F.coalesce(F.sum(F.when(moved, cost)), F.lit(0.0))
    return edge.join(roots, "node").groupBy("root", "site").agg(F.count_if(moved).alias("changes"), score.alias("score"))


def _scores_joined(tree: DataFrame, leaves: DataFrame, priors: DataFrame | None) -> DataFrame:
    """parsimony_scores() by joins."""
    score = _moves_joined(tree, leaves, priors).groupBy("root").agg(F.sum("score").alias("score"))
    roots = node_depths(tree, ancestors(tree))
    inner = roots.join(tree.filter("not is_leaf").select("node"), "node", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("inner"))
    return score.join(inner, "root", "left").select("root", "score", (F.col("score") / F.col("inner")).alias("normalised"))


def _mutations_joined(tree: DataFrame, states: DataFrame) -> DataFrame:
    """site_mutations() by joins."""
    above = states.select(F.col("node").alias("parent"), "site", F.col("state").alias("before"))
    edge = states.select("node", "site", F.col("state").alias("after")).join(tree.filter("parent is not null").select("node", "parent"), "node").join(above, ["parent", "site"])
    roots = node_depths(tree, ancestors(tree)).select("node", "root")
    return edge.filter("before <> after").join(roots, "node").select("root", "site", "node", "before", "after")


def _coupled_joined(tree: DataFrame, states: DataFrame) -> DataFrame:
    """coupled_leaves() by joins."""
    rows = states.groupBy(F.col("node").alias("lca")).agg(F.sort_array(F.collect_list(F.struct("site", "state"))).alias("s"))
    return leaf_lcas(tree).join(rows, "lca").select("a", "b", "lca", "distance", F.col("s.state").alias("states"))


def _inferred(trees: bundles.Trees) -> np.ndarray:
    """The state of each cell: that of all known leaves below, 0 if they differ, or the one above where none is known."""
    low = np.full(len(trees.cell_node), np.iinfo(np.int64).max)
    high = np.full(len(low), np.iinfo(np.int64).min)
    at, state = trees.row_cell[trees.known], trees.state[trees.known]
    np.minimum.at(low, at, state)
    np.maximum.at(high, at, state)
    for level in reversed(trees.levels[1:]):
        np.minimum.at(low, trees.above[level], low[level])
        np.maximum.at(high, trees.above[level], high[level])
    told, out = low <= high, np.where(low == high, low, 0)
    for level in trees.levels:
        above = trees.above[level]
        out[level] = np.where(told[level], out[level], out[above] if len(above) and above[0] >= 0 else 0)
    return out


def _before(trees: bundles.Trees, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state at the upper end of the edge above each cell, and where there is such a node."""
    some = trees.above >= 0
    some &= trees.real[np.where(some, trees.parent[trees.cell_node], 0)]
    return np.where(some, state[np.where(some, trees.above, 0)], 0), some


def _kinds_of(leaves: DataFrame) -> tuple[str, str]:
    kinds = dict(leaves.dtypes)
    return kinds["site"], kinds["state"]


def _typed(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array(values).cast(pa.int64() if kind == "bigint" else pa.int32())


def ancestral_states(tree: DataFrame, leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(node, site, state): the state that all known leaves below a node have, 0 if they differ.

    leaves: node, site, state (null: missing). A node without known leaves takes the state of the node above it. by are
    columns of both tables that name sets of whole trees. Trees are worked out in bundles of sets.
    """
    site, kind = _kinds_of(leaves)

    def kernel(trees):
        real = trees.real[trees.cell_node]
        yield [pa.array(trees.node[trees.cell_node[real]]), trees.site_values(trees.cell_site[real]), _typed(_inferred(trees)[real], kind)]

    return bundles.in_bundles(tree, leaves, by, kernel, f"node long, site {site}, state {kind}", _states_joined)


def _costs(priors: tuple, trees: bundles.Trees, state: np.ndarray) -> np.ndarray:
    """-ln q of the state of each cell; 0 without a prior."""
    sites, states, q = priors
    if not len(q):
        return np.zeros(len(state))
    distinct = sites.unique()
    of = lambda values: pc.fill_null(pc.index_in(values, value_set=distinct), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.unique(states)
    keys = of(sites) * len(known) + np.searchsorted(known, states)
    order = np.argsort(keys)
    number = np.minimum(np.searchsorted(known, state), len(known) - 1)
    wanted = np.where(known[number] == state, of(trees.sites)[trees.cell_site] * len(known) + number, -1)
    at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    with np.errstate(divide="ignore"):
        return np.where(keys[order][at] == wanted, -np.log(q[order][at]), 0.0)


def _changes(trees: bundles.Trees, priors: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """For each site of each tree the number of changes, and what they cost."""
    state = _inferred(trees)
    before, _ = _before(trees, state)
    moved = (state != 0) & (state != before) & trees.real[trees.cell_node]
    n = len(trees.slot_root)
    changes = np.bincount(trees.cell_slot[moved], minlength=n)
    if priors is None:
        return changes, changes.astype(float)
    return changes, np.bincount(trees.cell_slot[moved], _costs(priors, trees, state)[moved], n)


def small_parsimony(tree: DataFrame, leaves: DataFrame, priors: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(root, site, changes, score): mutations on the edges of each tree, under ancestral_states().

    Above the root all sites are 0, and a mutated state is never undone: an edge changes a site where its lower end is
    mutated and differs from its upper end. priors (site, state, q) weigh each change by -ln q; else score is changes.
    """
    shared = None if priors is None else bundles.shared_priors(priors)
    joined = lambda t, v: _moves_joined(t, v, priors)
    if priors is not None and shared is None:
        return joined(tree, leaves)

    def kernel(trees):
        changes, score = _changes(trees, shared)
        yield [pa.array(trees.node[trees.slot_root]), trees.site_values(trees.slot_site), pa.array(changes), pa.array(score)]

    return bundles.in_bundles(tree, leaves, by, kernel, f"root long, site {_kinds_of(leaves)[0]}, changes long, score double", joined)


def parsimony_scores(tree: DataFrame, leaves: DataFrame, priors: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(root, score, normalised): each tree's score over all sites, and that for each inner node (null without one)."""
    shared = None if priors is None else bundles.shared_priors(priors)
    joined = lambda t, v: _scores_joined(t, v, priors)
    if priors is not None and shared is None:
        return joined(tree, leaves)

    def kernel(trees):
        _, score = _changes(trees, shared)
        n = len(trees.node)
        told = np.flatnonzero(np.bincount(trees.slot_root, minlength=n))
        whole = np.bincount(trees.slot_root, score, n)[told]
        inner = np.bincount(trees.root[trees.real & ~trees.is_leaf], minlength=n)[told]
        yield [pa.array(trees.node[told]), pa.array(whole), pa.array(whole / np.maximum(inner, 1), mask=inner == 0)]

    return bundles.in_bundles(tree, leaves, by, kernel, "root long, score double, normalised double", joined)


def site_mutations(tree: DataFrame, leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(root, site, node, before, after): edges on which a site changes under ancestral_states()."""
    site, kind = _kinds_of(leaves)

    def kernel(trees):
        state = _inferred(trees)
        before, some = _before(trees, state)
        at = np.flatnonzero(some & (before != state))
        node = trees.cell_node[at]
        yield [pa.array(trees.node[trees.root[node]]), trees.site_values(trees.cell_site[at]), pa.array(trees.node[node]), _typed(before[at], kind), _typed(state[at], kind)]

    schema = f"root long, site {site}, node long, before {kind}, after {kind}"
    return bundles.in_bundles(tree, leaves, by, kernel, schema, lambda t, v: _mutations_joined(t, _states_joined(t, v)))


def pair_consensus(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a, b, consensus, d): for each pair of cells the states that both could have had, and the changes from them.

    cells: by..., cell, site, state (null: missing). A site has the state that both share or that the only known one has;
    two different states give 0, and neither known null. d counts the known states of the two that differ from it.
    """
    kind = dict(cells.dtypes)["state"]
    whole = pa.int64() if kind == "bigint" else pa.int32()

    def consensus(x, y, start):
        (u, _), (v, _) = x, y
        shared = np.where((u == v) | (v == MISSING), u, np.where(u == MISSING, v, 0))
        moved = ((u != shared) & (u != MISSING)).astype(np.int64) + ((v != shared) & (v != MISSING))
        states = pa.array(shared, pa.int64(), mask=shared == MISSING).cast(whole)
        ends = pa.array(np.append(start, len(shared)).astype(np.int32))
        return [pa.ListArray.from_arrays(ends, states), pa.array(np.add.reduceat(moved, start))]

    return pairs.pair_results(cells, by, ["state"], _states, consensus, f"consensus array<{'bigint' if kind == 'bigint' else 'int'}>, d long", told=by)


def allelic_coupling(tree: DataFrame, leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, distance, consensus, d): for each pair of leaves of a tree its path length and its pair_consensus."""
    alike = pair_consensus(leaves.withColumnRenamed("node", "cell"), by)
    return leaf_lcas(tree).select("a", "b", "distance").join(alike, ["a", "b"]).select("a", "b", "distance", "consensus", "d")


def tree_coupling(tree: DataFrame) -> DataFrame:
    """(lca, n, mean_distance): leaf pairs by their common ancestor."""
    return leaf_lcas(tree).groupBy("lca").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))


#: Rows of a set beyond which pairs of its leaves are made by joins; pairs made at once.
LARGE_PAIRS, PAIRS = 1 << 15, 1 << 19


def _pairs_of_leaves(trees: bundles.Trees) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, lca, distance) of the pairs of leaves of each tree, a before b by number, some at a time."""
    leaf = np.flatnonzero(trees.is_leaf & trees.real)
    leaf = leaf[np.lexsort((trees.node[leaf], trees.root[leaf]))]
    root = trees.root[leaf]
    later = np.searchsorted(root, root, "right") - np.arange(len(leaf)) - 1
    done, at = np.cumsum(later), 0
    while at < len(leaf):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        n = later[at:upto]
        a = np.repeat(np.arange(at, upto), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        a, b, at = leaf[a], leaf[b], upto
        x, y, one, two = a.copy(), b.copy(), np.zeros(len(a)), np.zeros(len(a))
        # the deeper of the two goes up until they meet
        left = np.flatnonzero(x != y)
        while len(left):
            deep = trees.depth[x[left]] - trees.depth[y[left]]
            up = left[deep >= 0]
            one[up] += trees.brlen[x[up]]
            x[up] = trees.parent[x[up]]
            up = left[deep <= 0]
            two[up] += trees.brlen[y[up]]
            y[up] = trees.parent[y[up]]
            left = left[x[left] != y[left]]
        if len(a):
            yield a, b, x, one + two


def coupled_leaves(tree: DataFrame, leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, lca, distance, states): for each pair of leaves its path length and the sequence of its common ancestor.

    Sequences are those of ancestral_states(), in the order of sites.
    """
    kind = _kinds_of(leaves)[1]

    def kernel(trees):
        state = _inferred(trees)
        for a, b, lca, distance in _pairs_of_leaves(trees):
            some = trees.real[lca] & (trees.width[lca] > 0)
            a, b, lca, distance = a[some], b[some], lca[some], distance[some]
            n = trees.width[lca]
            ends = np.append(0, np.cumsum(n))
            at = np.arange(ends[-1]) + np.repeat(trees.start[lca] - ends[:-1], n)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _typed(state[at], kind))
            yield [*[pa.array(trees.node[x]) for x in (a, b, lca)], pa.array(distance, mask=np.isnan(distance)), lists]

    schema = f"a long, b long, lca long, distance double, states array<{kind}>"
    return bundles.in_bundles(tree, leaves, by, kernel, schema, lambda t, v: _coupled_joined(t, _states_joined(t, v)), most=LARGE_PAIRS)


def aligned_branches(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, first, second): branch lengths of two trees side by side; null where only one tree has the node."""
    a, b = (t.select("node", F.col("brlen").alias(n)) for t, n in ((first, "first"), (second, "second")))
    return a.join(b, "node", "full").select("node", "first", "second")


def pruned(tree: DataFrame, keep: DataFrame) -> DataFrame:
    """The tree over the leaves in keep (node): nodes without such leaves go, inner nodes with one child are bridged.

    The edges above a bridged node are added up. The topmost node that still has two children, or the last leaf, is the
    root, with the length of all edges above it.
    """
    up = ancestors(tree)
    left = up.join(tree.filter("is_leaf").select("node").join(keep, "node", "left_semi"), "node", "left_semi")
    stays = left.groupBy("ancestor").agg(F.count_distinct("via").alias("kids"), F.max(F.col("up") == 0).alias("leaf")).filter("kids > 1 or leaf").select("ancestor", "leaf")
    kept = stays.withColumnRenamed("ancestor", "node")
    # of each node that stays the nearest one above it that stays, or the old root
    above = up.filter("up > 0").join(kept.select("node"), "node", "left_semi").join(stays.select("ancestor"), "ancestor", "left_semi")
    near = above.groupBy("node").agg(F.min_by(F.struct("ancestor", "length"), "up").alias("x"))
    top = node_depths(tree, up).join(tree.select(F.col("node").alias("root"), "brlen"), "root").select("node", (F.col("height") + F.col("brlen")).alias("whole"))
    out = kept.join(near, "node", "left").join(top, "node")
    return out.select("node", F.col("x.ancestor").alias("parent"), F.coalesce("x.length", "whole").alias("brlen"), F.col("leaf").alias("is_leaf"))


#: Fixed value: the least length of an edge.
LEAST_LENGTH = 0.005


def with_duplicates(tree: DataFrame, copies: DataFrame, length: float = LEAST_LENGTH) -> DataFrame:
    """The tree with copies (seed, copy) hung beside their seed leaf: the leaf becomes an inner node numbered -seed.

    That keeps the leaf's length; seed and copies are its children, on edges of the given length.
    """
    seeds = copies.select(F.col("seed").alias("node")).distinct().withColumn("seeded", F.lit(True))
    marked = tree.select("node", "parent", "brlen", "is_leaf").join(seeds, "node", "left")
    hung = F.col("seeded").isNotNull()
    old = marked.select(F.when(hung, -F.col("node")).otherwise(F.col("node")).alias("node"), "parent", "brlen", (F.col("is_leaf") & ~hung).alias("is_leaf"))
    under = seeds.select("node", (-F.col("node")).alias("parent")).unionByName(copies.select(F.col("copy").alias("node"), (-F.col("seed")).alias("parent")))
    return old.unionByName(under.select("node", "parent", F.lit(length).alias("brlen"), F.lit(True).alias("is_leaf")))
