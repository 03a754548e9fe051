"""Tree likelihood under heritable silencing and dropout, and what it tells about inner nodes and edges, by joins.

States of a site are 0 (unmutated), its alphabet, and -1 (silenced). Over an edge of length d with p = exp(-d): 0 stays
with p^(1+nu), becomes alpha with q p^nu (1 - p); a mutation stays with p^nu; either is silenced with 1 - p^nu; silenced
stays. A leaf shows its state with 1 - phi, or is missing with phi, or surely if silenced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewright.operators import bundles
from cladewright.operators.distances import node_depths

NEVER = -1e6  # the log of an impossible event, finite so that sums keep it


def _log(p: float) -> float:
    return math.log(p) if p > 0 else NEVER


def _ln(p: Column) -> Column:
    return F.when(p > 0, F.log(p)).otherwise(F.lit(NEVER))


def _low(x: Column) -> Column:
    return F.greatest(x, F.lit(10 * NEVER))


def _both(a: Column, b: Column) -> Column:
    """The log of the sum of two numbers given by their logs."""
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def _summed(logs: Column) -> Column:
    """The log of the sum of an array of numbers given by their logs."""
    top = F.array_max(logs)
    return top + F.log(F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def _placed(tree: DataFrame) -> DataFrame:
    return tree.select("node", "parent", "brlen").join(node_depths(tree).select("node", "root", "depth"), "node").checkpoint()


def _levels(tree: DataFrame, placed: DataFrame, leaves: DataFrame, priors: DataFrame, nu: float, phi: float, every: int = 1):
    """Yields the nodes of each level, from the deepest up, with what lies below them.

    Columns: those of placed, site, q (of the site's alphabet, in order), the logs of the probability of all that is seen
    below a node given its state (zero, silent, muts: an array in the order of the alphabet), and the same given the state
    at the upper end of the edge above it (up_zero, up_silent, up_muts). Each level is checkpointed, or one of every so many
    where levels are not read again, and leaves are dealt to their levels once.
    """
    alphabet = priors.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("state", "q"))).alias("alphabet"))
    missing, shown, hidden = F.col("state").isNull(), float(_log(1 - phi)), float(_log(phi))
    seen = leaves.join(alphabet, "site").select(
        "node", "site", F.transform("alphabet", lambda a: a["q"]).alias("q"),
        F.when(missing, hidden).when(F.col("state") == 0, shown).otherwise(NEVER).alias("zero"),
        F.when(missing, 0.0).otherwise(NEVER).alias("silent"),
        F.transform("alphabet", lambda a: F.when(missing, hidden).when(a["state"] == F.col("state"), shown).otherwise(NEVER)).alias("muts"),
    )
    seen = seen.join(placed, "node").checkpoint()
    deepest = seen.agg(F.max("depth")).first()[0]
    d, level = F.col("brlen"), None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = seen.filter(F.col("depth") == depth)
        here = here if level is None else here.unionByName(level.join(placed, "node"))
        edge = here.withColumn("lost", F.col("silent") + _ln(1 - F.exp(-d * nu)))
        # all ways that 0 can go
        ways = F.concat(F.array(F.col("zero") - d * (1 + nu), F.col("lost")), F.zip_with("muts", "q", lambda v, q: v + _ln(q * (1 - F.exp(-d))) - d * nu))
        kept = F.transform("muts", lambda v: _both(v - d * nu, F.col("lost")))
        # kept stable by the largest
        edge = edge.withColumn("ways", ways).withColumn("top", F.array_max("ways"))
        summed = F.col("top") + F.log(F.aggregate("ways", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
        edge = edge.withColumns({"up_zero": summed, "up_silent": F.col("silent"), "up_muts": kept}).drop("lost", "ways", "top")
        edge = edge.checkpoint() if depth % every == 0 else edge
        yield edge
        total = F.aggregate("m", F.transform(F.get("m", F.lit(0)), lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        level = edge.filter("parent is not null").groupBy(F.col("parent").alias("node"), "site").agg(
            F.first("q").alias("q"), _low(F.sum("up_zero")).alias("zero"), _low(F.sum("up_silent")).alias("silent"), F.collect_list("up_muts").alias("m")
        )
        level = level.select("node", "site", "q", "zero", "silent", F.transform(total, _low).alias("muts"))


def level_likelihood(tree: DataFrame, leaves: DataFrame, priors: DataFrame, nu: float, phi: float) -> DataFrame:
    """(root, site, llh) for each tree of a table: one join and one grouping a level, for all trees and sites at once.

    Leaves may have any depth and nodes any number of children: a level is met by the leaves at its depth and the nodes
    that were lifted to it. leaves: node, site, state (null: missing). priors: site, state, q.
    """
    level = None
    for level in _levels(tree, _placed(tree), leaves, priors, nu, phi, every=3):
        pass
    if level is None:
        return leaves.select(F.col("node").alias("root"), "site", F.lit(0.0).alias("llh")).limit(0)
    return level.select("root", "site", F.col("up_zero").alias("llh"))


#: What an edge can do: stay unmutated, mutate, be silenced, keep a mutation, be silenced after one, stay silenced.
MOVES = ("zero_zero", "zero_mutated", "zero_silent", "mutated_kept", "mutated_silent", "silent_silent")


class Outside:
    """What outside_pass() tells of the cells of some trees: arrays of a value a cell, p_mutated of one for each state of the alphabet.

    present tells the cells at or above a leaf with a row of that site, given the states of its alphabet in given.
    """

    def __init__(self, trees: bundles.Trees, priors: tuple, nu: float, phi: float):
        ln = lambda p: np.where(p > 0, np.log(np.maximum(p, np.finfo(float).tiny)), NEVER)
        low = lambda x: np.maximum(x, 10 * NEVER)
        both = lambda a, b: np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))
        self.states, q, given = _alphabets(trees.sites, priors)
        self.given = given[trees.cell_site]
        q, d = q[trees.cell_site], trees.brlen[trees.cell_node]
        n, m = self.given.shape
        keep, lose, fresh_q = -d * nu, ln(1 - np.exp(-d * nu)), ln(q * (1 - np.exp(-d))[:, None])
        if np.isnan(d).any():  # of an unknown length nothing is known
            lose[np.isnan(d)] = fresh_q[np.isnan(d)] = np.nan

        def summed(first, second, rest, given):
            every = np.column_stack((first, second, np.where(given, rest, -np.inf)))
            top = every.max(1)
            return top + np.log(np.exp(every - top[:, None]).sum(1))

        # below: of each level what lies below its nodes, and below the upper ends of their edges
        zero, silent, muts, present = np.zeros(n), np.zeros(n), np.zeros((n, m)), np.zeros(n, bool)
        told = given.any(1)[trees.cell_site[trees.row_cell]]
        at, state, missing = trees.row_cell[told], trees.state[told], ~trees.known[told]
        shown, hidden = _log(1 - phi), _log(phi)
        present[at] = True
        zero[at] = np.where(missing, hidden, np.where(state == 0, shown, NEVER))
        silent[at] = np.where(missing, 0.0, NEVER)
        muts[at] = np.where(missing[:, None], hidden, np.where(self.states[trees.cell_site[at]] == state[:, None], shown, NEVER))
        up_zero, up_muts = np.zeros(n), np.zeros((n, m))
        for depth in range(len(trees.levels) - 1, -1, -1):
            here = trees.levels[depth]
            lost = silent[here] + lose[here]
            stay = muts[here] + keep[here, None]
            up_zero[here] = summed(zero[here] + keep[here] - d[here], lost, stay + fresh_q[here], self.given[here])
            up_muts[here] = both(stay, lost[:, None])
            if depth:
                over = trees.levels[depth - 1]
                some = present[here]
                to = trees.above[here][some] - over.start
                size = over.stop - over.start
                add = lambda x: np.bincount(to, x[here][some], size)  # noqa: B023, E731
                present[over] |= np.bincount(to, minlength=size) > 0
                zero[over], silent[over] = low(zero[over] + add(up_zero)), low(silent[over] + add(silent))
                for k in range(m):
                    muts[over, k] = low(muts[over, k] + add(up_muts[:, k]))
        # outside: what a child meets, but for what lies below itself
        llh = np.zeros(len(trees.slot_root))
        if trees.levels:
            llh[trees.cell_slot[trees.levels[0]]] = up_zero[trees.levels[0]]
        llh = llh[trees.cell_slot]
        j_zero, j_silent, j_muts = np.zeros(n), np.full(n, 10 * NEVER), np.full((n, m), 10 * NEVER)
        out_zero, out_silent, out_muts = np.zeros(n), np.zeros(n), np.zeros((n, m))
        for depth, here in enumerate(trees.levels):
            if depth:
                above = trees.above[here]
                j_zero[here] = out_zero[above] + zero[above] - up_zero[here]
                j_silent[here] = out_silent[above] + silent[above] - silent[here]
                j_muts[here] = out_muts[above] + muts[above] - up_muts[here]
            out_zero[here] = j_zero[here] + keep[here] - d[here]
            out_silent[here] = summed(j_silent[here], j_zero[here] + lose[here], j_muts[here] + lose[here, None], self.given[here])
            out_muts[here] = both(j_muts[here] + keep[here, None], j_zero[here, None] + fresh_q[here] + keep[here, None])
        chance = lambda x: np.exp(x - (llh if x.ndim == 1 else llh[:, None]))
        over = lambda x: np.where(self.given, chance(x), 0.0).sum(1)
        self.present = present
        self.p_zero, self.p_silent, self.p_mutated = chance(out_zero + zero), chance(out_silent + silent), chance(out_muts + muts)
        self.moves = (
            chance(out_zero + zero),
            over(j_zero[:, None] + fresh_q + keep[:, None] + muts),
            chance(j_zero + lose + silent),
            over(j_muts + keep[:, None] + muts),
            over(j_muts + (lose + silent)[:, None]),
            chance(j_silent + silent),
        )


def _alphabets(sites: pa.Array, priors: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of sites its states, their q, and which of these places are given."""
    known, states, q = priors
    of = pc.fill_null(pc.index_in(known, value_set=sites), -1).to_numpy(zero_copy_only=False)
    states, q, of = states[of >= 0], q[of >= 0], of[of >= 0].astype(np.int64)
    n = np.bincount(of, minlength=len(sites))
    order = np.lexsort((states, of))
    of = of[order]
    place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    shape = (len(sites), int(n.max(initial=0)))
    out = np.full(shape, np.iinfo(np.int64).min), np.zeros(shape), np.zeros(shape, bool)
    out[0][of, place], out[1][of, place], out[2][of, place] = states[order], q[order], True
    return out


def _known(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def on_bundles(tree: DataFrame, leaves: DataFrame, priors: DataFrame, by: tuple[str, ...], kernel, schema: str, joined) -> DataFrame:
    """kernel(trees, priors) of all trees, or joined(tree, leaves) where the priors are too many for all tasks."""
    shared = bundles.shared_priors(priors)
    if shared is None:
        return joined(tree, leaves)
    if leaves.join(F.broadcast(priors.select("site").distinct()), "site", "left_semi").isEmpty():
        raise ValueError("no leaf of the tree has a state")
    return bundles.in_bundles(tree, leaves, by, lambda trees: kernel(trees, shared), schema, joined, phantoms=False)


def outside_pass(tree: DataFrame, leaves: DataFrame, priors: DataFrame, nu: float, phi: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(root, node, site, p_zero, p_silent, p_mutated, and one column for each of MOVES) given all that is seen.

    p_zero, p_silent and the array p_mutated (in the order of the site's alphabet) are the probabilities of a node's states,
    those of MOVES of what happened on the edge above it; each set sums to one. by are columns of both tables that name sets
    of whole trees. Trees are worked out in bundles of sets, level by level: going down from the roots, what is outside of a
    node is what its parent has outside with what lies below its siblings.
    """
    kind = dict(leaves.dtypes)["site"]

    def kernel(trees, shared):
        told = Outside(trees, shared, nu, phi)
        at = np.flatnonzero(told.present)
        node, given = trees.cell_node[at], told.given[at]
        ends = pa.array(np.append(0, np.cumsum(given.sum(1))).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, _known(told.p_mutated[at][given]))
        ids = [pa.array(trees.node[trees.root[node]]), pa.array(trees.node[node]), trees.site_values(trees.cell_site[at])]
        yield [*ids, _known(told.p_zero[at]), _known(told.p_silent[at]), lists, *[_known(x[at]) for x in told.moves]]

    schema = f"root long, node long, site {kind}, p_zero double, p_silent double, p_mutated array<double>, " + ", ".join(f"{m} double" for m in MOVES)
    return on_bundles(tree, leaves, priors, by, kernel, schema, lambda t, v: outside_joined(t, v, priors, nu, phi))


def outside_joined(tree: DataFrame, leaves: DataFrame, priors: DataFrame, nu: float, phi: float) -> DataFrame:
    """outside_pass() by joins, for trees that no task should hold.

    Going down from the roots, a level joins what its parents have outside them with what lies below its siblings: that
    below the parent less that below the node.
    """
    placed = _placed(tree)
    levels = list(_levels(tree, placed, leaves, priors, nu, phi))[::-1]
    d, out, above = F.col("brlen"), None, None
    whole = levels[0].select("root", "site", F.col("up_zero").alias("llh")) if levels else None
    keep, lose = -d * nu, _ln(1 - F.exp(-d * nu))
    for level in levels:
        if above is None:  # over a root everything is unmutated
            joint = level.withColumns({"j_zero": F.lit(0.0), "j_silent": F.lit(10 * NEVER), "j_muts": F.transform("q", lambda _: F.lit(10 * NEVER))})
        else:
            rest = {f"j_{c}": F.col(f"o_{c}") - F.col(f"up_{c}") for c in ("zero", "silent")}
            joint = level.join(above, ["parent", "site"]).withColumns(rest | {"j_muts": F.zip_with("o_muts", "up_muts", lambda o, u: o - u)})
        came = F.zip_with("j_muts", "q", lambda j, q: _both(j + keep, F.col("j_zero") + _ln(q * (1 - F.exp(-d))) + keep))
        silenced = _summed(F.concat(F.array(F.col("j_silent"), F.col("j_zero") + lose), F.transform("j_muts", lambda j: j + lose)))
        joint = joint.withColumns({"out_zero": F.col("j_zero") + keep - d, "out_silent": silenced, "out_muts": came})
        chance = lambda x: F.exp(x - F.col("llh"))
        over = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
        fresh = F.zip_with("muts", "q", lambda v, q: chance(F.col("j_zero") + _ln(q * (1 - F.exp(-d))) + keep + v))
        moves = (
            chance(F.col("j_zero") + keep - d + F.col("zero")),
            over(fresh),
            chance(F.col("j_zero") + lose + F.col("silent")),
            over(F.zip_with("j_muts", "muts", lambda j, v: chance(j + keep + v))),
            over(F.transform("j_muts", lambda j: chance(j + lose + F.col("silent")))),
            chance(F.col("j_silent") + F.col("silent")),
        )
        told = joint.join(whole, ["root", "site"]).select(
            "root", "node", "site",
            chance(F.col("out_zero") + F.col("zero")).alias("p_zero"), chance(F.col("out_silent") + F.col("silent")).alias("p_silent"),
            F.zip_with("out_muts", "muts", lambda o, v: chance(o + v)).alias("p_mutated"),
            *[m.alias(n) for m, n in zip(moves, MOVES, strict=True)],
            # what a child meets, but for what lies below itself
            (F.col("out_zero") + F.col("zero")).alias("o_zero"), (F.col("out_silent") + F.col("silent")).alias("o_silent"),
            F.zip_with("out_muts", "muts", lambda o, v: o + v).alias("o_muts"),
        ).checkpoint()
        above = told.select(F.col("node").alias("parent"), "site", "o_zero", "o_silent", "o_muts")
        done = told.drop("o_zero", "o_silent", "o_muts")
        out = done if out is None else out.unionByName(done)
    if out is None:
        raise ValueError("no leaf of the tree has a state")
    return out


def expected_transitions(posteriors: DataFrame) -> DataFrame:
    """(root, node, one column for each of MOVES): how often each happened on the edge above a node, over all sites."""
    return posteriors.groupBy("root", "node").agg(*[F.sum(m).alias(m) for m in MOVES])


def tree_transitions(tree: DataFrame, leaves: DataFrame, priors: DataFrame, nu: float, phi: float, by: tuple[str, ...] = ()) -> DataFrame:
    """expected_transitions() of outside_pass(), added up where they are made."""

    def kernel(trees, shared):
        told = Outside(trees, shared, nu, phi)
        node, n = trees.cell_node[told.present], len(trees.node)
        some = np.flatnonzero(np.bincount(node, minlength=n))
        yield [pa.array(trees.node[trees.root[some]]), pa.array(trees.node[some]), *[_known(np.bincount(node, x[told.present], n)[some]) for x in told.moves]]

    schema = "root long, node long, " + ", ".join(f"{m} double" for m in MOVES)
    return on_bundles(tree, leaves, priors, by, kernel, schema, lambda t, v: expected_transitions(outside_joined(t, v, priors, nu, phi)))


def spatial_likelihood(tree: DataFrame, locations: DataFrame, sigma: float) -> DataFrame:
    """(root, llh) of places that spread by Brownian motion: locations (node, x, y), with sigma the spread of length one.

    An edge counts if both its ends have a place and it has a length above 0; a tree without such edges has 0. Constants of
    the normal density are left out.
    """
    at = locations.select("node", "x", "y").dropna()
    above = at.select(F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    spread = sigma * F.sqrt("brlen")
    one = lambda a, b: -(0.5 * F.pow((F.col(a) - F.col(b)) / spread, 2) + F.log(spread))
    edges = tree.filter("parent is not null and brlen > 0").select("node", "parent", "brlen").join(at, "node").join(above, "parent")
    roots = node_depths(tree).select("node", "root")
    llh = edges.join(roots, "node").groupBy("root").agg(F.sum(one("x", "px") + one("y", "py")).alias("llh"))
    return roots.select("root").distinct().join(llh, "root", "left").select("root", F.coalesce("llh", F.lit(0.0)).alias("llh"))
