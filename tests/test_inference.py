"""Golden likelihoods, properties of the expectations, and optima by brute force."""

import itertools
import math

import numpy as np
import pytest

from cladewright.functions import model, trees
from cladewright.operators import distances, inference, likelihood, simulation

CHERRY = trees.parse_newick("((a:1,b:1):1,c:1):1;")
#: Published values of the negative log-likelihood on the tree above, one site, alphabet {1}.
GOLDEN = [
    ((1, 1, 1), 0, 0.20665578828621584), ((1, 1, 0), 0, 2.2495946917551692), ((1, 0, 1), 0, 3.917350291274164), ((0, 1, 1), 0, 3.917350291274164),
    ((1, 0, 0), 0, 4.4586751457870815), ((0, 0, 0), 0, 5.0), ((0, 0, "?"), 0.1, 6.513306124309698), ((0, 1, "?"), 0.1, 5.97198126969678),
    ((1, "?", 0), 0.1, 4.658719582178557), ((1, 1, "?"), 0.1, 2.5980566021648364), ((1, "?", 1), 0.1, 2.695795750497349),
]


@pytest.mark.parametrize("states,phi,want", GOLDEN)
def test_golden_likelihoods(states, phi, want):
    data = model.data_of(dict(zip("abc", ([s] for s in states), strict=True)), [{1: 1.0}])
    assert math.isclose(model.nllh(CHERRY, data, 0, phi), want, abs_tol=1e-7)


def test_two_letters_and_a_zero_edge():
    data = model.data_of({"a": [1], "b": [1], "c": [1]}, [{1: 0.5, 2: 0.5}])
    assert math.isclose(model.nllh(CHERRY, data, 0, 0), 1.0297894223949402, abs_tol=1e-7)
    data = model.data_of({"a": [1], "b": [1], "c": [1]}, [{1: 1.0}])
    assert math.isclose(model.nllh(trees.parse_newick("((a:1,b:1):0,c:1):1;"), data, 0, 0), 0.3215288449416738, abs_tol=1e-7)


def random_data(seed, leaves="abcdef", sites=8):
    rng = np.random.default_rng(seed)
    return model.data_of({x: [(0, 1, 2, "?")[v] for v in rng.integers(0, 4, sites)] for x in leaves}, [{1: 0.4, 2: 0.6}] * sites)


TREE6 = trees.parse_newick("(((a:.3,b:.5):.2,c:.9):.1,((d:.2,e:.4):.6,f:.3):.2):.15;")


def test_expectations_are_derivatives():
    """By the chain of conditional expectations, the slope of the expected log-likelihood is that of the likelihood."""
    data, nu, phi, h = random_data(1), 0.2, 0.1, 1e-6
    s, *_ = model.expectations(TREE6, data, nu, phi)
    slope = model._slopes(s, TREE6.length, nu)[0]
    for i in range(len(TREE6.length)):
        up, down = TREE6.length.copy(), TREE6.length.copy()
        up[i] += h
        down[i] -= h
        diff = (model.nllh(trees.Tree(TREE6.parent, down, TREE6.label), data, nu, phi) - model.nllh(trees.Tree(TREE6.parent, up, TREE6.label), data, nu, phi)) / (2 * h)
        assert math.isclose(diff, slope[i], rel_tol=1e-4, abs_tol=1e-4)


def test_em_never_gets_worse_and_beats_a_grid():
    data = random_data(2)
    got = model.fit(TREE6, data)
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(got.trace))
    assert all(got.nllh <= model.nllh(TREE6, data, nu, phi) + 1e-9 for nu in (0, 0.2, 0.5) for phi in (0.05, 0.2))


def test_ultrametric_fit_keeps_leaves_level():
    got = model.fit(TREE6, random_data(3), ultrametric=True, most_rounds=60)
    h = trees.heights(got.tree)[got.tree.leaves]
    assert np.ptp(h) < 1e-6 and got.nllh >= model.fit(TREE6, random_data(3)).nllh - 1e-6


def test_newick_round_trip_and_edits():
    text = "((a:1,'b c':2)x:0.5,(d,e:3,f:1e-2):4);"
    t = trees.parse_newick("[&R] " + text)
    again = trees.parse_newick(trees.write_newick(t))
    assert again.label == t.label and np.allclose(again.length, t.length, equal_nan=True) and (again.parent == t.parent).all()
    binary, new = trees.resolved(t)
    assert all(len(k) in (0, 2) for k in binary.children) and new.sum() == 1
    assert sorted(trees.collapsed(binary, 0.01).label) == sorted(t.label)
    assert len(trees.nni_neighbours(TREE6, int(TREE6.parent[0]))) == 2
    chain = trees.resolved(trees.parse_newick("(((a:1,b:1):1):2,c:1):1;"))[0]
    assert len(chain.parent) == 5 and sorted(chain.length.tolist()) == [1, 1, 1, 1, 3]


def test_neighbour_joining_recovers_additive_distances():
    names = list("abcdef") + ["root"]
    h = trees.heights(TREE6)
    up = {i: [i] for i in range(len(h))}
    for i in reversed(range(len(h))):
        if TREE6.parent[i] >= 0:
            up[i] = [i, *up[int(TREE6.parent[i])]]
    at = {TREE6.label[i]: i for i in TREE6.leaves.tolist()}

    def gap(x, y):
        if "root" in (x, y):
            return 0.0 if x == y else h[at[x if y == "root" else y]]
        common = max((h[i] for i in up[at[x]] if i in up[at[y]]), default=0)
        return h[at[x]] + h[at[y]] - 2 * common

    got = trees.neighbour_joining(names, np.array([[gap(x, y) for y in names] for x in names]), "root")
    g = trees.heights(got)
    assert {got.label[i]: round(g[i], 6) for i in got.leaves.tolist()} == {x: round(h[i], 6) for x, i in at.items()}


def relational(spark, tree, states, priors, nu, phi):
    """The negative log-likelihood by joins; states: {leaf: [state or '?', ...]}, priors: one {state: q} for each site."""
    at = {x: i for i, x in enumerate(tree.label)}
    kids = [len(k) for k in tree.children]
    edges = [(i, int(p) if p >= 0 else None, float(d), n == 0) for i, (p, d, n) in enumerate(zip(tree.parent, tree.length, kids, strict=True))]
    edges = spark.createDataFrame(edges, "node long, parent long, brlen double, is_leaf boolean")
    rows = [(at[x], j, None if v == "?" else v) for x, row in states.items() for j, v in enumerate(row)]
    rows = spark.createDataFrame(rows, "node long, site int, state int")
    q = spark.createDataFrame([(j, a, float(v)) for j, p in enumerate(priors) for a, v in p.items()], "site int, state int, q double")
    return -sum(r.llh for r in likelihood.level_likelihood(edges, rows, q, nu, phi).collect())


def test_relational_likelihood_on_unbalanced_trees(spark):
    for states, phi, want in GOLDEN[::3]:
        assert math.isclose(relational(spark, CHERRY, dict(zip("abc", ([s] for s in states), strict=True)), [{1: 1.0}], 0, phi), want, abs_tol=1e-7)
    halves = {x: [1] for x in "abc"}
    assert math.isclose(relational(spark, CHERRY, halves, [{1: 0.5, 2: 0.5}], 0, 0), 1.0297894223949402, abs_tol=1e-7)
    rng = np.random.default_rng(4)
    star = trees.parse_newick("(a:.3,(b:.2,c:.4,d:.1):.3,((e:.2):.1,f:.5):.2):.1;")
    states = {x: [(0, 1, 2, "?")[v] for v in rng.integers(0, 4, 6)] for x in "abcdef"}
    priors = [{1: 0.4, 2: 0.6}] * 6
    for t in (TREE6, star):
        assert math.isclose(relational(spark, t, states, priors, 0.2, 0.1), model.nllh(t, model.data_of(states, priors), 0.2, 0.1), rel_tol=1e-8)


def test_parsimony_on_unbalanced_trees(spark):
    edges = spark.createDataFrame([(1, None, 1.0, False), (2, 1, 1.0, False), (3, 1, 1.0, True), (4, 2, 1.0, True), (5, 2, 1.0, True)], "node long, parent long, brlen double, is_leaf boolean")
    rows = [(3, 0, 1), (4, 0, 2), (5, 0, 1), (3, 1, None), (4, 1, 2), (5, 1, 2), (3, 2, 0), (4, 2, None), (5, 2, None), (3, 3, 1), (4, 3, 1), (5, 3, 1)]
    leaves = spark.createDataFrame(rows, "node long, site int, state int")
    got = {r.site: r.changes for r in distances.small_parsimony(edges, leaves).collect()}
    assert got == {0: 3, 1: 1, 2: 0, 3: 1}
    states = {(r.node, r.site): r.state for r in distances.ancestral_states(edges, leaves).collect()}
    assert len(states) == 20 and states[1, 1] == 2 and states[3, 1] == 2 and states[2, 0] == 0 and states[4, 2] == 0


def test_unrooted_distance_ignores_the_root(spark):
    schema = "node long, parent long, brlen double, is_leaf boolean"
    first = spark.createDataFrame([(9, None, 1.0, False), (8, 9, 1.0, False), (7, 9, 1.0, False), (1, 8, 1.0, True), (2, 8, 1.0, True), (3, 7, 1.0, True), (4, 7, 1.0, True)], schema)
    # the same unrooted tree, rooted beside leaf 1, with a leaf that the first has not
    second = spark.createDataFrame([(9, None, 1.0, False), (1, 9, 1.0, True), (8, 9, 1.0, False), (2, 8, 1.0, True), (7, 8, 1.0, False), (3, 7, 1.0, True), (6, 7, 1.0, False), (4, 6, 1.0, True), (5, 6, 1.0, True)], schema)
    r = distances.robinson_foulds(first, second).first()
    assert (r.only_first, r.only_second, r.shared, r.rf) == (0, 0, 1, 0.0)


def test_search_finds_the_best_of_all_four_leaf_trees(spark):
    data = model.data_of({"a": [1, 1, 0, 1, 2], "b": [1, 1, 0, 1, 0], "c": [0, 2, 1, 0, 1], "d": [0, 2, 1, 0, 0]}, [{1: 0.5, 2: 0.5}] * 5)
    every = [f"((({p[0]},{p[1]}),{p[2]}),{p[3]});" for p in itertools.permutations("abcd")] + [f"(({p[0]},{p[1]}),({p[2]},{p[3]}));" for p in itertools.permutations("abcd")]
    best = min(model.fit(trees.parse_newick(t), data).nllh for t in every)
    found = inference.search(spark, "((a,c),(b,d));", data, most_moves=25, heat=4.0).orderBy("step", ascending=False).first()
    assert found.nllh <= best * (1 + 1e-4)


def test_simulated_shares(spark):
    tree = simulation.balanced_tree(spark, 4, 0.25)
    rows = simulation.simulate(tree, simulation.uniform_priors(spark, 200, 3), 4, 0.2, 0.1, seed=1).filter("is_leaf")
    n = rows.count()
    d = 5 * 0.25
    silent, zero = rows.filter("state = -1").count() / n, rows.filter("state = 0").count() / n
    assert abs(silent - (1 - math.exp(-d * 0.2))) < 0.04
    assert abs(zero - math.exp(-d * 1.2) * 0.9) < 0.04
    assert abs(rows.filter("state is null").count() / n - math.exp(-d * 0.2) * 0.1) < 0.02


def test_extra_dropout_takes_its_share_and_nothing_else(spark):
    cells = spark.range(20000).selectExpr("id div 20 as cell", "id % 20 as site", "if(id % 10 = 0, null, id % 3) as state")
    states = lambda df: {(r.cell, r.site): r.state for r in df.collect()}
    before, after = states(cells), states(simulation.extra_dropout(cells, 0.25, seed=4))
    assert before.keys() == after.keys() and all(after[k] in (None, before[k]) for k in before)
    known = [k for k in before if before[k] is not None]
    assert abs(sum(after[k] is None for k in known) / len(known) - 0.25) < 0.02
    assert after == states(simulation.extra_dropout(cells.repartition(7), 0.25, seed=4))
    assert states(simulation.extra_dropout(cells, 0.0)) == before
    assert not any(v is not None for v in states(simulation.extra_dropout(cells, 1.0)).values())
