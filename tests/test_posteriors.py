"""Posteriors and expected transitions against the sum over all states of all nodes."""

import itertools
import math

import pytest

from cladewright.operators import likelihood

TREE = "node long, parent long, brlen double, is_leaf boolean"


def step(a, b, d, q, nu):
    p = math.exp(-d)
    if a == 0:
        return p ** (1 + nu) if b == 0 else 1 - p**nu if b == -1 else q[b] * p**nu * (1 - p)
    if a == -1:
        return float(b == -1)
    return p**nu if a == b else 1 - p**nu if b == -1 else 0.0


def shows(state, seen, phi):
    if seen is None:
        return 1.0 if state == -1 else phi
    return 1 - phi if state == seen else 0.0


def move(a, b):
    return {(0, 0): 0, (0, -1): 2, (-1, -1): 5}.get((a, b), 1 if a == 0 else 4 if b == -1 else 3)


def enumerated(parents, lengths, seen, q, nu, phi):
    nodes, states = sorted(parents), [0, -1, *q]
    node, edge, total = {(n, s): 0.0 for n in nodes for s in states}, {(n, m): 0.0 for n in nodes for m in range(6)}, 0.0
    for world in itertools.product(states, repeat=len(nodes)):
        at = dict(zip(nodes, world, strict=True))
        p = 1.0
        for n in nodes:
            p *= step(0 if parents[n] is None else at[parents[n]], at[n], lengths[n], q, nu)
            if n in seen:
                p *= shows(at[n], seen[n], phi)
            if not p:
                break
        else:
            total += p
            for n in nodes:
                node[n, at[n]] += p
                edge[n, move(0 if parents[n] is None else at[parents[n]], at[n])] += p
    return {k: v / total for k, v in node.items()}, {k: v / total for k, v in edge.items()}


@pytest.mark.parametrize("nu,phi", [(0.2, 0.1), (0.0, 0.3)])
def test_equals_enumeration(spark, nu, phi):
    # a binary and a three-way tree of unequal depths, in one table
    trees = [({0: None, 1: 0, 2: 0, 3: 1, 4: 1}, [0.3, 0.2, 0.9, 0.4, 0.05]), ({10: None, 11: 10, 12: 10, 13: 10, 14: 11, 15: 11}, [0.1, 0.6, 0.3, 0.8, 0.2, 1.1])]
    q = [{1: 0.4, 2: 0.6}, {3: 1.0}, {1: 0.25, 4: 0.75}]
    seen = [{2: [0, 3, None], 3: [1, None, 4], 4: [1, 3, None]}, {12: [2, 0, None], 13: [None, 3, 1], 14: [2, None, None], 15: [1, 0, 1]}]
    rows = [(n, p, b, n not in parents.values()) for parents, lengths in trees for (n, p), b in zip(parents.items(), lengths, strict=True)]
    leaves = [(n, s, v) for d in seen for n, states in d.items() for s, v in enumerate(states)]
    priors = spark.createDataFrame([(s, k, v) for s, d in enumerate(q) for k, v in d.items()], "site int, state int, q double")
    found = likelihood.outside_pass(spark.createDataFrame(rows, TREE), spark.createDataFrame(leaves, "node long, site int, state int"), priors, nu, phi)
    got = {(r.node, r.site): r for r in found.collect()}
    sums = {r.node: r for r in likelihood.expected_transitions(found).collect()}
    assert len(got) == 11 * 3
    for (parents, lengths), data in zip(trees, seen, strict=True):
        expected = dict.fromkeys(((n, m) for n in parents for m in range(6)), 0.0)
        for s in range(3):
            node, edge = enumerated(parents, dict(zip(parents, lengths, strict=True)), {n: v[s] for n, v in data.items()}, q[s], nu, phi)
            for n in parents:
                r = got[n, s]
                assert r.p_zero == pytest.approx(node[n, 0], abs=1e-8) and r.p_silent == pytest.approx(node[n, -1], abs=1e-8)
                assert r.p_mutated == pytest.approx([node[n, k] for k in sorted(q[s])], abs=1e-8)
                assert r.p_zero + r.p_silent + sum(r.p_mutated) == pytest.approx(1, abs=1e-8)
                assert [r[m] for m in likelihood.MOVES] == pytest.approx([edge[n, m] for m in range(6)], abs=1e-8)
                for m in range(6):
                    expected[n, m] += edge[n, m]
        for n in parents:
            assert [sums[n][m] for m in likelihood.MOVES] == pytest.approx([expected[n, m] for m in range(6)], abs=1e-7)
            assert sum(sums[n][m] for m in likelihood.MOVES) == pytest.approx(3, abs=1e-7)


def test_places_spread_along_edges(spark):
    tree = spark.createDataFrame([(0, None, 1.0, False), (1, 0, 4.0, True), (2, 0, 0.0, True), (3, 0, 1.0, True), (9, None, 1.0, True)], TREE)
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, -1.0), (2, 5.0, 5.0), (3, None, 1.0), (9, 1.0, 1.0)], "node long, x double, y double")
    got = {r.root: r.llh for r in likelihood.spatial_likelihood(tree, at, 0.5).collect()}
    assert got == {0: pytest.approx(-(0.5 * 4 + math.log(1.0)) - (0.5 * 1 + math.log(1.0))), 9: 0.0}
