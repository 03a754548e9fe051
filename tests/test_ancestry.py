"""Common ancestors and depths against paths followed node by node."""

import random

from cladewright.operators import ancestry, distances

TREE = "node long, parent long, brlen double, is_leaf boolean"


def path(parents, node):
    out = [node]
    while parents[node] is not None:
        node = parents[node]
        out.append(node)
    return out


def common(parents, nodes):
    paths = [path(parents, n) for n in nodes if n in parents]
    shared = set.intersection(*map(set, paths)) if paths else set()
    return next((x for x in paths[0] if x in shared), None) if paths else None


def test_ancestors_of_many_nodes(spark):
    rng = random.Random(3)
    parents = {0: None, 1000: None}
    for i in range(1, 200):
        parents[i] = rng.randrange(max(0, i - 6), i)
    for i in range(1001, 1040):
        parents[i] = rng.randrange(1000, i)
    inner = set(parents.values())
    tree = spark.createDataFrame([(n, p, 0.5, n not in inner) for n, p in parents.items()], TREE)
    asked = {q: rng.sample(range(200), rng.randint(1, 6)) for q in range(60)}
    asked |= {100: [5, 5], 101: [7, 5000], 102: [6000], 103: [3, 1003], 104: [1005, 1030, 1030]}
    got = {r.query: r for r in ancestry.common_ancestors(tree, spark.createDataFrame([(q, n) for q, ns in asked.items() for n in ns], "query int, node long")).collect()}
    assert {q: r.lca for q, r in got.items()} == {q: common(parents, ns) for q, ns in asked.items()}
    assert (got[101].n_known, got[101].n_unknown, got[102].lca, got[103].lca) == (1, 1, None, None)
    depths = {r.node: (r.root, r.depth, r.height) for r in distances.node_depths(tree).collect()}
    assert depths == {n: (path(parents, n)[-1], len(path(parents, n)) - 1, 0.5 * (len(path(parents, n)) - 1)) for n in parents}


def test_a_tree_of_a_thousand_levels(spark):
    # a comb: inner nodes 0..999 in a line, each with a leaf beside it
    rows = [(i, i - 1 if i else None, 1.0, False) for i in range(1000)] + [(10_000 + i, i, 1.0, True) for i in range(1000)]
    tree = spark.createDataFrame(rows, TREE)
    depths, jumps = ancestry.doubled(tree)
    assert depths.agg({"depth": "max"}).first()[0] == 1000 and len(jumps) == 10
    queries = spark.createDataFrame([(1, 10_999), (1, 10_990), (2, 10_003), (2, 10_800), (2, 10_900), (3, 10_500)], "query int, node long")
    assert {r.query: r.lca for r in ancestry.common_ancestors(tree, queries).collect()} == {1: 990, 2: 3, 3: 10_500}


def test_partition_of_edges(spark):
    tree = spark.createDataFrame([(0, None, 0.1, False), (1, 0, 0.1, False), (2, 0, 0.1, True), (3, 1, 0.1, True), (4, 1, 0.1, True)], TREE)
    cases = {0: (1, 1, 1), 1: (1, 1, None), 2: (None, 2, 3), 3: (0, 1, 1), 4: (None, None, None), 5: (2, 1, 1), 6: (None, 0, None)}
    leaves = spark.createDataFrame([(n, s, v) for s, states in cases.items() for n, v in zip((2, 3, 4), states, strict=True)], "node long, site int, state int")
    got = {(r.site, r.node): r.tag for r in ancestry.edge_partition(distances.ancestors(tree), leaves).collect()}
    tag = lambda v: "?" if v is None else "z" if v == 0 else str(v)

    def up(*tags):
        rest = set(tags) - {"z", "?"}
        return "z" if "z" in tags or len(rest) > 1 else rest.pop() if rest else "?"

    for s, (a, b, c) in cases.items():
        one = up(tag(b), tag(c))
        assert [got[s, n] for n in (2, 3, 4, 1, 0)] == [tag(a), tag(b), tag(c), one, up(tag(a), one)]
