"""Scaled, collapsed, resolved and subsampled trees by hand."""

import random
from collections import Counter

from pyspark.sql import functions as F

from cladewright.operators import distances, transforms

EDGES = "node long, parent long, brlen double, is_leaf boolean"
ROWS = [(1, None, 9.0, False), (2, 1, 0.1, False), (3, 2, 0.05, False), (4, 3, 2.0, True), (5, 3, 1.0, True), (6, 2, 4.0, True), (7, 1, 0.01, True), (8, 1, None, False), (9, 8, 3.0, True)]


def _rows(df):
    return {tuple(r) for r in df.collect()}


def test_scaled(spark):
    tree = spark.createDataFrame([r for r in ROWS if r[2] is not None and r[0] < 8] + [(20, None, 0.0, True)], EDGES)
    got = {r.node: (round(r.brlen, 9), r.rate and round(r.rate, 9)) for r in transforms.scaled(tree, 2.0).collect()}
    # the height is 0.1 + 4
    assert got[6] == (round(4 / 2.05, 9), 2.05) and got[1] == (round(9 / 2.05, 9), 2.05) and got[20] == (0.0, None)


def test_collapsed(spark):
    got = {r.node: (r.parent, r.brlen) for r in transforms.collapsed(spark.createDataFrame(ROWS, EDGES), 0.1).collect()}
    # a chain of two short edges, and a null length; short leaves and the root stay
    assert got == {1: (None, 9.0), 4: (1, 2.0), 5: (1, 1.0), 6: (1, 4.0), 7: (1, 0.01), 9: (1, 3.0)}
    assert _rows(transforms.collapsed(spark.createDataFrame(ROWS, EDGES), -1.0)) == set(ROWS)


def test_long_chain_collapses(spark):
    n = 300
    rows = [(0, None, 1.0, False)] + [(i, i - 1, 0.0 if i < n else 1.0, i == n) for i in range(1, n + 1)]
    assert _rows(transforms.collapsed(spark.createDataFrame(rows, EDGES), 0.0)) == {(0, None, 1.0, False), (n, 0, 1.0, True)}


def test_resolved(spark):
    rows = [(0, None, 1.0, False)] + [(i, 0, 1.0, True) for i in range(1, 6)]
    got = _rows(transforms.resolved(spark.createDataFrame(rows, EDGES), 0.5))
    new = {(8, 0, 0.5, False, True), (9, 8, 0.5, False, True), (10, 9, 0.5, False, True)}
    assert got == new | {(0, None, 1.0, False, False), (1, 0, 1.0, True, False), (2, 8, 1.0, True, False), (3, 9, 1.0, True, False), (4, 10, 1.0, True, False), (5, 10, 1.0, True, False)}
    binary = spark.createDataFrame(ROWS, EDGES).filter("node not in (8, 9)")
    assert _rows(transforms.resolved(binary.filter("node <> 7")).drop("mark")) == {r for r in ROWS if r[0] < 7}


def test_wide_node_is_resolved(spark):
    rows = [(0, None, 1.0, False)] + [(i, 0, 1.0, True) for i in range(1, 3001)]
    got = transforms.resolved(spark.createDataFrame(rows, EDGES).repartition(8)).collect()
    kids = Counter(r.parent for r in got if r.parent is not None)
    assert set(kids.values()) == {2} and len(got) == 3001 + 2998 and len({r.node for r in got}) == len(got)


def test_samples(spark):
    tree = spark.createDataFrame(ROWS + [(100, None, 0.0, True)], EDGES)
    leaves = {4, 5, 6, 7, 9}
    seen = Counter()
    for seed in range(12):
        got = [r.node for r in transforms.sampled_leaves(tree, 2, seed).filter("root = 1").collect()]
        assert len(got) == 2 and set(got) <= leaves
        seen.update(got)
    assert set(seen) == leaves
    assert _rows(transforms.sampled_leaves(tree, 2, 3)) == _rows(transforms.sampled_leaves(tree.repartition(5), 2, 3))
    assert {r.node for r in transforms.sampled_leaves(tree, 99).collect()} == leaves | {100}
    two = transforms.subsampled(tree.withColumn("brlen", F.coalesce("brlen", F.lit(0.0))), 2).filter("is_leaf and node <> 100").collect()
    assert len(two) == 2


def test_empty(spark):
    none = spark.createDataFrame([], EDGES)
    for f in (lambda t: transforms.scaled(t), lambda t: transforms.collapsed(t, 1.0), lambda t: transforms.resolved(t), lambda t: transforms.subsampled(t, 3)):
        assert f(none).count() == 0


def test_splits_by_hash_are_those_by_lists(spark):
    rng = random.Random(8)
    rows, last = [], 0
    for t in range(5):
        n, first = 25 + 10 * t, last + 1
        parents = {i: rng.randrange(first, i) for i in range(first + 1, first + n)}
        rows += [(i, parents.get(i), 1.0, i not in parents.values()) for i in range(first, first + n)]
        last = first + n
    tree = spark.createDataFrame(rows, EDGES).checkpoint()
    shared = tree.filter("is_leaf and node % 7 <> 0").select("node")
    by_list = Counter(r.root for r in distances.splits(tree, shared).collect())
    by_hash = distances.split_hashes(tree, shared).collect()
    assert Counter(r.root for r in by_hash) == by_list and sum(by_list.values()) > 20
    # the same splits, whichever node is the root: two trees of four leaves rooted at either end
    one = spark.createDataFrame([(1, None, 1.0, False), (2, 1, 1.0, False), (3, 1, 1.0, False), (4, 2, 1.0, True), (5, 2, 1.0, True), (6, 3, 1.0, True), (7, 3, 1.0, True)], EDGES)
    other = spark.createDataFrame([(1, None, 1.0, False), (4, 1, 1.0, True), (2, 1, 1.0, False), (5, 2, 1.0, True), (3, 2, 1.0, False), (6, 3, 1.0, True), (7, 3, 1.0, True)], EDGES)
    assert distances.robinson_foulds(one, other).first().asDict() == {"root": 1, "only_first": 0, "only_second": 0, "shared": 1, "rf": 0.0}
