"""Walks round trees, Newick texts and numbering, against recursion and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from cladewright.operators import tours
from cladewright.operators.ordering import numbered
from cladewright.sources import newick

EDGES = "node long, parent long, brlen double, is_leaf boolean"


def _random_tree(rng, n, first):
    """Rows of a tree of n nodes, numbered at random from first."""
    ids = rng.sample(range(first, first + 10 * n), n)
    rows, kids = [(ids[0], None, 0.5)], {}
    for i in range(1, n):
        parent = ids[rng.randrange(i)]
        kids.setdefault(parent, []).append(ids[i])
        rows.append((ids[i], parent, rng.randrange(1, 9) / 4))
    return [(*r, r[0] not in kids) for r in rows], kids


def _text(node, kids, lengths):
    inner = "(" + ",".join(_text(k, kids, lengths) for k in sorted(kids[node])) + ")" if node in kids else ""
    return f"{inner}{node}:{lengths[node]}"


def test_walk_and_text_of_random_trees(spark):
    rng, rows, want, sizes = random.Random(3), [], {}, {}
    for t in range(6):
        tree, kids = _random_tree(rng, [1, 2, 5, 30, 80, 150][t], t * 10000)
        rows += tree
        lengths = {r[0]: r[2] for r in tree}
        want[tree[0][0]] = _text(tree[0][0], kids, lengths) + ";"

        def size(n, kids=kids):
            sizes[n] = 1 + sum(size(k) for k in kids.get(n, []))
            return sizes[n]

        size(tree[0][0])
    tree = spark.createDataFrame(rows, EDGES)
    assert {r.root: r.newick for r in tours.newick(tree).collect()} == want
    walk = tours.tour(tree).collect()
    assert {r.node: r["size"] for r in tours.subtree_sizes(tree).collect()} == sizes
    assert len({(r.root, r.enter) for r in walk} | {(r.root, r.leave) for r in walk}) == 2 * len(rows)
    assert all(r.leave == 0 for r in walk if r.node == r.root)


def test_deep_comb(spark):
    n = 1000
    rows = [(1, None, 1.0, False)] + [x for i in range(1, n) for x in ((2 * i, 2 * i - 1, 1.0, True), (2 * i + 1, 2 * i - 1, 1.0, i == n - 1))]
    got = {r.node: r["size"] for r in tours.subtree_sizes(spark.createDataFrame(rows, EDGES)).collect()}
    assert got[1] == 2 * n - 1 and got[3] == 2 * n - 3 and got[2] == 1


def test_empty_and_circle(spark):
    assert tours.tour(spark.createDataFrame([], EDGES)).count() == 0
    assert tours.newick(spark.createDataFrame([], EDGES)).count() == 0
    with pytest.raises(ValueError, match="circle"):
        tours.tour(spark.createDataFrame([(1, 2, 1.0, False), (2, 1, 1.0, False)], EDGES), most_rounds=6).count()


def test_names_of_texts(spark):
    rows = [(1, None, None, False, None), (2, 1, 0.5, True, "it's (a)"), (3, 1, None, True, "b"), (4, 1, 2.0, True, None)]
    tree = spark.createDataFrame(rows, EDGES + ", name string")
    text = tours.newick(tree, "name").first().newick
    assert text == "('it''s (a)':0.5,b,:2.0);"
    got = {(r.label, r.brlen, r.is_leaf) for r in newick.edges(spark.createDataFrame([(0, text)], "tree long, newick string")).collect()}
    assert got == {("it's (a)", 0.5, True), ("b", None, True), (None, 2.0, True), (None, None, False)}
    assert tours.newick(tree, "name", lengths=False).first().newick == "('it''s (a)',b,);"


def test_parsed_texts(spark):
    texts = [(0, "((a:1,b:2)x:0.5,c [note],(d,e)'y z':1e-3)r:0.25;"), (1, "only:3;"), (2, None), (3, ""), (4, ";"), (5, "(a:x,\n b:1);")]
    rows = newick.edges(spark.createDataFrame(texts, "tree long, newick string"), stride=100).collect()
    name = {r.node: r.label for r in rows}
    got = {(r.tree, r.label, name.get(r.parent), r.brlen, r.is_leaf) for r in rows}
    assert got == {
        (0, "a", "x", 1.0, True), (0, "b", "x", 2.0, True), (0, "x", "r", 0.5, False), (0, "c", "r", None, True), (0, "d", "y z", None, True),
        (0, "e", "y z", None, True), (0, "y z", "r", 0.001, False), (0, "r", None, 0.25, False), (1, "only", None, 3.0, True),
        (5, "a", None, None, True), (5, "b", None, 1.0, True), (5, None, None, None, False),
    }
    assert len({r.node for r in rows}) == len(rows)


def test_files(spark, tmp_path):
    rows, _ = _random_tree(random.Random(5), 40, 0)
    more, _ = _random_tree(random.Random(6), 20, 5000)
    tree = spark.createDataFrame(rows + more, EDGES)
    tours.write_newick(tree, str(tmp_path / "out"))
    back = newick.read_newick(spark, str(tmp_path / "out"))
    above = back.select(F.col("node").alias("parent"), F.col("label").alias("above"))
    got = {(int(r.label), r.above and int(r.above), r.brlen, r.is_leaf) for r in back.join(above, "parent", "left").collect()}
    assert got == set(rows + more)
    assert {r.tree for r in back.select("tree").distinct().collect()} == {0, 1}


@pytest.mark.parametrize("parts", [1, 7])
def test_places_in_groups_of_any_size(spark, parts):
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 5}", i * 7919 % 1000) for i in range(1000)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = numbered(spark.createDataFrame(rows, "k string, v long"), ["k"], [F.desc("v")]).collect()
        every = numbered(spark.createDataFrame(rows, "k string, v long"), [], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in {r.k for r in got}:
        mine = sorted((r.place, r.v) for r in got if r.k == key)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        assert [v for _, v in mine] == sorted((v for k, v in rows if k == key), reverse=True)
    assert sorted((r.place, r.v) for r in every) == list(enumerate(sorted(v for _, v in rows), 1))
