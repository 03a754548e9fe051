"""Branches of pairs against a fine grid, and triplets and heat maps by hand."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from cladewright.operators import heatmaps, triplets

LONG = "cell long, site int, state int"


def _llh(x, y, q, d):
    """The likelihood of two cells' states on the three branches d, site by site."""
    a, b, r = d
    out = 0.0
    for s, (u, v) in enumerate(zip(x, y, strict=True)):
        stay, za, zb = math.exp(-r), math.exp(-a), math.exp(-b)
        if u is None and v is None:
            continue
        if u is None or v is None:
            own, w = (zb, v) if u is None else (za, u)
            out += math.log(stay * own if w == 0 else 1 - stay * own)
        elif u == v and u > 0:
            out += math.log(q[s, u] * (1 - stay) + q[s, u] ** 2 * stay * (1 - za) * (1 - zb))
        else:
            out += math.log(stay * (za if u == 0 else 1 - za) * (zb if v == 0 else 1 - zb))
    return out


def test_likeliest_branches(spark):
    rng = random.Random(2)
    q = {(s, k): (k + s % 3) / 20 for s in range(30) for k in (1, 2, 3)}
    cells = {c: [rng.choice([0, 0, 1, 1, 2, 3, None]) for _ in range(30)] for c in range(4)}
    cells[9] = list(cells[0])
    rows = spark.createDataFrame([(c, s, x) for c, xs in cells.items() for s, x in enumerate(xs)], LONG)
    prior = spark.createDataFrame([(s, k, p) for (s, k), p in q.items()], "site int, state int, q double")
    got = {(r.a, r.b): r for r in triplets.pairwise_branches(triplets.pair_classes(rows, prior), rounds=400).collect()}
    assert set(got) == set(itertools.combinations(sorted(cells), 2))
    low, high = -math.log(1 - 1 / 30) / 2, 2 * math.log(30)
    grid = np.exp(np.linspace(math.log(low), math.log(high), 24))
    for (a, b), r in got.items():
        found = (r.d_a, r.d_b, r.d_r)
        assert all(low - 1e-9 <= x <= high + 1e-9 for x in found)
        # what is given for missing states and the choice of different mutations is the same for all branches
        assert abs(_llh(cells[a], cells[b], q, found) - r.llh) < 1e-6
        best = max(_llh(cells[a], cells[b], q, d) for d in itertools.product(grid, repeat=3))
        assert r.llh > best - 0.02


def test_pairs_without_a_fit(spark):
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], LONG)
    prior = spark.createDataFrame([(0, 1, 0.5)], "site int, state int, q double")
    assert triplets.pairwise_branches(triplets.pair_classes(rows, prior)).count() == 0
    gone = spark.createDataFrame([(c, s, None) for c in (1, 2) for s in range(3)], LONG)
    got = triplets.pairwise_branches(triplets.pair_classes(gone, prior)).first()
    assert got.llh == 0.0


def test_triplets(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (2, 3, 0.5), (1, 4, 0.9), (2, 4, 0.9), (3, 4, 0.1)], "a long, b long, d_r double")
    triples = spark.createDataFrame([(1, 2, 3, "u"), (2, 1, 3, "v"), (1, 2, 4, "w"), (3, 4, 1, "x"), (1, 2, 5, "y")], "a long, b long, c long, note string")
    got = {r.note: r.topology for r in triplets.triplet_topologies(pairs, triples).collect()}
    # of equal ones b and c come first, and a triple with an unknown cell has none
    assert got == {"u": 2, "v": 1, "w": 1, "x": 1, "y": None}


def test_heat_maps(spark):
    names = "cellBC string, intBC string, r1 string, r2 string, r3 string, UMI string, lineageGrp int"
    rows = [("A", "X", "None", "2D", "3I", "u", 1), ("A", "X", "2D", "2D", None, "v", 1), ("A", "Y", "None", "None", "None", "w", 1), ("B", "Y", "1I", "None", "None", "x", 1), ("C", "X", "None", "None", "None", "y", 2)]
    alleles = spark.createDataFrame(rows, names)
    got = {(r.cellBC, r.row, r.n_umis, r.intBC, r.col, r.site): round(r.code, 6) for r in heatmaps.allele_heatmap(alleles).collect()}
    assert len(got) == 9 and got["A", 2, 3, "X", 1, "s1"] == 1.4 and got["B", 1, 1, "Y", 2, "s1"] == 2.9 and got["A", 2, 3, "X", 1, "s3"] == 1.45
    over = {(r.cellBC, r.intBC, r.lineageGrp, r.col) for r in heatmaps.barcode_overlap(alleles).collect()}
    assert over == {("A", "X", 1, 1), ("C", "X", 1, 1), ("A", "Y", 1, 2), ("B", "Y", 1, 2), ("A", "X", 2, 3), ("C", "X", 2, 3)}
    n = {(r.lineageGrp, r.intBC, r.site): r.n for r in heatmaps.distinct_alleles(alleles).collect()}
    assert n[1, "X", "r1"] == 2 and n[1, "X", "r3"] == 1 and n[2, "X", "r3"] == 1
    assert heatmaps.allele_heatmap(alleles.filter(F.lit(False))).count() == 0


def test_pairs_of_equal_classes_are_fitted_once(spark, monkeypatch):
    rows = spark.createDataFrame([(c, s, (0, 1, 2)[s % 3]) for c in range(12) for s in range(6)], LONG)
    prior = spark.createDataFrame([(s, k, 0.25) for s in range(6) for k in (1, 2)], "site int, state int, q double")
    classes = triplets.pair_classes(rows, prior).toPandas()
    sizes = []
    fitted = triplets.fitted_branches
    monkeypatch.setattr(triplets, "fitted_branches", lambda counts, *rest: sizes.append(len(counts["zz"])) or fitted(counts, *rest))
    run = {}
    spread = spark.createDataFrame(classes)
    monkeypatch.setattr(type(spread), "mapInPandas", lambda self, f, schema: run.setdefault("f", f))
    triplets.pairwise_branches(spread)
    got = next(run["f"](iter([classes])))
    assert len(got) == 66 and sizes == [1] and got[["d_a", "d_b", "d_r", "llh"]].drop_duplicates().shape[0] == 1


def test_branches_fitted_where_pairs_meet_are_those_of_their_classes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(d, 10 * d + c, s, [None, 0, 1, 2, 2, 5][int(rng.integers(6))]) for d in range(3) for c in range(6) for s in range(9) if rng.random() > 0.2] + [(4, 1, 0, 1), (4, 2, 0, 1)]
    cells = spark.createDataFrame(rows, "dataset int, cell long, site int, state int")
    prior = spark.createDataFrame([(s, v, v / 10 + s / 100) for s in range(9) for v in (1, 2)], "site int, state int, q double")
    key = lambda df: sorted((r.dataset, r.a, r.b, *(round(r[c], 9) for c in ("d_a", "d_b", "d_r", "llh"))) for r in df.collect())
    want = key(triplets.pairwise_branches(triplets.pair_classes(cells, prior, ("dataset",)), ("dataset",), 30))
    assert len(want) == 45
    for few in (64, 0):
        monkeypatch.setattr(triplets, "FEW", few)
        got = triplets.cell_branches(cells, prior, ("dataset",), 30)
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
        assert key(got) == want
