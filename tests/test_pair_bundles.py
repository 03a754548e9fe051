"""Pairs of cells in bundles: pieces, wide and uneven rows and nulls change no result, and bundles are made once."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cladewright.operators import distances, pairs

LONG = "dataset int, cell long, site int, state int"


def _rows(cells, sites, seed=5, whole=False):
    """Cells of data sets of 0 to 3 with sites that others lack, two rows at a site here and there, and null keys."""
    rng = random.Random(seed)
    rows = [(c % 4 if c % 3 else 0, c, s, rng.choice([0, 1, 2, -1, None])) for c in range(cells) for s in range(sites) for _ in range(1 if whole else rng.choice([0, 1, 1, 1, 2]))]
    return rows + [(None, 1, 0, 1), (None, 2, 0, 1), (0, None, 0, 1), (0, 3, None, 1)]


def _brute(rows, by=True):
    cells = {}
    for d, c, s, v in rows:
        if None not in (d if by else 0, c, s):
            cells.setdefault((d if by else 0, c), []).append((s, v))
    out = {}
    for (x, u), (y, v) in itertools.combinations(sorted(cells.items(), key=lambda e: e[0][1]), 2):
        both = [(p, q) for s, p in u for t, q in v if s == t]
        if x[0] == y[0] and both:
            out[x[1], y[1]] = both
    return out


def _counts(both):
    kinds = [
        lambda x, y: x == 0 and y == 0, lambda x, y: x == 0 and y is not None and y > 0, lambda x, y: x is not None and x > 0 and y == 0,
        lambda x, y: x is not None and x > 0 and x == y, lambda x, y: None not in (x, y) and x > 0 and y > 0 and x != y,
        lambda x, y: x is None and y is not None, lambda x, y: x is not None and y is None, lambda x, y: x is None and y is None,
    ]
    return tuple(sum(k(x, y) for x, y in both) for k in kinds)


@pytest.mark.parametrize(("cells", "sites", "whole"), [(40, 6, False), (40, 6, True), (6, 300, True)])
def test_counts_are_those_of_a_join_by_site(spark, monkeypatch, cells, sites, whole):
    rows = _rows(cells, sites, whole=whole)
    table = spark.createDataFrame(rows, LONG).repartition(3)
    for by in (("dataset",), ()):
        want = {k: _counts(v) for k, v in _brute(rows, bool(by)).items()}
        for piece, step, most in ((1024, 1 << 17, 1 << 20), (4, 16, 50)):
            for name, value in (("STEP", step), ("SITES", most)):
                monkeypatch.setattr(pairs, name, value)
            monkeypatch.setattr(pairs.pair_results, "__defaults__", ((), piece))
            got = distances.pair_counts(table, by).collect()
            assert len(got) == len(want)
            assert {(r.a, r.b): tuple(r)[2:] for r in got} == want


def test_distance_and_consensus(spark):
    rows = _rows(30, 5)
    table, want = spark.createDataFrame(rows, LONG), _brute(rows)
    cost = lambda x, y: 0 if x == y else 1 if 0 in (x, y) else 2
    got = {(r.a, r.b): r.d for r in distances.weighted_hamming(table, by=("dataset",)).collect()}
    known = {k: [cost(x, y) for x, y in v if None not in (x, y)] for k, v in want.items()}
    assert got == pytest.approx({k: sum(v) / len(v) if v else 0.0 for k, v in known.items()})
    once = [r for i, r in enumerate(rows) if r[:3] not in {x[:3] for x in rows[:i]}]
    shared = lambda x, y: x if x == y or y is None else y if x is None else 0
    got = distances.pair_consensus(spark.createDataFrame(once, LONG), ("dataset",)).collect()
    of = {c: d for d, c, _, _ in once if None not in (d, c)}
    want = {k: ([shared(x, y) for x, y in v], sum((c is not None) & (c != shared(x, y)) for x, y in v for c in (x, y))) for k, v in _brute(once).items()}
    assert {(r.a, r.b): (r.consensus, r.d) for r in got} == want
    assert all(r.dataset == of[r.a] for r in got)


def test_bundles_are_made_once_and_no_site_is_grouped(spark):
    table = spark.createDataFrame(_rows(40, 4), LONG).repartition(4).checkpoint()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = distances.pair_counts(table, ("dataset",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "collect_list" not in plan and "zip_with" not in plan
    assert plan.count("ReusedExchange") == 1 and plan.count("MapInArrow") == 2


def test_empty(spark):
    assert distances.pair_counts(spark.createDataFrame([], LONG), ("dataset",)).filter(F.col("a").isNotNull()).count() == 0
