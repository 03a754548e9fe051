"""Pairs of cells: the shuffle carries cells and no pairs, and pieces, missing rows and repeated rows change no result."""

import itertools
import random

from pyspark.sql import functions as F

from cladewright.operators import distances

LONG = "dataset int, cell long, site int, state int"


def _rows(seed=3):
    """Cells with sites that others lack, and with two rows at a site here and there."""
    rng = random.Random(seed)
    return [(c % 2, c, s, rng.choice([0, 1, 2, None])) for c in range(24) for s in range(6) if rng.random() < 0.8 for _ in range(rng.choice([1, 1, 1, 2]))]


def _sites(rows, a, b):
    return [(x[3], y[3]) for x in rows for y in rows if x[:2] == a and y[:2] == b and x[2] == y[2]]


def test_pairs_are_those_of_a_join_by_site(spark):
    rows = _rows()
    table = spark.createDataFrame(rows, LONG)
    order = lambda v: sorted(v, key=str)
    for by in (("dataset",), ()):
        cells = sorted({r[:2] for r in rows}, key=lambda c: c[1])
        want = {(a[1], b[1]): order(_sites(rows, a, b)) for a, b in itertools.combinations(cells, 2) if not by or a[0] == b[0]}
        want = {k: v for k, v in want.items() if v}
        for piece in (1024, 5):
            pairs = distances.cell_pairs(table, by, F.col("state"), F.col("state"), piece).collect()
            assert len(pairs) == len(want)
            assert {(r.a, r.b): order(zip(r.x, r.y, strict=True)) for r in pairs} == want


def test_weights_count_by_site(spark):
    rows = [(0, c, s, (0, 1, 2, None)[(c * s + c) % 4]) for c in range(4) for s in range(5)]
    weights = spark.createDataFrame([(s, s + 0.5) for s in range(5)], "site int, weight double")
    got = {(r.a, r.b): r.d for r in distances.weighted_hamming(spark.createDataFrame(rows, LONG), weights, ("dataset",)).collect()}
    state = {r[1:3]: r[3] for r in rows}
    for a, b in itertools.combinations(range(4), 2):
        known = [s for s in range(5) if state[a, s] is not None and state[b, s] is not None]
        want = sum((s + 0.5) * (state[a, s] != state[b, s]) * (2 if state[a, s] and state[b, s] else 1) for s in known) / len(known) if known else 0.0
        assert abs(got[a, b] - want) < 1e-12


def test_no_pairs_in_the_shuffle(spark):
    rows = [(0, c, s, (c * s) % 3) for c in range(200) for s in range(4)]
    table = spark.createDataFrame(rows, LONG).repartition(4).checkpoint()
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = distances.pair_counts(table, ("dataset",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    # above the join that makes the pairs nothing is shuffled or aggregated
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Aggregate" not in above
