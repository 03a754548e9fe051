"""Trees worked out in bundles against the same by joins, and what is shuffled for them."""

import functools
import math

import numpy as np
import pytest

from cladewright.operators import bundles, distances, evaluation, likelihood
from cladewright.operators.stored import stored

TREE = "dataset int, node long, parent long, brlen double, is_leaf boolean"
SETS = ("dataset",)
FOUND = {}


@pytest.fixture(scope="module")
def forest(spark):
    """Trees of any shape, two in one set, leaves with some sites and states missing, and one without leaves' states."""
    rng = np.random.default_rng(3)
    rows, cells, base = [], [], 1
    for k in range(9):
        size = int(rng.integers(1, 14))
        parent = [-1] + [int(rng.integers(i // 4, max(i // 2, i // 4 + 1))) for i in range(1, size)]
        name = rng.permutation(size) + base
        base += size + 5
        inner = set(parent)
        for i, p in enumerate(parent):
            rows.append((k // 2 if k < 4 else k, int(name[i]), int(name[p]) if p >= 0 else None, float(rng.integers(1, 12)) / 20, i not in inner))
            if i not in inner and k != 7:
                for site in rng.permutation(9)[: 1 + k % 7].tolist():
                    cells.append((rows[-1][0], int(name[i]), site, [None, 0, 1, 1, 2, 7][int(rng.integers(6))]))
    priors = [(s, v, q) for s in range(8) for v, q in ((1, 0.5), (2, 0.3), (7, 0.2))[: 2 + s % 2]]
    tables = (rows, TREE), (cells, "dataset int, node long, site int, state int"), (priors, "site int, state int, q double")
    return [stored(spark.createDataFrame(*t)) for t in tables]


def rows_of(df):
    def plain(x):
        return round(x, 9) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else x

    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def close(a, b):
    return all(math.isclose(x, y, abs_tol=1e-8) if isinstance(x, float) else close(x, y) if isinstance(x, tuple) else x == y for x, y in zip(a, b, strict=True))


def case(name, t, v, p):
    """The same table from bundles, given by, and from joins."""
    states = lambda: distances._states_joined(t, v)
    below = functools.cache(lambda: FOUND.get("below") or FOUND.setdefault("below", stored(likelihood.outside_joined(t, v, p, 0.1, 0.05))))
    made, joined = {
        "states": (lambda by: distances.ancestral_states(t, v, by), states),
        "changes": (lambda by: distances.small_parsimony(t, v, p, by), lambda: distances._moves_joined(t, v, p)),
        "scores": (lambda by: distances.parsimony_scores(t, v, None, by), lambda: distances._scores_joined(t, v, None)),
        "mutations": (lambda by: distances.site_mutations(t, v, by), lambda: distances._mutations_joined(t, states())),
        "coupled": (lambda by: distances.coupled_leaves(t, v, by), lambda: distances._coupled_joined(t, states())),
        "posteriors": (lambda by: likelihood.outside_pass(t, v, p, 0.1, 0.05, by), below),
        "transitions": (lambda by: likelihood.tree_transitions(t, v, p, 0.1, 0.05, by), lambda: likelihood.expected_transitions(below())),
        "lines": (lambda by: evaluation.tree_annotations(t, v, p, 0.1, 0.05, by), lambda: evaluation.annotation_lines(below(), p)),
    }[name]
    return made, rows_of(joined())


NAMES = ("states", "changes", "scores", "mutations", "coupled", "posteriors", "transitions", "lines")


@pytest.mark.parametrize("name", NAMES)
def test_bundles_and_joins_give_the_same_rows(spark, forest, name, monkeypatch):
    made, want = case(name, *forest)
    assert len(want) > 5
    got = made(SETS)
    # one shuffle of nodes and states, whatever the trees' depth
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    monkeypatch.setattr(bundles, "CELLS", 40)
    monkeypatch.setattr(bundles, "STEP", 50)
    for found in (got, made(())):
        found = rows_of(found)
        assert len(found) == len(want) and all(close(a, b) for a, b in zip(found, want, strict=True))


@pytest.mark.parametrize("name", ("changes", "coupled"))
def test_large_sets_are_left_to_joins(spark, forest, name, monkeypatch):
    made, want = case(name, *forest)
    monkeypatch.setattr(bundles, "LARGE", 30)
    monkeypatch.setattr(distances, "LARGE_PAIRS", 30)
    found = rows_of(made(SETS))
    assert len(found) == len(want) and all(close(a, b) for a, b in zip(found, want, strict=True))


def test_parents_without_a_row_are_roots(spark):
    rows = [(0, 2, 1, 1.0, True), (0, 3, 1, 1.0, False), (0, 4, 3, 1.0, True)]
    cells = [(0, 2, 0, 5), (0, 4, 0, None)]
    t, v = spark.createDataFrame(rows, TREE), spark.createDataFrame(cells, "dataset int, node long, site int, state int")
    assert sorted(map(tuple, distances.ancestral_states(t, v, SETS).collect())) == [(2, 0, 5), (3, 0, 5), (4, 0, 5)]
    assert [tuple(r) for r in distances.small_parsimony(t, v, None, SETS).collect()] == [(1, 0, 2, 2.0)]
    assert distances.site_mutations(t, v, SETS).count() == 0


def test_circles_are_told(spark):
    t = spark.createDataFrame([(0, 1, 2, 1.0, False), (0, 2, 1, 1.0, False)], TREE)
    v = spark.createDataFrame([(0, 1, 0, 1)], "dataset int, node long, site int, state int")
    with pytest.raises(Exception, match="circle"):
        distances.ancestral_states(t, v, SETS).collect()
