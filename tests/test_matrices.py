"""Matrices of allele tables by hand."""

import pytest

from cladewright.operators import characters

NAMES = "cellBC string, intBC string, r1 string, r2 string"
ROWS = [("A", "X", "2D", "None"), ("A", "X", "1I", "None"), ("A", "X", "2D", "gap"), ("B", "X", "1I", None), ("B", "Y", "3D", "NONE"), ("C", "Z", "9I", "9I"), ("D", None, "1I", "1I")]


def _matrix(spark, rows, collapse=True, ignored=("Z",), most=1.0):
    alleles = spark.createDataFrame(rows, NAMES)
    skip = spark.createDataFrame([(x,) for x in ignored], "intBC string")
    given = spark.createDataFrame([("2D", 0.2), ("2D", 0.4), ("1I", 0.1)], "indel string, freq double")
    states = characters.matrix_states(alleles, skip, most, "gap", given, ("r1", "r2"))
    return states.collect(), {r.cellBC: r.row for r in characters.matrix_rows(alleles, states, skip, most, "gap", ("r1", "r2"), collapse).collect()}


def test_states_and_rows(spark):
    states, rows = _matrix(spark, ROWS)
    got = {(r.character, r.column, r.state, r.indel): r.q for r in states}
    assert got == {("Xr1", 1, 1, "1I"): 0.1, ("Xr1", 1, 2, "2D"): pytest.approx(0.3), ("Xr2", 2, None, None): None, ("Yr1", 3, 1, "3D"): None, ("Yr2", 4, None, None): None}
    # C has only an ignored barcode, D none
    assert rows == {"A": [[1, 2], [-1, 0], [-1], [-1]], "B": [[1], [-1], [1], [0]]}


def test_repeats_and_diversity(spark):
    assert _matrix(spark, ROWS, collapse=False)[1]["A"] == [[1, 2, 2], [-1, 0, 0], [-1], [-1]]
    # of Xr1 two of three (cell, allele) rows are 1I; of Xr2 all three differ; Yr1 and Yr2 have one row
    assert {r.character for r in _matrix(spark, ROWS, most=0.7)[0]} == {"Xr1", "Xr2"}
    assert {r.character for r in _matrix(spark, ROWS, most=0.5)[0]} == {"Xr2"}


def test_empty(spark):
    assert _matrix(spark, []) == ([], {})


def test_present_sites(spark):
    cells = spark.createDataFrame([("a", 1, 0), ("b", 1, None), ("a", 2, None), ("b", 2, None)], "cell string, site int, state int")
    given = spark.createDataFrame([(1, 3, 1.0), (2, 4, 1.0)], "site int, state int, q double")
    kept, priors = characters.present_sites(cells, given)
    assert {r.site for r in kept.collect()} == {1} and kept.count() == 2 and [r.site for r in priors.collect()] == [1]
