"""Operators that read their input several times make it once."""

import pytest

from cladewright.operators import characters, molecules, results, stages
from cladewright.operators.stored import stored

SCHEMA = "cellBC string, intBC string, UMI string, readCount long, allele string, r1 string, r2 string, r3 string"


@pytest.fixture
def counted(spark):
    """A table of 3 x 6 x 4 molecules and a counter of the times that a row of it was made."""
    made = spark.sparkContext.accumulator(0)

    def seen(row):
        made.add(1)
        return row

    umis = ("AAAA", "AAAC", "AACC", "GGTT")
    rows = [(f"c{g}{k}", f"{'ACG'[g]}{b}", u, 20 + i, "x", "n", "n", "n") for g in range(3) for k in range(2) for b in "ACG" for i, u in enumerate(umis)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), SCHEMA), made, len(rows)


def test_umis_are_corrected_from_one_reading(spark, counted):
    table, made, n = counted
    for by_allele in (False, True):
        before = made.value
        got = molecules.correct_umis(table, 1, by_allele=by_allele).collect()
        assert made.value - before == n
        # AAAA, the least, goes to AAAC and that to AACC
        assert sorted((r.UMI, r.readCount) for r in got) == sorted([("AACC", 63), ("GGTT", 23)] * (n // 4))


def test_rows_without_a_count_or_a_key(spark):
    rows = [("c", "b", "AAAA", None), ("c", "b", "AAAC", 2), ("c", "b", "GGGG", None), ("c", None, "AAAA", 3), (None, "b", "AAAA", 3), ("c", "b", None, 4)]
    got = molecules.correct_umis(spark.createDataFrame(rows, "cellBC string, intBC string, UMI string, readCount long"), 1).collect()
    assert sorted((r.UMI, r.readCount) for r in got) == [("AAAC", 2), ("GGGG", None)]


def test_stages_read_their_input_once(spark, counted):
    table, made, n = counted
    stages.run_stages(table, "[filter_molecules]\nmin_umis = 2\ndoublets = 0.9\n[call_lineages]\nmin_umis = 2\ninter = 0.05\n").count()
    assert made.value == n


def test_groups_are_refined_from_two_readings(spark, counted):
    table, made, n = counted
    groups = spark.createDataFrame([(f"c{g}{k}", g + 1) for g in range(3) for k in range(2)], "cell string, lineageGrp int")
    got = stages.refine_lineage_groups(table, groups, 2, 1.0, 0.05, 0.1).collect()
    assert made.value <= 2 * n and len({(r.cellBC, r.lineageGrp) for r in got}) == 6


def test_stored_rows_are_the_same(spark):
    df = spark.createDataFrame([("a", [1, None]), (None, None)], "x string, y array<int>")
    assert sorted(map(str, stored(df).collect())) == sorted(map(str, df.collect()))


def test_lines_of_solvers_are_read_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(row):
        made.add(1)
        return row

    text = "Current {}_solver score: -{}.5, 0.1, 0.2, 1.25 seconds"
    rows = [("f", 0, i, text.format("oldEM" if i % 2 else "fastEM", 5 + i)) for i in range(8)] + [("f", 0, 8, "other")]
    lines = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "file string, block long, line long, value string")
    (got,) = results.solver_differences(lines).collect()
    assert made.value == len(rows) and (got.n_pairs, got.llh, got.second_seconds) == (4, -1.0, 1.25)


def test_matrix_rows_read_alleles_once(spark, counted):
    table, made, n = counted
    states = spark.createDataFrame([(f"{g}{b}r1", i + 1, "n", 1) for i, (g, b) in enumerate((g, b) for g in "ACG" for b in "ACG")], "character string, column long, indel string, state int")
    got = characters.matrix_rows(table, states).collect()
    assert made.value == n and len(got) == 6 and all(len(r.row) == 9 and sum(x == [1] for x in r.row) == 3 for r in got)
