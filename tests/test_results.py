"""Priors brought to sites, and files of results and logs."""

import pytest

from cladewright.operators import priors, results
from cladewright.sources.lines import numbered_lines


def _keys(spark, keys, names):
    given = spark.createDataFrame([(k, 1, 1.0) for k in keys], "key int, state int, q double")
    sites = spark.createDataFrame(list(enumerate(names)), "site int, site_name string")
    return [r.key for r in priors.prior_keys(given, sites).sort("site").collect()]


def test_keys_of_sites(spark):
    assert _keys(spark, [30, 10, 20], ["r1", "x", "r7"]) == [10, 20, 30]
    assert _keys(spark, [1, 2, 5, 9], ["r5", "r1"]) == [5, 1]
    assert _keys(spark, [1, 2, 3, 4], ["r11", "r12", "r15"]) == [1, 2, None]
    assert _keys(spark, [1, 2, 3], ["r4", "none"]) == [1, None]
    assert _keys(spark, [], ["r4", "r5"]) == [None, None]


def test_missing_priors_are_uniform(spark):
    given = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.7), (1, 4, 0.3)], "key int, state int, q double")
    sites = spark.createDataFrame([(0, "r1"), (1, "r2"), (2, "r3")], "site int, site_name string")
    cells = spark.createDataFrame([("a", 1, 5), ("b", 1, 7), ("c", 1, 0), ("d", 1, None), ("a", 2, 0)], "cell string, site int, state int")
    got = {tuple(r) for r in priors.reconciled_priors(given, sites, cells).collect()}
    assert got == {(0, 3, 0.7), (0, 4, 0.3), (1, 5, 0.5), (1, 7, 0.5), (2, 1, 1.0)}


def test_result_files(spark, tmp_path):
    (tmp_path / "r1_nm.txt").write_text("Optimal tree: (a:1,b:2);\nOptimal negative-llh: 10.5\nx\nOptimal negative-llh: 9.25\nOptimal dropout rate: 0.1\nOptimal silencing rate: none\n")
    (tmp_path / "r1_ns.txt").write_text("Optimal dropout rate: 1e-3\n")
    (tmp_path / "r1_zz.txt").write_text("Optimal dropout rate: 0.4\n")
    got = {(r.rep_name, r.flag): (r.tree, r.llh, r.dropout, r.silencing) for r in results.compile_results(spark, str(tmp_path)).collect()}
    assert got == {("r1", "nm"): ("(a:1,b:2);", 9.25, 0.1, None), ("r1", "ns"): (None, None, 0.001, None)}


def test_search_logs(spark, tmp_path):
    steps = "Number of trees checked: 4\n", "NNI Iter: 1\nNumber of trees checked: 6\nCurrent score: -3.5\nRuntime (s): 2.5\nRuntime (s): 3.5\n", "NNI Iter: 2\nNNI Iter: 3\nRuntime (s): 1.5\n"
    (tmp_path / "a.log").write_text("".join(steps) + "Optimal score for this search: -3.25\n")
    (tmp_path / "b.log").write_text("nothing\n")
    got = {r.file.rsplit("/", 1)[1]: tuple(r)[1:] for r in results.search_statistics(numbered_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.log": (3, 10, pytest.approx(0.5), 5.0, -3.25), "b.log": (0, None, 0.0, None, None)}


def test_solver_logs(spark, tmp_path):
    line = "Current {}_solver score: {}, {}, {}, {} seconds\n"
    rows = [("oldEM", -10.0, 0.1, 0.2, "3.0"), ("fastEM", -9.0, 0.1, 0.3, "1.0"), ("oldEM", -8.0, 0.3, 0.2, "5.0"), ("otherEM", 1.0, 1.0, 1.0, "1.0"), ("fastEM", -8.5, 0.2, 0.2, "0.5"), ("oldEM", -7.0, 0.3, 0.2, "1.0")]
    (tmp_path / "a.log").write_text("x\n".join(line.format(*r) for r in rows))
    r = results.solver_differences(numbered_lines(spark, str(tmp_path / "a.log"))).first()
    assert tuple(r)[1:] == (2, pytest.approx(-0.25), pytest.approx(0.05), pytest.approx(-0.05), pytest.approx(3.0), pytest.approx(0.75))
