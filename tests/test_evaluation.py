"""Scores of sequences and annotations by hand."""

import pytest
from pyspark.sql import functions as F

from cladewright.operators import evaluation
from cladewright.sources import lines


def test_scores(spark):
    truth = spark.createDataFrame([("a", 0, "0"), ("a", 1, "d"), ("a", 2, "s"), ("a", 3, "4"), ("b", 0, "1"), ("c", 0, "1"), ("only", 0, "1")], "label string, site int, state string")
    probs = [("a", 0, {"0": 0.25, "3": 0.75}), ("a", 1, {"-1": 0.4, "2": 0.6}), ("a", 2, {"-1": 0.9, "0": 0.1}), ("a", 3, None), ("b", 0, None), ("c", 0, {"2": 1.0})]
    estimates = spark.createDataFrame(probs, "label string, site int, probs map<string,double>")
    got = {r.label: (r.score, r.n_sites) for r in evaluation.score_sequences(truth, estimates).collect()}
    assert got == {"a": (pytest.approx((0.25 + 0.6 + 0.9) / 3), 3), "b": (None, 0), "c": (0.0, 1)}
    hard = {r.label: r.score for r in evaluation.score_sequences(truth, estimates, soft=False).collect()}
    assert hard == {"a": pytest.approx((0 + 1 + 1) / 3), "b": None, "c": 0.0}


def test_annotations_are_read_back(spark, tmp_path):
    rows = [(0, 1, 0, 0.999, 0.001, [0.0, 0.0]), (0, 1, 1, 0.125, 0.0, [0.8746, 0.0004]), (0, 2, 0, 0.0, 1.0, [0.0, 0.0]), (0, 2, 1, 0.02, 0.01, [0.0, 0.97])]
    posteriors = spark.createDataFrame(rows, "root long, node long, site int, p_zero double, p_silent double, p_mutated array<double>")
    priors = spark.createDataFrame([(s, k, 0.5) for s in (0, 1) for k in (5, 7)], "site int, state int, q double")
    found = {r.node: r.line for r in evaluation.annotation_lines(posteriors, priors).collect()}
    assert found == {1: "1,0,0:0.12/5:0.875", 2: "2,-1,0:0.02/-1:0.01/7:0.97"}
    (tmp_path / "a.txt").write_text("(1,2)0;\n" + "".join(x + "\n" for x in found.values()))
    states = lines.read_annotation(spark, str(tmp_path / "a.txt"))[1]
    got = {(r.label, r.site): r.p for r in states.select("label", "site", F.col("probs")["0"].alias("p")).collect()}
    assert got == {("1", 0): 1.0, ("1", 1): 0.12, ("2", 0): None, ("2", 1): 0.02}
