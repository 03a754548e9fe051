"""Readers of numbered lines give the same rows whatever the splits."""

import contextlib
import random

import pytest
from pyspark.errors import PySparkException

from cladewright.sources import lines


@contextlib.contextmanager
def splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(map(str, df.collect()))


def test_lines_are_numbered_in_each_file(spark, tmp_path):
    texts = {"a.txt": [f"line {i} {'x' * (i % 40)}" for i in range(700)], "b.txt": ["only"], "c.txt": [], "d.txt": [str(i) for i in range(300)]}
    for name, text in texts.items():
        (tmp_path / name).write_text("".join(t + "\n" for t in text))
    want = sorted((name, i, t) for name, text in texts.items() for i, t in enumerate(text))
    for size in (1 << 27, 1000, 97):
        with splits(spark, size):
            df = lines.numbered_lines(spark, str(tmp_path))
            found = df.collect()
            assert sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in found) == want
            assert size > 1000 or len({(r.file, r.block) for r in found}) > 5
            ends = lines.counted_before(df, df["value"].endswith("7"), "n").collect()
    for name, text in texts.items():
        counts, n = [], 0
        for t in text:
            counts.append(n)
            n += t.endswith("7")
        assert [r.n for r in sorted((e for e in ends if e.file.endswith(name)), key=lambda r: r.line)] == counts


def test_fastq_pairs_are_the_same_for_any_split(spark, tmp_path):
    rng = random.Random(2)
    word = lambda k, letters="ACGT": "".join(rng.choice(letters) for _ in range(k))
    reads = [(f"read{i}", word(28), word(28, "@+I5#"), word(rng.randint(1, 60))) for i in range(400)]
    (tmp_path / "r1.fastq").write_text("".join(f"@{n}/1 more\n{a}\n+\n{q}\n" for n, a, q, _ in reads))
    (tmp_path / "r2.fastq").write_text("".join(f"@{n}/2\n{b}\n+{n}\n{'@' * len(b)}\n" for n, _, _, b in reads) + "@last/2\nAC\n+\n")
    layout = {"cell": (1, 0, 16), "umi": (1, 16, None), "seq": (2, 2, None)}
    want = sorted((n, a[:16], q[:16], a[16:], q[16:], b[2:], "@" * len(b[2:])) for n, a, q, b in reads)
    for size in (1 << 27, 5000, 333):
        with splits(spark, size):
            df = lines.read_fastq_pairs(spark, str(tmp_path / "r1.fastq"), str(tmp_path / "r2.fastq"), layout)
            assert df.columns == ["readName", "cell", "cell_qual", "umi", "umi_qual", "seq", "qual"]
            assert sorted(tuple(r) for r in df.collect()) == want
            single = lines.read_fastq(spark, str(tmp_path / "r1.fastq"))
            assert sorted(tuple(r) for r in single.collect()) == sorted((n + "/1", a, q) for n, a, q, _ in reads)
    (tmp_path / "r3.fastq").write_text("@other\nAC\n+\nII\n")
    with pytest.raises(PySparkException, match="out of step"):
        lines.read_fastq_pairs(spark, str(tmp_path / "r1.fastq"), str(tmp_path / "r3.fastq"), layout).collect()


def test_record_sets_end_with_a_mark(spark, tmp_path):
    sets = [{f"n{i}": [s, i, -1] for i in range(30)} for s in range(4)]
    text = "".join("".join(f">{n}\n{'|'.join(map(str, v))}\n" for n, v in d.items()) + "_____\n" for d in sets)
    (tmp_path / "s.txt").write_text("1|2|3\n" + text.replace("_____\n", ">n0\n9|9|9\n_____\n", 1) + "\n>late\n5|5|5\n")
    want = sorted((k, n, v) for k, d in enumerate(sets) for n, v in d.items() if (k, n) != (0, "n0")) + [(0, "n0", [9, 9, 9])]
    for size in (1 << 27, 60):
        with splits(spark, size):
            got = lines.read_record_sets(spark, str(tmp_path / "s.txt")).collect()
            assert sorted((r.set, r.name, list(r.states)) for r in got) == sorted(want)


def test_annotations_and_truths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("((a:1,b:1)I1:0.5)I0;\nI1,0,0:0.25/3:0.75\na,?,-1\n\n")
    trees, states = lines.read_annotation(spark, str(tmp_path / "a.txt"))
    assert trees.first().newick == "((a:1,b:1)I1:0.5)I0;"
    got = {(r.label, r.site): r.probs for r in states.collect()}
    assert got == {("I1", 0): {"0": 1.0}, ("I1", 1): {"0": 0.25, "3": 0.75}, ("a", 0): None, ("a", 1): {"-1": 1.0}}
    (tmp_path / "t.txt").write_text("node,c0,c1\nI0,0,0\na,d,2\nEvolve tree:(a:0.1)I0;\nafter,1,1\n")
    trees, states = lines.read_ground_truth(spark, str(tmp_path / "t.txt"))
    assert trees.first().newick == "(a:0.1)I0;"
    assert sorted((r.label, r.site, r.state) for r in states.collect()) == [("I0", 0, "0"), ("I0", 1, "0"), ("a", 0, "d"), ("a", 1, "2")]
