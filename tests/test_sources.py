import random

import pytest

from cladewright.operators import alleles, lineages, molecules, stages
from cladewright.sources import lines, matrices


def test_matrix_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cell_name,c1,c2,c3\nx,0,1,?\ny,-1,12,-\nz,-5,D,0\n")
    df = matrices.read_matrix(spark, str(tmp_path / "m.csv"))
    got = {(r.cell, r.site): (r.state, r.miss) for r in df.collect()}
    assert got == {("x", 0): (0, None), ("x", 1): (1, None), ("x", 2): (None, "?"), ("y", 0): (None, "-1"), ("y", 1): (12, None), ("y", 2): (None, "?"), ("z", 0): (None, "?"), ("z", 1): (None, "?"), ("z", 2): (0, None)}
    matrices.write_matrix(df, str(tmp_path / "out"), [0, 1, 2])
    again = matrices.read_matrix(spark, str(tmp_path / "out"))
    assert {(r.cell, r.site): r.state for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_priors_keep_their_order(spark, tmp_path):
    (tmp_path / "p.csv").write_text("character,state,freq\nc5,1,0.25\nc5,2,0.75\nc1,1,1.0\n")
    got = sorted((r.site, r.site_name, r.state, r.q) for r in matrices.read_priors(spark, str(tmp_path / "p.csv")).collect())
    assert got == [(0, "c5", 1, 0.25), (0, "c5", 2, 0.75), (1, "c1", 1, 1.0)]


def test_text_reads(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@I\n")
    assert sorted((r.readName, r.seq, r.qual) for r in lines.read_fastq(spark, str(tmp_path / "r.fastq")).collect()) == [("r1", "ACGT", "IIII"), ("r2", "GG", "@I")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nC_U_7_f\t0\tr\t1\t9\t4M\t*\t0\t0\tACGT\tIIII\tCB:Z:xx\tAS:i:3\n")
    r = matrices.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (r.cellBC, r.UMI, r.readCount, r.CIGAR, r.tags["CB"]) == ("C", "U", 7, "4M", "xx")


def test_umi_chains_reach_their_root(spark):
    rows = [("c", "b", "AAAA", 9), ("c", "b", "AAAT", 5), ("c", "b", "AATT", 3), ("c", "b", "GGGG", 2)]
    df = spark.createDataFrame(rows, "cellBC string, intBC string, UMI string, readCount long")
    assert sorted((r.UMI, r.readCount) for r in molecules.correct_umis(df, 1).collect()) == [("AAAA", 17), ("GGGG", 2)]


def test_groups_are_peeled(spark):
    rows = [(f"x{i}", b, 10) for i in range(6) for b in ("p", "q")] + [(f"y{i}", b, 10) for i in range(4) for b in ("r", "s")]
    got = lineages.assign_groups(spark.createDataFrame(rows, "cell string, intBC string, n long"), 2).collect()
    assert {r.lineageGrp for r in got if r.cell[0] == "x"} == {1} and {r.lineageGrp for r in got if r.cell[0] == "y"} == {2} and len(got) == 10


def test_consensus_votes(spark):
    rows = [("c", "u", "ACG", "III"), ("c", "u", "ACT", "I!I"), ("c", "u", "AGT", "!!I")]
    r = molecules.call_consensus(spark.createDataFrame(rows, "cellBC string, UMI string, seq string, qual string")).first()
    assert r.seq == "ACT" and r.qual[0] == chr(33 + 31)


def test_alleles_of_known_alignments(spark):
    reference = "AACCGGTTAAC" + "GGGGCCCC" + "ACGTACGTACGTACGTACGTACGT"
    rows = [
        ("whole", "43M", 0, 0, reference),
        ("deleted", "25M4D14M", 0, 0, reference[:25] + reference[29:]),
        ("inserted", "27M2I16M", 0, 0, reference[:27] + "TT" + reference[27:]),
        ("no barcode", "5M20D18M", 0, 0, reference[:5] + reference[25:]),
    ]
    df = spark.createDataFrame(rows, "readName string, CIGAR string, ReferenceBegin int, QueryBegin int, seq string")
    got = {r.readName: r for r in alleles.call_alleles(df, reference, (11, 19), (27, 38), 3, True, 4).collect()}
    assert [got[k].intBC for k in ("whole", "deleted", "inserted", "no barcode")] == ["GGGGCCCC"] * 3 + ["NC"]
    assert got["whole"].r1 == "ACGT[None]ACGT" and got["deleted"].r1 == "GTAC[26:4D]CGTA"[:4].replace("GTAC", reference[21:25]) + "[26:4D]" + reference[29:33]
    assert got["inserted"].r1 == reference[23:27] + "[28:2I]TT" + reference[27:31] and got["inserted"].r2.count("None") == 1
    assert got["no barcode"].r1 == reference[1:5] + "[6:20D]" + reference[25:29]


def test_settings_run_their_stages(spark):
    found = stages.read_settings("[filter_molecules]\nmin_umis = 3\nrule = 0.5\nconflicts = true\nsites = [1, 2]\nname = 'x'\n[other]\n")
    assert found == {"filter_molecules": {"min_umis": 3, "rule": 0.5, "conflicts": True, "sites": (1, 2), "name": "x"}, "other": {}}
    rows = [("c", f"{i}", "b" if i < 5 else "d", "x" if i else "y", 10) for i in range(8)]
    df = spark.createDataFrame(rows, "cellBC string, UMI string, intBC string, allele string, readCount long")
    out = stages.run_stages(df, "[general]\n[filter_molecules]\nmin_umis = 3\nmin_reads_per_umi = 1\n", first="filter_molecules")
    assert sorted(r.UMI for r in out.collect()) == [str(i) for i in range(1, 8)]
    with pytest.raises(ValueError):
        stages.run_stages(df, "[filter_molecules]\n", last="align")


def test_cells_without_a_group_are_zero(spark):
    rows = [(f"x{i}", b, 10) for i in range(6) for b in ("p", "q")] + [("z", f"u{i}", 1) for i in range(9)]
    got = {r.cell: r.lineageGrp for r in lineages.assign_groups(spark.createDataFrame(rows, "cell string, intBC string, n long"), 2).collect()}
    assert got == {f"x{i}": 1 for i in range(6)} | {"z": 0} or got["z"] in (0, 2)


def test_consensus_ties_go_to_the_better_average(spark):
    rows = [("c", "u", "AA", "5!"), ("c", "u", "CC", "4!")]
    r = molecules.call_consensus(spark.createDataFrame(rows, "cellBC string, UMI string, seq string, qual string")).first()
    assert r.seq == "AN" and r.qual == chr(33 + 10) + chr(33 + 2)


def test_rare_barcodes_and_nc_leave_their_groups(spark):
    rows = [(f"a{i}", b, f"{b}{i}{k}", 5) for i in range(40) for b in ("A", "B", "NC") for k in range(4)]
    rows += [("a0", "RARE", f"R{k}", 5) for k in range(4)] + [(f"b{i}", b, f"{b}{i}{k}", 5) for i in range(30) for b in ("X", "Y") for k in range(6)]
    rows += [("few", "X", "X1", 1), ("both", "A", "q1", 9), ("both", "B", "q2", 9), ("both", "X", "q3", 9), ("both", "Y", "q4", 9), (None, "A", "n1", 9), ("a1", None, "n2", 9)]
    table = spark.createDataFrame([(c, b, u, n, "None", "1D", "2I", f"al{b}") for c, b, u, n in rows], "cellBC string, intBC string, UMI string, readCount long, r1 string, r2 string, r3 string, allele string")
    got = stages.call_lineage_groups(table, min_umis=2, min_reads=2.0, inter=0.65).collect()
    assert {r.intBC for r in got if r.cellBC[0] == "a"} == {"A", "B"} and {r.intBC for r in got if r.cellBC[0] == "b" and r.cellBC != "both"} == {"X", "Y"}
    assert {(r.cellBC[0], r.lineageGrp) for r in got} == {("a", 1), ("b", 2)}
    assert not {"few", "both", None} & {r.cellBC for r in got} and len(got) == 40 * 2 + 30 * 2
    assert {(r.UMI, r.readCount) for r in got} == {(4, 20), (6, 30)}
    kept = stages.call_lineage_groups(table, min_umis=1, min_reads=0.5, inter=None).collect()
    assert "both" in {r.cellBC for r in kept} and "few" in {r.cellBC for r in kept} and "RARE" not in {r.intBC for r in kept}


def test_whitelist_by_deletions_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("ACG") for _ in range(k))
    listed = sorted({word(rng.randint(3, 6)) for _ in range(40)})
    seen = sorted({word(rng.randint(1, 7)) for _ in range(200)}) + [None]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    table = spark.createDataFrame([(s, 1) for s in seen], "intBC string, n int")
    white = spark.createDataFrame([(w,) for w in [*listed, " ", f" {listed[0]} "]], "barcode string")
    for most in (0, 1, 2):
        want = []
        for s in seen[:-1]:
            d = sorted((edits(s, w), w) for w in listed)
            if d[0][0] <= most and (len(d) == 1 or d[1][0] > d[0][0]):
                want.append(d[0][1])
        assert sorted(r.intBC for r in molecules.correct_to_whitelist(table, white, most).collect()) == sorted(want)
