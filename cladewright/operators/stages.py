"""Preprocess stages made of the operators, run one after another from a configuration."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.operators import alleles, lineages, molecules
from cladewright.operators.stored import stored


def filter_molecule_table(
    table: DataFrame, min_umis: int = 10, min_reads: float = 2.0, min_reads_per_umi: int = -1, distance: int = 1, prop: float = 0.5, most_umis: int = 10, doublets: float | None = 0.35, conflicts: bool = False
) -> DataFrame:
    """The molecules that stay: enough reads and cells, barcodes corrected, doublets out, one allele for each barcode.

    conflicts keeps several alleles of a barcode, and with them the doublets.
    """
    out = molecules.filter_umis(table.filter("intBC is not null"), min_reads_per_umi)
    out = molecules.filter_cells(out, min_umis, min_reads)
    if distance > 0:
        out = stored(molecules.correct_intbcs(out, prop, most_umis, distance))
    if doublets and not conflicts:
        out = molecules.filter_intra_doublets(out, doublets)
    return out if conflicts else molecules.map_intbcs(out)


def refine_lineage_groups(
    table: DataFrame, groups: DataFrame, min_umis: int = 10, min_reads: float = 2.0, min_presence: float = 0.05, inter: float | None = 0.35, sites: tuple[str, ...] = ("r1", "r2", "r3")
) -> DataFrame:
    """From molecules and first groups (cell, lineageGrp from 1) the final allele table with lineageGrp.

    Of each group the barcodes with at least min_presence of its commonest one's cells are kept, and its cells go to the
    group of most share. Groups are numbered anew by size; cells in none have 0, a group like others from here on. Cells
    whose membership in their own group is under inter go (None: nobody). Then barcodes in min_presence or less of their
    group's cells and the barcode NC go, molecules are counted and reads summed, and last the cells with under min_umis
    molecules or min_reads reads a molecule in what is left go. Null barcodes, alleles and sites go with the count.
    """
    by_cell = table.filter("intBC is not null").groupBy(F.col("cellBC").alias("cell"), "intBC").agg(F.count("UMI").alias("n"))
    by_cell = stored(by_cell)
    grouped = stored(groups.filter("lineageGrp > 0").select("cell", "lineageGrp"))
    assigned = by_cell.join(grouped.select("cell"), "cell", "left_semi")
    scored = lineages.score_kinships(assigned, stored(lineages.group_profiles(assigned, grouped, min_presence)))
    named = lineages.renumber_by_size(stored(scored.select("cell", "lineageGrp")))
    named = stored(by_cell.select("cell").distinct().join(named, "cell", "left").select("cell", F.coalesce("lineageGrp", F.lit(0)).alias("lineageGrp")))
    if inter:
        named = stored(lineages.filter_inter_doublets(by_cell, named, stored(lineages.group_profiles(by_cell, named, 0.0)), inter))
    good = lineages.filter_group_barcodes(by_cell, named, min_presence).select(F.col("cell").alias("cellBC"), "intBC", "lineageGrp")
    counted = stored(molecules.collapse_alleles(table.join(good, ["cellBC", "intBC"]), sites, extra=("lineageGrp",)))
    return molecules.filter_cells(counted, min_umis, min_reads, umi_is_count=True)


def call_lineage_groups(
    table: DataFrame, min_umis: int = 10, min_reads: float = 2.0, min_cluster_prop: float = 0.005, min_presence: float = 0.05, kinship: float = 0.25, inter: float | None = 0.35, sites: tuple[str, ...] = ("r1", "r2", "r3")
) -> DataFrame:
    """The final allele table of molecules with each cell's lineage group (cellBC, intBC, allele, ..., lineageGrp).

    Groups are peeled off by their barcodes until one has at most min_cluster_prop of all cells, and then refined.
    """
    by_cell = stored(table.filter("intBC is not null").groupBy(F.col("cellBC").alias("cell"), "intBC").agg(F.count("UMI").alias("n")))
    least = int(min_cluster_prop * by_cell.select("cell").distinct().count())
    groups = lineages.assign_groups(by_cell, least, min_presence, kinship)
    return refine_lineage_groups(table, groups, min_umis, min_reads, min_presence, inter, sites)


STAGES = {
    "filter_molecules": filter_molecule_table, "call_lineages": call_lineage_groups, "error_correct_umis": molecules.correct_umis,
    "filter_qualities": molecules.filter_qualities, "call_alleles": alleles.call_alleles,
}


def read_settings(text: str) -> dict[str, dict]:
    """Sections of an INI text as keyword arguments; values are numbers, booleans or lists where they look so."""
    parser = configparser.ConfigParser()
    parser.optionxform = str
    parser.read_string(text)

    def value(x: str):
        x = x.strip()
        if x.startswith(("[", "(")):
            return tuple(value(v) for v in x[1:-1].split(",") if v.strip())
        if x.lower() in ("true", "false", "none"):
            return {"true": True, "false": False, "none": None}[x.lower()]
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                continue
        return x.strip("'\"")

    return {s: {k: value(v) for k, v in parser[s].items()} for s in parser.sections()}


def run_stages(table: DataFrame, settings: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Runs the sections of a configuration that name stages, in order, from first to last.

    What a stage reads is stored, as most stages read it several times.
    """
    named = [(s, k) for s, k in read_settings(settings).items() if s in STAGES]
    names = [s for s, _ in named]
    for s in (first, last):
        if s is not None and s not in names:
            raise ValueError(f"no stage {s} in the configuration; there are {', '.join(names)}")
    for s, k in named[names.index(first) if first else 0 : (names.index(last) + 1) if last else None]:
        table = STAGES[s](stored(table), **k)
    return table
