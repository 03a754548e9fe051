"""The rows behind the heat maps of allele tables: what stands at which row and column; places without a row are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.operators.alleles import cutsite_codes
from cladewright.operators.characters import SITES
from cladewright.operators.ordering import numbered


def barcode_overlap(alleles: DataFrame) -> DataFrame:
    """(cellBC, intBC, lineageGrp, col): which cells have which barcodes, columns by lineage group and barcode.

    A barcode of several groups has a column in each of them, and all its cells are marked in all of these.
    """
    columns = numbered(alleles.filter("intBC is not null").select("lineageGrp", "intBC").distinct(), [], ["lineageGrp", "intBC"], "col")
    return alleles.select("cellBC", "intBC").distinct().join(columns, "intBC").select("cellBC", "intBC", "lineageGrp", "col")


def allele_heatmap(alleles: DataFrame, sites=SITES, least_barcodes: int = 2) -> DataFrame:
    """(lineageGrp, cellBC, row, n_umis, intBC, col, site, code): the mean code of each cut site in each cell of a group.

    Rows go by rising number of a cell's alleles, columns by falling number of a barcode's, equal ones by name, both from 1
    in each group; n_umis is that of the cell. Groups of fewer than least_barcodes barcodes have no map.
    """
    told = alleles.filter("lineageGrp is not null and cellBC is not null and intBC is not null")
    by_cell = numbered(told.groupBy("lineageGrp", "cellBC").agg(F.count("UMI").alias("n_umis")), ["lineageGrp"], ["n_umis", "cellBC"], "row")
    by_barcode = told.groupBy("lineageGrp", "intBC").agg(F.count(F.lit(1)).alias("n"))
    wide = by_barcode.groupBy("lineageGrp").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least_barcodes)
    by_barcode = numbered(by_barcode, ["lineageGrp"], [F.desc("n"), "intBC"], "col").join(wide, "lineageGrp", "left_semi")
    coded = cutsite_codes(told, sites)
    codes = [c.replace("r", "s") for c in sites]
    means = coded.groupBy("lineageGrp", "cellBC", "intBC").agg(*[F.avg(c).alias(c) for c in codes])
    long = means.select("lineageGrp", "cellBC", "intBC", F.explode(F.array(*[F.struct(F.lit(c).alias("site"), F.col(c).alias("code")) for c in codes])).alias("z"))
    out = long.join(by_barcode.select("lineageGrp", "intBC", "col"), ["lineageGrp", "intBC"]).join(by_cell, ["lineageGrp", "cellBC"])
    return out.select("lineageGrp", "cellBC", "row", "n_umis", "intBC", "col", "z.site", "z.code")


def distinct_alleles(alleles: DataFrame, sites=SITES) -> DataFrame:
    """(lineageGrp, intBC, site, n): the number of different indels at each cut site of a group's barcode, nulls not counted."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("site"), F.col(c).alias("indel")) for c in sites])).alias("z")
    return alleles.select("lineageGrp", "intBC", rows).groupBy("lineageGrp", "intBC", F.col("z.site").alias("site")).agg(F.count_distinct("z.indel").alias("n"))
