"""Molecule-table operators: filters, resolution, error correction, doublets and allele choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewright.functions.sequences import all_qualities_reach, hamming, letters
from cladewright.operators.stored import stored


def filter_qualities(reads: DataFrame, least: int = 10, columns=("qual",)) -> DataFrame:
    """Reads of which every base quality in columns reaches least."""
    keep = F.lit(True)
    for c in columns:
        keep &= all_qualities_reach(c, least)
    return reads.filter(keep)


def resolve_umis(reads: DataFrame) -> DataFrame:
    """The read with most support for each cell and UMI, with the counts of the two best and of all.

    Ties go to the smaller read name.
    """
    order = Window.partitionBy("cellBC", "UMI").orderBy(F.desc("readCount"), "readName")
    every = Window.partitionBy("cellBC", "UMI")
    ranked = reads.select("*", F.row_number().over(order).alias("rn"), F.lead("readCount").over(order).alias("second"), F.sum("readCount").over(every).alias("total"))
    return ranked.filter("rn = 1").select("cellBC", "UMI", "readName", "seq", F.col("readCount").alias("first"), "second", "total")


def resolved_molecules(reads: DataFrame, min_umis: int = 10, min_reads: float = 2.0) -> DataFrame:
    """Of each cell and UMI the row with most reads (ties: the smaller name), in cells with enough UMIs and reads a UMI."""
    order = Window.partitionBy("cellBC", "UMI").orderBy(F.desc("readCount"), "readName", "seq")
    best = reads.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")
    return filter_cells(best, min_umis, min_reads)


def filter_cells(molecules: DataFrame, min_umis: int = 10, min_reads: float = 2.0, umi_is_count: bool = False) -> DataFrame:
    """Molecules of cells with enough UMIs and reads per UMI; UMI is a sequence, or a count where umi_is_count."""
    n = F.sum("UMI") if umi_is_count else F.count(F.lit(1))
    good = molecules.groupBy("cellBC").agg(n.alias("n"), F.sum("readCount").alias("reads")).filter((F.col("n") >= min_umis) & (F.col("reads") / F.col("n") >= min_reads))
    return molecules.join(good.select("cellBC"), "cellBC", "left_semi")


def read_threshold(molecules: DataFrame) -> DataFrame:
    """One row: the 99th percentile of reads divided by ten, whole; 0 for an empty table."""
    return molecules.agg(F.coalesce(F.floor(F.percentile("readCount", F.lit(0.99)) / 10), F.lit(0)).cast("long").alias("threshold"))


def filter_umis(molecules: DataFrame, least: int = -1) -> DataFrame:
    """Molecules with at least least reads; a negative least means read_threshold()."""
    if least >= 0:
        return molecules.filter(F.col("readCount") >= least)
    return molecules.join(F.broadcast(read_threshold(molecules)), F.col("readCount") >= F.col("threshold")).drop("threshold")


def deletions(x: Column, most: int) -> Column:
    """A text and all that is left of it without up to most of its letters; texts within most edits share one of these."""
    out = F.array(x)
    for _ in range(most):
        without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        shorter = F.flatten(F.transform(F.filter(out, lambda w: F.length(w) > 0), without))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def correct_to_whitelist(molecules: DataFrame, whitelist: DataFrame, most: int = 1) -> DataFrame:
    """intBC replaced by the only nearest whitelist entry within most edits; rows without one go.

    Distinct barcodes meet the whitelist, not molecules, and only entries with which they share one of their deletions.
    """
    seen = molecules.select("intBC").filter("intBC is not null").distinct()
    listed = whitelist.select(F.trim("barcode").alias("barcode")).filter("barcode <> ''").distinct()
    left = seen.select("intBC", F.explode(deletions(F.col("intBC"), most)).alias("rest"))
    right = listed.select("barcode", F.explode(deletions(F.col("barcode"), most)).alias("rest"))
    near = left.join(right, "rest").select("intBC", "barcode").distinct().withColumn("d", F.levenshtein("intBC", "barcode")).filter(F.col("d") <= most)
    best = near.groupBy("intBC").agg(F.min("d").alias("least"), F.min(F.struct("d", "barcode")).alias("first"), F.max(F.struct((-F.col("d")).alias("less"), "barcode")).alias("last"))
    # the only nearest one is the first and the last of those at the least distance
    best = best.filter(F.col("first.barcode") == F.col("last.barcode")).select("intBC", F.col("first.barcode").alias("barcode"))
    return molecules.join(best, "intBC").withColumn("intBC", F.col("barcode")).drop("barcode")


def correct_intbcs(alleles: DataFrame, prop: float = 0.5, most_umis: int = 10, distance: int = 1) -> DataFrame:
    """intBCs of few UMIs renamed to a more frequent close one of the same cell and allele.

    Of several that qualify, the least frequent wins; decisions use the original counts. prop above one half does nothing.
    """
    if prop > 0.5:
        return alleles
    groups = alleles.groupBy("cellBC", "intBC", "allele").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("cellBC", "allele").orderBy(F.desc("n"), "intBC")
    ranked = groups.withColumn("rn", F.row_number().over(order))
    major = ranked.select("cellBC", "allele", F.col("intBC").alias("to"), F.col("n").alias("n1"), F.col("rn").alias("rn1"))
    pairs = major.join(ranked, ["cellBC", "allele"]).filter((F.col("rn1") < F.col("rn")) & (F.levenshtein("to", "intBC") <= distance) & (F.col("n") / (F.col("n") + F.col("n1")) < prop) & (F.col("n") <= most_umis))
    renamed = pairs.groupBy("cellBC", "allele", "intBC").agg(F.max_by("to", "rn1").alias("to"))
    return alleles.join(renamed, ["cellBC", "allele", "intBC"], "left").withColumn("intBC", F.coalesce("to", "intBC")).drop("to")


def umi_corrections(molecules: DataFrame, distance: int = 1, keys: tuple[str, ...] = ("cellBC", "intBC")) -> DataFrame:
    """(keys..., UMI, to): each UMI's most abundant neighbour within distance, before chains are followed.

    Every (distance + 1)-th letter makes a piece of a UMI, whatever its length; close UMIs have one of these pieces in
    common, so only those with an equal piece meet.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("readCount"), F.desc("UMI"))
    ranked = molecules.select(*keys, "UMI", "readCount", F.row_number().over(order).alias("rn"))
    of = lambda p: F.array_join(F.filter(letters("UMI"), lambda _, i: i % (distance + 1) == p), "")
    pieces = F.array(*[F.struct(F.lit(p).alias("part"), of(p).alias("piece")) for p in range(distance + 1)])
    cut = ranked.select(*keys, "UMI", "rn", F.explode(pieces).alias("cut_piece")).select(*keys, "UMI", "rn", "cut_piece.part", "cut_piece.piece")
    other = cut.withColumnsRenamed({"UMI": "to", "rn": "rn1"})
    near = cut.join(other, [*keys, "part", "piece"]).filter((F.col("rn1") < F.col("rn")) & (hamming("UMI", "to") <= distance))
    return near.groupBy(*keys, "UMI").agg(F.min_by("to", "rn1").alias("to"))


def correct_umis(molecules: DataFrame, distance: int = 1, most_rounds: int = 32, by_allele: bool = False) -> DataFrame:
    """Reads summed over chains of UMIs that differ in few places; the root keeps its attributes.

    UMIs must be unique for each cell and intBC; more than one row is an error. by_allele corrects within an allele only.
    A readName is made anew of cell, UMI and reads. Chains are followed by doubling: each round replaces a target by the
    target's own target.
    """
    keys = ["cellBC", "intBC", *(["allele"] if by_allele else [])]
    molecules = stored(molecules)
    if not repeated_umis(molecules).isEmpty():
        raise ValueError("several rows of one cell, intBC and UMI: resolve UMIs first")
    if distance == 0:
        return molecules
    links = stored(umi_corrections(molecules, distance, tuple(keys)))
    for _ in range(most_rounds):
        step = links.select(*keys, F.col("UMI").alias("to"), F.col("to").alias("further"))
        longer = links.join(step, [*keys, "to"], "left")
        if longer.filter("further is not null").isEmpty():
            break
        links = stored(longer.select(*keys, "UMI", F.coalesce("further", "to").alias("to")))
    # only what moves is grouped; a root is no UMI of a link
    moved = molecules.select(*keys, "UMI", "readCount").join(links, [*keys, "UMI"])
    gained = moved.groupBy(*keys, F.col("to").alias("UMI")).agg(F.sum("readCount").alias("gained"))
    stay = molecules.dropna(subset=[*keys, "UMI"]).join(links.select(*keys, "UMI"), [*keys, "UMI"], "left_anti")
    total = F.when(F.col("gained").isNotNull(), F.coalesce("readCount", F.lit(0)) + F.col("gained")).otherwise(F.col("readCount"))
    out = stay.join(gained, [*keys, "UMI"], "left").withColumn("readCount", total).drop("gained").select(*[*keys, "UMI"], *[c for c in molecules.columns if c not in {*keys, "UMI"}])
    return out.withColumn("readName", F.concat_ws("_", "cellBC", "UMI", "readCount")) if "readName" in out.columns else out


def conflicting_share(alleles: DataFrame) -> DataFrame:
    """(cellBC, prop): share of UMIs that speak against the main allele of their intBC."""
    by_allele = alleles.groupBy("cellBC", "intBC", "allele").agg(F.count(F.lit(1)).alias("n"))
    by_intbc = by_allele.groupBy("cellBC", "intBC").agg(F.sum("n").alias("n"), F.max("n").alias("main"))
    return by_intbc.groupBy("cellBC").agg((F.sum(F.col("n") - F.col("main")) / F.sum("n")).alias("prop"))


def filter_intra_doublets(alleles: DataFrame, prop: float = 0.1) -> DataFrame:
    good = conflicting_share(alleles).filter(F.col("prop") <= prop)
    return alleles.join(good.select("cellBC"), "cellBC", "left_semi")


def map_intbcs(alleles: DataFrame) -> DataFrame:
    """Rows of the one allele of each cell and intBC with most UMIs, then most reads, then the smaller name."""
    groups = alleles.filter("intBC is not null").groupBy("cellBC", "intBC", "allele").agg(F.count(F.lit(1)).alias("n"), F.sum("readCount").alias("reads"))
    order = Window.partitionBy("cellBC", "intBC").orderBy(F.desc("n"), F.desc("reads"), "allele")
    chosen = groups.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("cellBC", "intBC", "allele")
    return alleles.join(chosen, ["cellBC", "intBC", "allele"], "left_semi")


def repeated_umis(molecules: DataFrame) -> DataFrame:
    """Keys that break the rule of one row for each (cellBC, intBC, UMI)."""
    return molecules.groupBy("cellBC", "intBC", "UMI").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def molecule_statistics(molecules: DataFrame) -> DataFrame:
    """One row: molecules, cells, intBCs, and mean and median reads."""
    return molecules.agg(F.count(F.lit(1)).alias("n_molecules"), F.count_distinct("cellBC").alias("n_cells"), F.count_distinct("intBC").alias("n_intbcs"), F.avg("readCount").alias("mean_reads"), F.percentile("readCount", F.lit(0.5)).alias("median_reads"))


def read_histogram(molecules: DataFrame) -> DataFrame:
    return molecules.groupBy("readCount").agg(F.count(F.lit(1)).alias("n"))


def collapse_alleles(alleles: DataFrame, sites=("r1", "r2", "r3"), extra: tuple[Column, ...] = ()) -> DataFrame:
    """Final allele table: UMIs counted and reads summed for each cell, intBC and allele; rows with null keys go."""
    keys = ["cellBC", "intBC", "allele", *sites, *extra]
    return alleles.dropna(subset=[k for k in keys if isinstance(k, str)]).groupBy(*keys).agg(F.count("UMI").alias("UMI"), F.sum("readCount").alias("readCount"))


def call_consensus(reads: DataFrame, min_quality: int = 30) -> DataFrame:
    """(cellBC, UMI, seq, qual, n): one consensus for each cell and UMI, as long as its longest read, and the reads it has.

    At each place stands the base with most reads of good quality, then most reads, then the best average quality. Its
    quality is 31 if more than half of all reads have it and one of them in good quality, else 10; a tie gives N and 2.
    """
    keys = ["cellBC", "UMI"]
    zipped = F.arrays_zip(letters("seq").alias("b"), letters("qual").alias("q"))
    place = reads.select(*keys, F.posexplode(zipped).alias("pos", "z")).filter("z.b is not null")
    phred = F.ascii("z.q") - 33
    votes = place.groupBy(*keys, "pos", F.col("z.b").alias("base")).agg(F.count(F.lit(1)).alias("c"), F.count_if(phred >= min_quality).alias("good"), F.avg(phred).alias("mean"))
    order = Window.partitionBy(*keys, "pos").orderBy(F.desc("good"), F.desc("c"), F.desc("mean"))
    equal = Window.partitionBy(*keys, "pos", "good", "c", "mean")
    ranked = votes.select("*", F.rank().over(order).alias("rk"), F.count(F.lit(1)).over(equal).alias("ties"), F.sum("c").over(Window.partitionBy(*keys, "pos")).alias("total"))
    best = ranked.filter("rk = 1").groupBy(*keys, "pos").agg(F.min("base").alias("base"), *[F.max(c).alias(c) for c in ("ties", "c", "good", "total")])
    listed = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "base", "ties", "c", "good"))).alias("z"), F.max("total").alias("n"))
    sure = lambda x: (x["c"] > 0.5 * F.col("n")) & (x["good"] > 0)
    quality = F.transform("z", lambda x: F.char(F.when(x["ties"] > 1, 2).when(sure(x), 31).otherwise(10) + 33))
    bases = F.transform("z", lambda x: F.when(x["ties"] > 1, "N").otherwise(x["base"]))
    return listed.select(*keys, F.array_join(bases, "").alias("seq"), F.array_join(quality, "").alias("qual"), "n")
