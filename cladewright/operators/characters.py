"""Character matrices, lineage profiles and indel priors from allele tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewright.operators.ordering import numbered
from cladewright.operators.stored import stored

SITES = ("r1", "r2", "r3")


def indels(alleles: DataFrame, sites=SITES) -> DataFrame:
    """(cellBC, intBC, site, indel): cut-site columns in long form."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("site"), F.col(s).alias("indel")) for s in sites])).alias("z")
    return alleles.select("cellBC", "intBC", rows).select("cellBC", "intBC", "z.site", "z.indel")


def lineage_profile(alleles: DataFrame, sites=SITES) -> DataFrame:
    """(cellBC, character, indels): sorted distinct indels of each cell at each intBC_site."""
    long = indels(alleles, sites).withColumn("character", F.concat_ws("_", "intBC", "site"))
    return long.groupBy("cellBC", "character").agg(F.array_sort(F.collect_set("indel")).alias("indels"))


def informative_characters(alleles: DataFrame, most: float = 0.999, sites=SITES) -> DataFrame:
    """Characters no allele of which has more than most of its distinct (cell, allele) rows."""
    long = indels(alleles, sites).withColumn("character", F.concat_ws("_", "intBC", "site")).select("cellBC", "character", "indel").distinct()
    part = long.groupBy("character", "indel").agg(F.count(F.lit(1)).alias("n"))
    top = part.groupBy("character").agg((F.max("n") / F.sum("n")).alias("top"))
    return top.filter(F.col("top") <= most).select("character")


def state_codes(alleles: DataFrame, sites=SITES) -> DataFrame:
    """(character, indel, state): uncut is 0, other indels are numbered from 1 by their first cell, then name."""
    long = indels(alleles, sites).withColumn("character", F.concat_ws("_", "intBC", "site")).filter("indel is not null")
    uncut = F.lower("indel").contains("none")
    first = long.filter(~uncut).groupBy("character", "indel").agg(F.min("cellBC").alias("cell"))
    order = Window.partitionBy("character").orderBy("cell", "indel")
    cut = first.select("character", "indel", F.row_number().over(order).alias("state"))
    return cut.unionByName(long.filter(uncut).select("character", "indel", F.lit(0).alias("state")).distinct())


def character_matrix(alleles: DataFrame, most: float = 0.999, sites=SITES) -> DataFrame:
    """(cellBC, character, states): array of the cell's state codes; one entry unless ambiguous. Missing rows are absent."""
    keep = informative_characters(alleles, most, sites)
    long = indels(alleles, sites).withColumn("character", F.concat_ws("_", "intBC", "site")).join(keep, "character", "left_semi")
    return long.join(state_codes(alleles, sites), ["character", "indel"]).groupBy("cellBC", "character").agg(F.array_sort(F.collect_set("state")).alias("states"))


#: Fixed value: the state of a character that is missing in a cell.
MISSING = -1


def _kept_indels(alleles: DataFrame, ignored: DataFrame | None, most: float, missing: str | None, sites, once: bool = True) -> DataFrame:
    """(cellBC, character, indel) of the characters that stay, once rows of equal alleles are one; the missing allele is null.

    What is used of the alleles is stored, as it is read several times.
    """
    used = alleles.filter("cellBC is not null and intBC is not null").select("cellBC", "intBC", *sites)
    if ignored is not None:
        used = used.join(ignored.select("intBC").distinct(), "intBC", "left_anti")
    used = stored(used.distinct() if once else used)
    long = indels(used, sites).withColumn("character", F.concat("intBC", "site"))
    part = long.select("cellBC", "character", "indel").distinct().groupBy("character", "indel").agg(F.count(F.lit(1)).alias("n"))
    diverse = part.groupBy("character").agg((F.max("n") / F.sum("n")).alias("top")).filter(F.col("top") <= most)
    gone = F.lit(False) if missing is None else F.col("indel") == missing
    return long.join(diverse, "character", "left_semi").select("cellBC", "character", F.when(~gone, F.col("indel")).alias("indel"))


def matrix_states(alleles: DataFrame, ignored: DataFrame | None = None, most: float = 1.0, missing: str | None = None, priors: DataFrame | None = None, sites=SITES) -> DataFrame:
    """(character, column, state, indel, q): the characters of an allele table, numbered from 1, and their mutated states.

    A character is an intBC, less the ignored ones, with a cut site, unless one allele makes up more than most of its
    distinct (cell, allele) rows; columns go by name. Indels other than uncut and missing ones are numbered from 1 in each
    character by their first cell, then name. priors (indel, freq) give q, averaged for repeated indels, null for unknown
    ones. A character without mutated indels has one row with a null state.
    """
    kept = _kept_indels(alleles, ignored, most, missing, sites)
    columns = numbered(kept.select("character").distinct(), [], ["character"], "column")
    cut = kept.filter("indel is not null").filter(~F.contains(F.lower("indel"), F.lit("none")))
    first = cut.groupBy("character", "indel").agg(F.min("cellBC").alias("cell"))
    coded = numbered(first, ["character"], ["cell", "indel"], "state").select("character", "indel", F.col("state").cast("int").alias("state"))
    if priors is None:
        coded = coded.withColumn("q", F.lit(None).cast("double"))
    else:
        coded = coded.join(priors.groupBy("indel").agg(F.avg("freq").alias("q")), "indel", "left")
    return columns.join(coded, "character", "left").select("character", "column", "state", "indel", "q")


def matrix_rows(alleles: DataFrame, states: DataFrame, ignored: DataFrame | None = None, most: float = 1.0, missing: str | None = None, sites=SITES, collapse: bool = True) -> DataFrame:
    """(cellBC, row): what each cell shows at each column of matrix_states(), as an array of sorted arrays of states.

    Uncut is 0, a missing or null indel and a column without rows of the cell -1; several states stay side by side, once
    each, or with collapse=False as often as they occur. Cells and characters are not crossed: only what a cell shows is
    joined, and the rest is filled within its row. Cells without any row of a kept character have no row here.
    """
    kept = _kept_indels(alleles, ignored, most, missing, sites, collapse)
    told = kept.join(states.select("character", "column", "indel", "state"), ["character", "indel"], "left")
    columns = states.select("character", F.col("column").alias("at")).distinct()
    uncut = F.contains(F.lower("indel"), F.lit("none"))
    told = told.join(columns, "character").withColumn("state", F.when(F.col("indel").isNull(), MISSING).when(uncut, 0).otherwise(F.col("state")))
    gathered = F.collect_set("state") if collapse else F.collect_list("state")
    shown = told.groupBy("cellBC", "at").agg(F.array_sort(gathered).alias("states"))
    width = states.agg(F.max("column").alias("width"))
    cells = shown.groupBy("cellBC").agg(F.map_from_entries(F.collect_list(F.struct("at", "states"))).alias("shown"))
    filled = F.transform(F.sequence(F.lit(1).cast("long"), "width"), lambda i: F.coalesce(F.try_element_at("shown", i), F.array(F.lit(MISSING))))
    return cells.crossJoin(F.broadcast(width)).select("cellBC", filled.alias("row"))


def indel_priors(alleles: DataFrame, by=("intBC",), sites=SITES) -> DataFrame:
    """(indel, count, freq): in how many groups an indel occurs, and in what part of all."""
    total = alleles.select(*by).distinct().agg(F.count(F.lit(1)).alias("groups"))
    named = alleles.select(*by, F.explode(F.array(*sites)).alias("indel")).filter(~F.lower("indel").contains("none")).distinct()
    counted = named.groupBy("indel").agg(F.count(F.lit(1)).alias("count"))
    return counted.join(F.broadcast(total)).select("indel", "count", (F.col("count") / F.col("groups")).alias("freq"))


def equal_rows(characters: DataFrame) -> DataFrame:
    """(seed, cells): groups of cells with the same states at all sites; seed is the first."""
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("site", "state"))), lambda x: F.coalesce(x["state"].cast("string"), F.lit("?"))), "|")
    packed = characters.groupBy("cell").agg(row.alias("states"))
    return packed.groupBy("states").agg(F.min("cell").alias("seed"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("cell")).alias("cells"))


def uninformative_sites(characters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sites, of each data set, at which all known states are 0."""
    none = F.coalesce(F.bool_and(F.col("state") == 0), F.lit(True))
    return characters.groupBy(*by, "site").agg(none.alias("none")).filter("none").select(*by, "site")


def without_uninformative(characters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The matrix without its uninformative sites."""
    return characters.join(uninformative_sites(characters, by), [*by, "site"], "left_anti")


def without_all_missing(characters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The matrix without the sites that no cell of a data set has a state at."""
    seen = characters.groupBy(*by, "site").agg(F.count("state").alias("known")).filter("known > 0")
    return characters.join(seen.drop("known"), [*by, "site"], "left_semi")


def present_sites(characters: DataFrame, priors: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The matrix and its priors (by..., site, state, q), both without the sites that no cell of a data set has a state at."""
    seen = characters.filter("state is not null").select(*by, "site").distinct()
    return tuple(t.join(seen, [*by, "site"], "left_semi") for t in (characters, priors))


def average_rows(characters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., site, mean): the mean of the known states of the cells of each group."""
    return characters.groupBy(*by, "site").agg(F.avg("state").alias("mean"))


def chi_square(rows: DataFrame, first: str, second: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., chi2): the statistic of the contingency table of two columns, over rows that have both."""
    cells = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(*by, first, second).agg(F.count(F.lit(1)).alias("n"))
    margins = [cells.groupBy(*by, *c).agg(F.sum("n").alias(n)) for c, n in (((first,), "r"), ((second,), "c"), ((), "t"))]
    # total * (sum of n^2 / (row * column) - 1); margins are one row for each value and data set
    met = cells.join(margins[0], [*by, first]).join(margins[1], [*by, second])
    part = met.groupBy(*by).agg(F.sum(F.col("n") * F.col("n") / F.col("r") / F.col("c")).alias("part"))
    joined = part.join(margins[2], list(by)) if by else part.crossJoin(margins[2])
    return joined.select(*by, ((F.col("part") - 1) * F.col("t")).alias("chi2"))


def site_statistics(characters: DataFrame) -> DataFrame:
    return characters.groupBy("site").agg(F.count_if(F.col("state").isNull()).alias("missing"), F.count_if(F.col("state") == 0).alias("zero"), F.count_distinct(F.when(F.col("state") > 0, F.col("state"))).alias("alphabet"))


def recoded(characters: DataFrame) -> DataFrame:
    """Positive states renumbered 1..k at each site by value."""
    order = Window.partitionBy("site").orderBy("state")
    codes = characters.filter("state > 0").select("site", "state").distinct().select("site", "state", F.row_number().over(order).alias("code"))
    return characters.join(codes, ["site", "state"], "left").select("cell", "site", F.when(F.col("state") == 0, 0).otherwise(F.col("code")).alias("state"))


def site_priors(characters: DataFrame) -> DataFrame:
    """(site, state, q): uniform over the positive states seen at a site."""
    seen = characters.filter("state > 0").select("site", "state").distinct()
    return seen.select("site", "state", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("site"))).alias("q"))


def normalised_priors(priors: DataFrame) -> DataFrame:
    """Priors between 0 and 1, scaled to one at each site."""
    return priors.filter((F.col("q") > 0) & (F.col("q") < 1)).withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("site")))


def mutation_rate(characters: DataFrame, height: float = 1.0) -> DataFrame:
    """One row: -ln(1 - share of mutated among known) / height."""
    share = F.count_if(F.col("state") > 0) / F.count("state")
    return characters.agg((-F.log(1 - share) / height).alias("rate"))
