"""The registered queries over the supplied tables, and the SQL that checks them, by name.

A query derives its domain table (sources.derived) and applies one operator; its SQL starts from the same derivation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewright.functions import sequences
from cladewright.operators import ancestry, characters, distances, evaluation, inference, likelihood, lineages, molecules, simulation
from cladewright.operators.stored import stored
from cladewright.plans import phylogeny, preprocess
from cladewright.plans.fragments import CLOSURE, DEPTHS
from cladewright.sources.derived import SPAN, derive, with_derived
from cladewright.streaming import counts as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}

GROUP_SQL = "SELECT user_id AS cell, cast(user_id % 4 + 1 AS int) AS lineageGrp FROM events GROUP BY user_id"


def _query(name: str, sql: str | None = None, source: str = "molecules"):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(derive(spark, sf_dir, source))
        if sql is not None:
            SQL[name] = with_derived(sql)
        return f

    return add


# -- molecules -----------------------------------------------------------------------------------------------------

_query("filter_qualities", "SELECT cellBC, UMI, readName FROM reads WHERE list_bool_and(list_transform(range(1, 9), lambda i: ascii(substr(qual, i, 1)) >= 35))", "reads")(
    lambda t: molecules.filter_qualities(t, 2).select("cellBC", "UMI", "readName")
)
_query(
    "resolve_umis",
    """SELECT cellBC, UMI, readName, seq, first, second, total FROM (SELECT cellBC, UMI, readName, seq, readCount AS first,
  lead(readCount) OVER w AS second, cast(sum(readCount) OVER (PARTITION BY cellBC, UMI) AS bigint) AS total, row_number() OVER w AS rn
  FROM reads WINDOW w AS (PARTITION BY cellBC, UMI ORDER BY readCount DESC, readName, seq)) x WHERE rn = 1""",
    "reads",
)(lambda t: molecules.resolve_umis(t.dropDuplicates()))
GOOD_CELLS = "SELECT cellBC FROM molecules GROUP BY cellBC HAVING count(*) >= 500 AND sum(readCount) / count(*) >= 25.5"
_query("filter_cells", f"SELECT cellBC, intBC, UMI, readCount FROM molecules WHERE cellBC IN ({GOOD_CELLS})")(lambda t: molecules.filter_cells(t, 500, 25.5).select("cellBC", "intBC", "UMI", "readCount"))
_query("filter_cells_by_count", "SELECT cellBC, UMI, readCount FROM (SELECT cellBC, count(*) AS UMI, cast(sum(readCount) AS bigint) AS readCount FROM molecules GROUP BY cellBC) x WHERE UMI >= 500 AND readCount / UMI >= 25.5")(
    lambda t: molecules.filter_cells(t.groupBy("cellBC").agg(F.count(F.lit(1)).alias("UMI"), F.sum("readCount").alias("readCount")), 500, 25.5, umi_is_count=True)
)
_query("read_threshold", "SELECT cast(coalesce(floor(quantile_cont(readCount, 0.99) / 10), 0) AS bigint) AS threshold FROM molecules")(molecules.read_threshold)
_query("filter_umis", "SELECT cellBC, UMI, readCount FROM molecules WHERE readCount >= (SELECT floor(quantile_cont(readCount, 0.99) / 10) FROM molecules)")(lambda t: molecules.filter_umis(t).select("cellBC", "UMI", "readCount"))
_query(
    "correct_to_whitelist",
    """WITH wl AS (SELECT DISTINCT intBC AS barcode FROM molecules WHERE substr(intBC, 3, 1) IN ('A', 'T')),
p AS (SELECT s.intBC, barcode, levenshtein(s.intBC, barcode) AS d FROM (SELECT DISTINCT intBC FROM molecules) s, wl WHERE levenshtein(s.intBC, barcode) <= 1),
b AS (SELECT intBC, min(barcode) AS barcode FROM (SELECT *, min(d) OVER (PARTITION BY intBC) AS m FROM p) x WHERE d = m GROUP BY intBC HAVING count(*) = 1)
SELECT cellBC, barcode AS intBC, UMI FROM molecules JOIN b ON molecules.intBC = b.intBC""",
)(lambda t: molecules.correct_to_whitelist(t, t.filter(F.substring("intBC", 3, 1).isin("A", "T")).select(F.col("intBC").alias("barcode"))).select("cellBC", "intBC", "UMI"))
_query(
    "correct_intbcs",
    """WITH g AS (SELECT *, row_number() OVER (PARTITION BY cellBC, allele ORDER BY n DESC, intBC) AS rn FROM (SELECT cellBC, intBC, allele, count(*) AS n FROM alleles GROUP BY cellBC, intBC, allele) x),
p AS (SELECT b.cellBC, b.allele, b.intBC, a.intBC AS dest, a.rn FROM g a JOIN g b ON a.cellBC = b.cellBC AND a.allele = b.allele AND a.rn < b.rn
  WHERE levenshtein(a.intBC, b.intBC) <= 1 AND b.n / (a.n + b.n) < 0.5 AND b.n <= 10),
r AS (SELECT cellBC, allele, intBC, arg_max(dest, rn) AS dest FROM p GROUP BY cellBC, allele, intBC)
SELECT alleles.cellBC, coalesce(dest, alleles.intBC) AS intBC, alleles.allele, UMI FROM alleles LEFT JOIN r ON alleles.cellBC = r.cellBC AND alleles.allele = r.allele AND alleles.intBC = r.intBC""",
    "alleles",
)(lambda t: molecules.correct_intbcs(t).select("cellBC", "intBC", "allele", "UMI"))
RANKED = "SELECT cellBC, intBC, UMI, readCount, row_number() OVER (PARTITION BY cellBC, intBC ORDER BY readCount DESC, UMI DESC) AS rn FROM molecules"
LINKS = f"""r AS ({RANKED}), l AS (SELECT b.cellBC, b.intBC, b.UMI, arg_min(a.UMI, a.rn) AS dest FROM r a JOIN r b ON a.cellBC = b.cellBC AND a.intBC = b.intBC AND a.rn < b.rn
  WHERE hamming(a.UMI, b.UMI) <= 2 GROUP BY b.cellBC, b.intBC, b.UMI)"""
_query("umi_corrections", f"WITH {LINKS} SELECT cellBC, intBC, UMI, dest FROM l")(lambda t: molecules.umi_corrections(t, 2).withColumnRenamed("to", "dest"))
_query(
    "correct_umis",
    f"""WITH RECURSIVE {LINKS}, chain AS (
  SELECT cellBC, intBC, UMI, UMI AS cur, 0 AS k FROM molecules UNION ALL
  SELECT chain.cellBC, chain.intBC, chain.UMI, l.dest, k + 1 FROM chain JOIN l ON chain.cellBC = l.cellBC AND chain.intBC = l.intBC AND chain.cur = l.UMI),
root AS (SELECT cellBC, intBC, UMI, arg_max(cur, k) AS root FROM chain GROUP BY cellBC, intBC, UMI)
SELECT m.cellBC, m.intBC, root.root AS UMI, cast(sum(m.readCount) AS bigint) AS readCount FROM molecules m JOIN root ON m.cellBC = root.cellBC AND m.intBC = root.intBC AND m.UMI = root.UMI GROUP BY m.cellBC, m.intBC, root.root""",
)(lambda t: molecules.correct_umis(t, 2).select("cellBC", "intBC", "UMI", "readCount"))
_LINKS_BY_ALLELE = LINKS.replace("molecules", "alleles").replace("cellBC, intBC", "cellBC, intBC, allele").replace("b.cellBC, b.intBC", "b.cellBC, b.intBC, b.allele").replace(
    "a.intBC = b.intBC", "a.intBC = b.intBC AND a.allele = b.allele"
)
_query(
    "correct_umis_by_allele",
    f"""WITH RECURSIVE {_LINKS_BY_ALLELE}, chain AS (
  SELECT cellBC, intBC, allele, UMI, UMI AS cur, 0 AS k FROM alleles UNION ALL
  SELECT chain.cellBC, chain.intBC, chain.allele, chain.UMI, l.dest, k + 1 FROM chain JOIN l USING (cellBC, intBC, allele) WHERE chain.cur = l.UMI),
root AS (SELECT cellBC, intBC, allele, UMI, arg_max(cur, k) AS root FROM chain GROUP BY cellBC, intBC, allele, UMI)
SELECT m.cellBC, m.intBC, m.allele, root.root AS UMI, cast(sum(m.readCount) AS bigint) AS readCount FROM alleles m JOIN root USING (cellBC, intBC, allele, UMI) GROUP BY m.cellBC, m.intBC, m.allele, root.root""",
    "alleles",
)(lambda t: molecules.correct_umis(t, 2, by_allele=True).select("cellBC", "intBC", "allele", "UMI", "readCount"))
PROP = "SELECT cellBC, sum(n - main) / sum(n) AS prop FROM (SELECT cellBC, intBC, sum(n) AS n, max(n) AS main FROM (SELECT cellBC, intBC, allele, count(*) AS n FROM alleles GROUP BY ALL) a GROUP BY ALL) b GROUP BY cellBC"
_query("conflicting_share", f"SELECT cellBC, round(prop, 9) AS prop FROM ({PROP}) p", "alleles")(lambda t: molecules.conflicting_share(t).withColumn("prop", F.round("prop", 9)))
_query("filter_intra_doublets", f"SELECT cellBC, intBC, UMI FROM alleles WHERE cellBC IN (SELECT cellBC FROM ({PROP}) p WHERE prop <= 0.76)", "alleles")(lambda t: molecules.filter_intra_doublets(t, 0.76).select("cellBC", "intBC", "UMI"))
CHOSEN = """SELECT cellBC, intBC, allele FROM (SELECT *, row_number() OVER (PARTITION BY cellBC, intBC ORDER BY n DESC, reads DESC, allele) AS rn
  FROM (SELECT cellBC, intBC, allele, count(*) AS n, sum(readCount) AS reads FROM alleles GROUP BY cellBC, intBC, allele) a) b WHERE rn = 1"""
_query("map_intbcs", f"SELECT cellBC, intBC, allele, UMI FROM alleles SEMI JOIN ({CHOSEN}) c USING (cellBC, intBC, allele)", "alleles")(lambda t: molecules.map_intbcs(t).select("cellBC", "intBC", "allele", "UMI"))
_query(
    "allele_table",
    f"""SELECT cellBC, intBC, allele, r1, r2, r3, count(UMI) AS UMI, cast(sum(readCount) AS bigint) AS readCount FROM alleles SEMI JOIN ({CHOSEN.replace("FROM alleles", f"FROM alleles WHERE cellBC IN ({GOOD_CELLS})")}) c
USING (cellBC, intBC, allele) GROUP BY cellBC, intBC, allele, r1, r2, r3""",
    "alleles",
)(lambda t: molecules.collapse_alleles(molecules.map_intbcs(molecules.filter_cells(t, 500, 25.5))))
_query("repeated_umis", "SELECT cellBC, intBC, substr(UMI, 1, 7) AS UMI, count(*) AS n FROM molecules GROUP BY cellBC, intBC, substr(UMI, 1, 7) HAVING count(*) > 1")(lambda t: molecules.repeated_umis(t.withColumn("UMI", F.substring("UMI", 1, 7))))
_query("molecule_statistics", "SELECT count(*) AS n_molecules, count(DISTINCT cellBC) AS n_cells, count(DISTINCT intBC) AS n_intbcs, avg(readCount) AS mean_reads, quantile_cont(readCount, 0.5) AS median_reads FROM molecules")(
    molecules.molecule_statistics
)
_query("read_histogram", "SELECT readCount, count(*) AS n FROM molecules GROUP BY readCount")(molecules.read_histogram)
_query("umi_hamming", "SELECT a.cellBC, a.intBC, a.UMI AS x, b.UMI AS y, cast(hamming(a.UMI, b.UMI) AS int) AS d FROM molecules a JOIN molecules b ON a.cellBC = b.cellBC AND a.intBC = b.intBC AND a.UMI < b.UMI WHERE hamming(a.UMI, b.UMI) <= 3")(
    lambda t: t.select("cellBC", "intBC", F.col("UMI").alias("x")).join(t.select("cellBC", "intBC", F.col("UMI").alias("y")), ["cellBC", "intBC"]).filter("x < y").withColumn("d", sequences.hamming("x", "y")).filter("d <= 3")
)

# -- lineages ------------------------------------------------------------------------------------------------------

SHARES = "sh AS (SELECT cell, intBC, n / sum(n) OVER (PARTITION BY cell) AS share FROM cell_barcodes)"
TOP = "top AS (SELECT intBC FROM sh GROUP BY intBC ORDER BY round(sum(share), 9) DESC, intBC LIMIT 1)"
CELLS = "tc AS (SELECT DISTINCT cell FROM sh WHERE intBC IN (SELECT intBC FROM top))"
BARS = "gb AS (SELECT intBC FROM sh WHERE cell IN (SELECT cell FROM tc) GROUP BY intBC HAVING count(*) / (SELECT count(*) FROM tc) >= 0.2)"
_query("barcode_shares", f"WITH {SHARES} SELECT cell, intBC, round(share, 9) AS share FROM sh", "cell_barcodes")(lambda t: lineages.shares(t).withColumn("share", F.round("share", 9)))
_query("top_intbc", f"WITH {SHARES}, {TOP} SELECT intBC FROM top", "cell_barcodes")(lambda t: lineages.top_intbc(lineages.shares(t)))


def _members(t):
    share = lineages.shares(t)
    return lineages.members(share, lineages.group_barcodes(share, lineages.top_intbc(share))).withColumn("kinship", F.round("kinship", 9))


_query("lineage_members", f"WITH {SHARES}, {TOP}, {CELLS}, {BARS} SELECT cell, round(sum(share), 9) AS kinship FROM sh WHERE intBC IN (SELECT intBC FROM gb) GROUP BY cell HAVING sum(share) >= 0.2", "cell_barcodes")(_members)
_query("assign_groups", source="cell_barcodes")(lineages.assign_groups)
GRP = "gr AS (SELECT DISTINCT cell, cast(cell % 4 + 1 AS int) AS lineageGrp FROM cell_barcodes)"
SIZE = "sz AS (SELECT lineageGrp, count(*) AS size FROM gr GROUP BY lineageGrp)"
PROFILE = f"""{GRP}, {SIZE}, hd AS (SELECT lineageGrp, intBC, count(DISTINCT cell_barcodes.cell) / any_value(size) AS presence FROM cell_barcodes JOIN gr USING (cell) JOIN sz USING (lineageGrp) GROUP BY lineageGrp, intBC),
pf AS (SELECT lineageGrp, intBC, presence FROM (SELECT *, max(presence) OVER (PARTITION BY lineageGrp) AS mx FROM hd) x WHERE presence / mx >= 0.5)"""


def _groups(t):
    return t.select("cell", (F.pmod("cell", F.lit(4)) + 1).cast("int").alias("lineageGrp")).distinct()


def _profiles(t):
    return lineages.group_profiles(t, _groups(t), 0.5)


_query("group_profiles", f"WITH {PROFILE} SELECT lineageGrp, intBC, round(presence, 9) AS presence FROM pf", "cell_barcodes")(lambda t: _profiles(t).withColumn("presence", F.round("presence", 9)))
_query(
    "score_kinships",
    f"""WITH {PROFILE}, {SHARES}, sc AS (SELECT cell, lineageGrp, round(sum(share), 9) AS kinship FROM sh JOIN pf USING (intBC) GROUP BY cell, lineageGrp)
SELECT c.cell, coalesce(arg.lineageGrp, 1) AS lineageGrp, coalesce(arg.kinship, 0) AS kinship FROM (SELECT DISTINCT cell FROM cell_barcodes) c
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY kinship DESC, lineageGrp) AS rn FROM sc) y WHERE rn = 1) arg ON c.cell = arg.cell""",
    "cell_barcodes",
)(lambda t: lineages.score_kinships(t, _profiles(t)).withColumn("kinship", F.round("kinship", 9)))
_query(
    "renumber_by_size",
    "WITH g AS (SELECT DISTINCT cell, cast(cell % 7 % 3 AS int) AS lineageGrp FROM cell_barcodes), s AS (SELECT lineageGrp, cast(row_number() OVER (ORDER BY count(*) DESC, lineageGrp DESC) AS int) AS r FROM g GROUP BY lineageGrp) SELECT cell, r AS lineageGrp FROM g JOIN s USING (lineageGrp)",
    "cell_barcodes",
)(lambda t: lineages.renumber_by_size(t.select("cell", F.pmod(F.pmod("cell", F.lit(7)), F.lit(3)).cast("int").alias("lineageGrp")).distinct()))
MEMBER = f"""WITH {PROFILE}, tot AS (SELECT lineageGrp, sum(presence) AS total FROM pf GROUP BY lineageGrp),
rw AS (SELECT cell, lineageGrp, sum(presence) / any_value(total) AS p FROM (SELECT DISTINCT cell, intBC FROM cell_barcodes) b JOIN pf USING (intBC) JOIN tot USING (lineageGrp) GROUP BY cell, lineageGrp),
ms AS (SELECT cell, lineageGrp, p / sum(p) OVER (PARTITION BY cell) AS membership FROM rw)"""
_query("memberships", f"{MEMBER} SELECT cell, lineageGrp, round(membership, 9) AS membership FROM ms", "cell_barcodes")(lambda t: lineages.memberships(t, _profiles(t)).withColumn("membership", F.round("membership", 9)))
_query("filter_inter_doublets", f"{MEMBER} SELECT cell, lineageGrp FROM gr JOIN ms USING (cell, lineageGrp) WHERE membership >= 0.24", "cell_barcodes")(lambda t: lineages.filter_inter_doublets(t, _groups(t), _profiles(t), 0.24))
_query("filter_group_barcodes", f"WITH {GRP}, {SIZE}, h AS (SELECT lineageGrp, intBC FROM cell_barcodes c JOIN gr USING (cell) JOIN sz USING (lineageGrp) GROUP BY lineageGrp, intBC HAVING count(DISTINCT cell) / any_value(size) > 0.4 AND intBC <> 'NC') SELECT cell, intBC, n, lineageGrp FROM cell_barcodes JOIN gr USING (cell) SEMI JOIN h USING (lineageGrp, intBC)", "cell_barcodes")(
    lambda t: lineages.filter_group_barcodes(t, _groups(t), 0.4)
)

# -- characters ----------------------------------------------------------------------------------------------------

LONG = "lg AS (SELECT cellBC, intBC || '_' || site AS character, indel FROM (SELECT cellBC, intBC, unnest(['r1', 'r2', 'r3']) AS site, unnest([r1, r2, r3]) AS indel FROM alleles) x)"
KEEP = "kp AS (SELECT character FROM (SELECT character, indel, count(*) AS n FROM (SELECT DISTINCT cellBC, character, indel FROM lg) y GROUP BY ALL) z GROUP BY character HAVING max(n) / sum(n) <= 0.6)"
CODES = "cd AS (SELECT character, indel, cast(row_number() OVER (PARTITION BY character ORDER BY min(cellBC), indel) AS int) AS state FROM lg WHERE NOT contains(lower(indel), 'none') GROUP BY character, indel UNION ALL SELECT DISTINCT character, indel, 0 FROM lg WHERE contains(lower(indel), 'none'))"
_query("lineage_profile", f"WITH {LONG} SELECT cellBC, character, array_to_string(list_sort(list(DISTINCT indel)), ',') AS indels FROM lg GROUP BY cellBC, character", "alleles")(lambda t: characters.lineage_profile(t).withColumn("indels", F.array_join("indels", ",")))
_query("informative_characters", f"WITH {LONG}, {KEEP} SELECT character FROM kp", "alleles")(lambda t: characters.informative_characters(t, 0.6))
_query("state_codes", f"WITH {LONG}, {CODES} SELECT character, indel, state FROM cd", "alleles")(characters.state_codes)
_query("character_matrix", f"WITH {LONG}, {KEEP}, {CODES} SELECT cellBC, character, array_to_string(list_sort(list(DISTINCT state)), ',') AS states FROM lg SEMI JOIN kp USING (character) JOIN cd USING (character, indel) GROUP BY cellBC, character", "alleles")(
    lambda t: characters.character_matrix(t, 0.6).withColumn("states", F.array_join(F.col("states").cast("array<string>"), ","))
)
_query("indel_priors", "SELECT indel, count(*) AS count, round(count(*) / (SELECT count(DISTINCT intBC) FROM alleles), 9) AS freq FROM (SELECT DISTINCT intBC, unnest([r1, r2, r3]) AS indel FROM alleles) x WHERE NOT contains(lower(indel), 'none') GROUP BY indel", "alleles")(
    lambda t: characters.indel_priors(t).withColumn("freq", F.round("freq", 9))
)
PACKED = "pk AS (SELECT cell, string_agg(coalesce(cast(state AS varchar), '?'), '|' ORDER BY site) AS states FROM characters GROUP BY cell)"
_query("equal_rows", f"WITH {PACKED} SELECT states, min(cell) AS seed, count(*) AS n FROM pk GROUP BY states", "characters")(lambda t: characters.equal_rows(t).drop("cells"))
_query("uninformative_sites", "SELECT dataset, site FROM characters GROUP BY dataset, site HAVING coalesce(bool_and(state = 0), true)", "characters")(lambda t: characters.uninformative_sites(t, by=("dataset",)))
_query(
    "informative_matrix",
    "SELECT dataset, cell, site, state FROM characters ANTI JOIN (SELECT dataset, site FROM characters GROUP BY dataset, site HAVING coalesce(bool_and(state = 0), true)) u USING (dataset, site)",
    "characters",
)(lambda t: characters.without_uninformative(t, by=("dataset",)).select("dataset", "cell", "site", "state"))
_query("all_missing_sites", "SELECT cell, site, state FROM characters SEMI JOIN (SELECT dataset, site FROM characters GROUP BY dataset, site HAVING count(state) > 0) k USING (dataset, site)", "characters")(
    lambda t: characters.without_all_missing(t, by=("dataset",)).select("cell", "site", "state")
)
_query("average_rows", "SELECT dataset, site, round(avg(state), 9) AS mean FROM characters GROUP BY dataset, site", "characters")(lambda t: characters.average_rows(t, by=("dataset",)).withColumn("mean", F.round("mean", 9)))
_query("chi_square", """WITH o AS (SELECT dataset, site, state, count(*) AS n FROM characters WHERE state IS NOT NULL GROUP BY dataset, site, state),
m AS (SELECT *, sum(n) OVER (PARTITION BY dataset, site) AS r, sum(n) OVER (PARTITION BY dataset, state) AS c, sum(n) OVER (PARTITION BY dataset) AS t FROM o)
SELECT dataset, round(CAST(sum(n * n * t / CAST(r AS DOUBLE) / c) - any_value(t) AS DOUBLE), 6) AS chi2 FROM m GROUP BY dataset""", "characters")(
    lambda t: characters.chi_square(t, "site", "state", by=("dataset",)).withColumn("chi2", F.round("chi2", 6))
)
_query("site_statistics", "SELECT site, count(*) - count(state) AS missing, count(*) FILTER (state = 0) AS zero, count(DISTINCT CASE WHEN state > 0 THEN state END) AS alphabet FROM characters GROUP BY site", "characters")(characters.site_statistics)
_query("recoded_states", "WITH c AS (SELECT site, state, cast(row_number() OVER (PARTITION BY site ORDER BY state) AS int) AS code FROM (SELECT DISTINCT site, state FROM characters WHERE state > 0) d) SELECT cell, characters.site, CASE WHEN characters.state = 0 THEN 0 ELSE code END AS state FROM characters LEFT JOIN c ON characters.site = c.site AND characters.state = c.state", "characters")(
    characters.recoded
)
_query("site_priors", "SELECT site, state, 1 / count(*) OVER (PARTITION BY site) AS q FROM (SELECT DISTINCT site, state FROM characters WHERE state > 0) d", "characters")(characters.site_priors)
_query("mutation_rate", "SELECT round(0 - ln(1 - count(*) FILTER (state > 0) / count(state)), 9) AS rate FROM characters", "characters")(lambda t: characters.mutation_rate(t).withColumn("rate", F.round("rate", 9)))

# -- distances and trees -------------------------------------------------------------------------------------------

PAIR = "FROM characters x JOIN characters y ON x.dataset = y.dataset AND x.site = y.site AND x.cell < y.cell GROUP BY x.cell, y.cell"
_query(
    "weighted_hamming",
    f"""SELECT x.cell AS a, y.cell AS b, round(coalesce(sum(CASE WHEN x.state IS NULL OR y.state IS NULL THEN NULL WHEN x.state = y.state THEN 0 WHEN x.state = 0 OR y.state = 0 THEN 1 ELSE 2 END)
 / nullif(count(*) FILTER (x.state IS NOT NULL AND y.state IS NOT NULL), 0), 0), 9) AS d {PAIR}""",
    "characters",
)(lambda t: distances.weighted_hamming(t, by=("dataset",)).withColumn("d", F.round("d", 9)))
COUNTS = f"""SELECT x.cell AS a, y.cell AS b, count(*) FILTER (x.state = 0 AND y.state = 0) AS z_z, count(*) FILTER (x.state = 0 AND y.state > 0) AS z_a, count(*) FILTER (x.state > 0 AND y.state = 0) AS a_z,
 count(*) FILTER (x.state > 0 AND x.state = y.state) AS a_a, count(*) FILTER (x.state > 0 AND y.state > 0 AND x.state <> y.state) AS a_b, count(*) FILTER (x.state IS NULL AND y.state IS NOT NULL) AS m_k,
 count(*) FILTER (x.state IS NOT NULL AND y.state IS NULL) AS k_m, count(*) FILTER (x.state IS NULL AND y.state IS NULL) AS m_m {PAIR}"""
_query("pair_counts", COUNTS, "characters")(lambda t: distances.pair_counts(t, by=("dataset",)))
_query("pairwise_branch_estimates", f"SELECT a, b, round(0 - ln(z_z / (z_z + a_z)), 9) AS d_a, round(0 - ln(z_z / (z_z + z_a)), 9) AS d_b FROM ({COUNTS}) c WHERE z_z > 0", "characters")(
    lambda t: distances.pairwise_branch_estimates(t, by=("dataset",)).select("a", "b", F.round("d_a", 9).alias("d_a"), F.round("d_b", 9).alias("d_b"))
)
_query("ancestors", f"WITH RECURSIVE {CLOSURE} SELECT node, ancestor, up, round(length, 9) AS length FROM up", "tree")(
    lambda t: distances.ancestors(t).select("node", "ancestor", "up", F.round("length", 9).alias("length"))
)
_query("node_depths", f"WITH RECURSIVE {CLOSURE}, {DEPTHS} SELECT node, root, depth, round(height, 9) AS height FROM nd", "tree")(lambda t: distances.node_depths(t).withColumn("height", F.round("height", 9)))
LCA = f"WITH RECURSIVE {CLOSURE}, lf AS (SELECT up.* FROM up JOIN tree USING (node) WHERE is_leaf), pr AS (SELECT a.node AS a, b.node AS b, arg_min(a.ancestor, a.up) AS lca, arg_min(a.length + b.length, a.up) AS distance FROM lf a JOIN lf b ON a.ancestor = b.ancestor AND a.node < b.node GROUP BY a.node, b.node)"
_query("leaf_lcas", f"{LCA} SELECT a, b, lca, round(distance, 9) AS distance FROM pr", "tree")(lambda t: distances.leaf_lcas(t).withColumn("distance", F.round("distance", 9)))
_query("tree_coupling", f"{LCA} SELECT lca, count(*) AS n, round(avg(distance), 9) AS mean_distance FROM pr GROUP BY lca", "tree")(lambda t: distances.tree_coupling(t).withColumn("mean_distance", F.round("mean_distance", 9)))


def _regrafted(t):
    """The same trees with two grandchildren of different children of the root swapped, where there are such."""
    local = F.col("node") - F.col("dataset") * SPAN
    return t.withColumn("parent", F.when((F.col("dataset") % 2 == 0) & (local == 5), F.col("parent") + 1).when((F.col("dataset") % 2 == 0) & (local == 6), F.col("parent") - 1).otherwise(F.col("parent")))


SIDE = "SELECT ancestor, string_agg(cast(u.node AS varchar), ',' ORDER BY u.node) AS side, count(*) AS n FROM up u JOIN tree t ON u.node = t.node JOIN tree x ON u.ancestor = x.node WHERE t.is_leaf AND u.up > 0 AND x.parent IS NOT NULL GROUP BY ancestor HAVING count(*) > 1"
_query("bipartitions", f"WITH RECURSIVE {CLOSURE}, {DEPTHS} SELECT ancestor, root, side, n FROM ({SIDE}) s JOIN nd ON s.ancestor = nd.node", "tree")(distances.bipartitions)
_SPLIT = """s{i} AS (SELECT DISTINCT root, CASE WHEN list_contains(side, least) THEN list_sort(list_filter(every, lambda x: NOT list_contains(side, x))) ELSE side END AS split FROM (
 SELECT root, ancestor, list_sort(list(node)) AS side FROM {up} JOIN lv{i} USING (node) GROUP BY root, ancestor) b JOIN (SELECT root, count(*) AS total, min(node) AS least, list(node) AS every FROM lv{i} GROUP BY root) w USING (root) WHERE len(side) > 1 AND len(side) < total - 1)"""
_LV = "lv{i} AS (SELECT node, arg_max(ancestor, up) AS root FROM {up} SEMI JOIN (SELECT node FROM tree WHERE is_leaf) k USING (node) GROUP BY node)"
_query(
    "robinson_foulds",
    f"""WITH RECURSIVE {CLOSURE}, tree2 AS (SELECT node, CASE WHEN dataset % 2 = 0 AND node - dataset * {SPAN} = 5 THEN parent + 1 WHEN dataset % 2 = 0 AND node - dataset * {SPAN} = 6 THEN parent - 1 ELSE parent END AS parent, brlen FROM tree),
{CLOSURE.replace("up AS (SELECT node, node", "up2 AS (SELECT node, node").replace("FROM up JOIN tree t", "FROM up2 up JOIN tree2 t")},
{_LV.format(i=1, up="up")}, {_LV.format(i=2, up="up2")}, {_SPLIT.format(i=1, up="up")}, {_SPLIT.format(i=2, up="up2")}
SELECT root, count(*) FILTER (j IS NULL) AS only_first, count(*) FILTER (i IS NULL) AS only_second, count(*) FILTER (i = 1 AND j = 1) AS shared,
 round((count(*) FILTER (j IS NULL) + count(*) FILTER (i IS NULL)) / (count(*) FILTER (j IS NULL) + count(*) FILTER (i IS NULL) + 2 * count(*) FILTER (i = 1 AND j = 1)), 9) AS rf
FROM (SELECT root, split, 1 AS i FROM s1) a FULL JOIN (SELECT root, split, 1 AS j FROM s2) b USING (root, split) GROUP BY root""",
    "tree",
)(lambda t: distances.robinson_foulds(t, _regrafted(t)).withColumn("rf", F.round("rf", 9)))


def _leaves(spark, sf_dir):
    cells = derive(spark, sf_dir, "characters").select(F.col("cell").alias("node"), "dataset", "site", "state")
    return cells.join(derive(spark, sf_dir, "tree").filter("is_leaf").select("node"), "node", "left_semi")


LEAVES = "lv AS (SELECT cell AS node, dataset, site, state FROM characters SEMI JOIN (SELECT node AS cell FROM tree WHERE is_leaf) k USING (cell))"
STATES = f"""{CLOSURE}, {DEPTHS}, {LEAVES}, ow AS (SELECT ancestor, site, CASE WHEN min(state) = max(state) THEN min(state) WHEN count(state) > 0 THEN 0 END AS own FROM up JOIN lv USING (node) GROUP BY ancestor, site),
st AS (SELECT node, site, coalesce(state, 0) AS state FROM (SELECT node, site FROM nd JOIN (SELECT DISTINCT root, site FROM lv JOIN nd USING (node)) s USING (root)) e
 LEFT JOIN (SELECT node, site, arg_min(own, up) AS state FROM up JOIN ow USING (ancestor) WHERE own IS NOT NULL GROUP BY node, site) f USING (node, site))"""
MOVES = """mv AS (SELECT nd.root, c.site, c.state, c.node, p.state AS before, c.state <> 0 AND c.state <> coalesce(p.state, 0) AS moved
 FROM st c JOIN tree t ON c.node = t.node JOIN nd ON nd.node = c.node LEFT JOIN st p ON p.node = t.parent AND p.site = c.site)"""


#: Trees and leaves come in sets, in which a tree lies whole.
SETS = ("dataset",)


def _on_trees(name, sql, f):
    """A query on the trees and their leaves' states, which are derived once and stored, as most steps read them."""
    QUERIES[name] = lambda spark, sf_dir: f(stored(derive(spark, sf_dir, "tree")), stored(_leaves(spark, sf_dir)))
    if sql is not None:
        SQL[name] = with_derived(sql)


def _fifths(leaves):
    return leaves.select("site").distinct().select("site", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("state"), F.lit(0.2).alias("q"))


_on_trees("ancestral_states", f"WITH RECURSIVE {STATES} SELECT node, site, state FROM st", lambda t, v: distances.ancestral_states(t, v, SETS))
_on_trees(
    "small_parsimony",
    f"WITH RECURSIVE {STATES}, {MOVES} SELECT root, site, count(*) FILTER (moved) AS changes, round(count(*) FILTER (moved) * -ln(0.2e0), 6) AS score FROM mv GROUP BY root, site",
    lambda t, v: distances.small_parsimony(t, v, _fifths(v), SETS).withColumn("score", F.round("score", 6)),
)
_on_trees(
    "parsimony_scores",
    f"WITH RECURSIVE {STATES}, {MOVES} SELECT root, CAST(count(*) FILTER (moved) AS double) AS score, round(count(*) FILTER (moved) / (SELECT count(*) FROM nd JOIN tree i USING (node) WHERE nd.root = mv.root AND NOT i.is_leaf), 9) AS normalised FROM mv GROUP BY root",
    lambda t, v: distances.parsimony_scores(t, v, by=SETS).withColumn("normalised", F.round("normalised", 9)),
)
_on_trees(
    "site_mutations",
    f"WITH RECURSIVE {STATES}, {MOVES} SELECT root, site, node, before, state AS after FROM mv WHERE before <> state",
    lambda t, v: distances.site_mutations(t, v, SETS),
)
_on_trees(
    "allelic_coupling",
    f"""{LCA}, {LEAVES}, pz AS (
  SELECT x.node AS a, y.node AS b, x.site, x.state AS x, y.state AS y,
    CASE WHEN x.state IS NOT DISTINCT FROM y.state OR y.state IS NULL THEN x.state WHEN x.state IS NULL THEN y.state ELSE 0 END AS z
  FROM lv x JOIN lv y ON x.dataset = y.dataset AND x.site = y.site AND x.node < y.node),
cs AS (
  SELECT a, b, string_agg(coalesce(CAST(z AS varchar), '?'), '|' ORDER BY site) AS consensus,
    CAST(sum(CASE WHEN x <> z THEN 1 ELSE 0 END + CASE WHEN y <> z THEN 1 ELSE 0 END) AS bigint) AS d FROM pz GROUP BY a, b)
SELECT a, b, round(distance, 9) AS distance, consensus, d FROM pr JOIN cs USING (a, b)""",
    lambda t, v: distances.allelic_coupling(t, v, by=("dataset",)).withColumns(
        {"distance": F.round("distance", 9), "consensus": F.array_join(F.col("consensus").cast("array<string>"), "|", "?")}
    ),
)
_on_trees(
    "coupled_leaves",
    f"""WITH RECURSIVE {STATES}, lf AS (SELECT up.* FROM up JOIN tree USING (node) WHERE is_leaf),
pr AS (SELECT a.node AS a, b.node AS b, arg_min(a.ancestor, a.up) AS lca, arg_min(a.length + b.length, a.up) AS distance
  FROM lf a JOIN lf b ON a.ancestor = b.ancestor AND a.node < b.node GROUP BY a.node, b.node),
sq AS (SELECT node AS lca, string_agg(CAST(state AS varchar), '|' ORDER BY site) AS states FROM st GROUP BY node)
SELECT a, b, lca, round(distance, 9) AS distance, states FROM pr JOIN sq USING (lca)""",
    lambda t, v: distances.coupled_leaves(t, v, SETS).withColumns(
        {"distance": F.round("distance", 9), "states": F.array_join(F.col("states").cast("array<string>"), "|")}
    ),
)
_on_trees(
    "edge_partition",
    f"""WITH RECURSIVE {CLOSURE}, {LEAVES} SELECT ancestor AS node, site, CASE WHEN count(state) = 0 THEN '?' WHEN min(state) = 0 OR min(state) <> max(state) THEN 'z' ELSE CAST(min(state) AS varchar) END AS tag
FROM up JOIN lv USING (node) GROUP BY ancestor, site""",
    lambda t, v: ancestry.edge_partition(distances.ancestors(t), v),
)


def _asked(tree):
    """Leaves of a tree by the last digits of their numbers; every seventh query also has a node that no tree has, or two trees."""
    leaves = tree.filter("is_leaf").select((F.col("dataset") * 5 + F.col("node") % 5).alias("query"), "node")
    odd = leaves.select("query").distinct().filter("query % 7 = 0")
    far = leaves.filter("query % 35 = 5").select((F.col("query") + 5).alias("query"), "node")
    return leaves.unionByName(odd.select("query", (-F.col("query") - 1).alias("node"))).unionByName(far)


_query(
    "common_ancestors",
    f"""WITH RECURSIVE {CLOSURE}, {DEPTHS}, lf AS (SELECT dataset * 5 + node % 5 AS query, node FROM tree WHERE is_leaf),
ak AS (SELECT query, node FROM lf UNION SELECT query, -query - 1 FROM lf WHERE query % 7 = 0 UNION SELECT query + 5, node FROM lf WHERE query % 35 = 5),
kn AS (SELECT query, count(nd.node) AS n_known, count(*) - count(nd.node) AS n_unknown FROM ak LEFT JOIN nd USING (node) GROUP BY query),
cm AS (SELECT query, ancestor, count(*) AS n FROM ak JOIN up USING (node) GROUP BY query, ancestor),
lc AS (SELECT query, arg_max(cm.ancestor, depth) AS lca FROM cm JOIN kn USING (query) JOIN nd ON nd.node = cm.ancestor WHERE n = n_known GROUP BY query)
SELECT query, lca, n_known, n_unknown FROM kn LEFT JOIN lc USING (query)""",
    "tree",
)(lambda t: ancestry.common_ancestors(t, _asked(t)))


def _rounded(df, *kept):
    """All other columns to six places, arrays as text."""
    def to(c, kind):
        if kind.startswith("array"):
            return F.array_join(F.transform(c, lambda x: F.round(x, 6).cast("string")), "|").alias(c)
        return F.round(c, 6).alias(c)

    return df.select(*kept, *[to(c, t) for c, t in df.dtypes if c not in kept])


_on_trees("state_posteriors", None, lambda t, v: _rounded(likelihood.outside_pass(t, v, _fifths(v), 0.1, 0.05, SETS), "root", "node", "site"))
_on_trees(
    "expected_transitions", None,
    lambda t, v: _rounded(likelihood.tree_transitions(t, v, _fifths(v), 0.1, 0.05, SETS), "root", "node"),
)
_query(
    "spatial_likelihood",
    f"""WITH RECURSIVE {CLOSURE}, {DEPTHS}, pl AS (SELECT node, node * 17 % 101 / 10e0 AS x, node * 29 % 97 / 10e0 AS y FROM tree WHERE node % 11 <> 3),
eg AS (SELECT root, 0.7e0 * sqrt(t.brlen) AS s, c.x - p.x AS dx, c.y - p.y AS dy FROM tree t JOIN nd USING (node) JOIN pl c ON c.node = t.node JOIN pl p ON p.node = t.parent WHERE t.brlen > 0)
SELECT root, round(coalesce(llh, 0), 6) AS llh FROM (SELECT DISTINCT root FROM nd) r LEFT JOIN (SELECT root, sum(-(0.5e0 * (dx / s) ** 2 + ln(s)) - (0.5e0 * (dy / s) ** 2 + ln(s))) AS llh FROM eg GROUP BY root) e USING (root)""",
    "tree",
)(
    lambda t: likelihood.spatial_likelihood(
        t, t.filter("node % 11 <> 3").select("node", (F.col("node") * 17 % 101 / 10.0).alias("x"), (F.col("node") * 29 % 97 / 10.0).alias("y")), 0.7
    ).withColumn("llh", F.round("llh", 6))
)


def _scored(c, soft):
    """Truths with dropouts, and estimates that are missing at every third site, sure, or torn between two states."""
    state = F.col("state").cast("string")
    told = F.when(F.col("site") % 3 == 0, "?").when(F.col("state").isNull(), "-1:0.6/0:0.4").when(F.col("site") % 3 == 1, F.concat(state, F.lit(":0.7/-1:0.3")))
    told = F.coalesce(told, F.concat(F.lit("0:0.5/"), (F.col("state") + 1).cast("string"), F.lit(":0.5")))
    truth = c.select(F.col("cell").alias("label"), "site", F.coalesce(state, F.lit("d")).alias("state"))
    estimates = c.select(F.col("cell").alias("label"), "site", F.when(told != "?", sequences.soft_states(told)).alias("probs"))
    return evaluation.score_sequences(truth, estimates, soft).withColumn("score", F.round("score", 9))


for _name, _soft, _values in (("sequence_scores", True, ("0.4e0", "0.7e0", "0.5e0")), ("hard_sequence_scores", False, ("0e0", "1e0", "1e0"))):
    _query(
        _name,
        f"""SELECT cell AS label, round(avg(v), 9) AS score, count(v) AS n_sites FROM (SELECT cell, CASE WHEN site % 3 = 0 THEN NULL WHEN state IS NULL THEN {_values[0]} WHEN site % 3 = 1 THEN {_values[1]}
WHEN state = 0 THEN {_values[2]} ELSE 0e0 END AS v FROM characters) x GROUP BY cell""",
        "characters",
    )(lambda c, soft=_soft: _scored(c, soft))
_on_trees("annotations", None, lambda t, v: evaluation.tree_annotations(t, v, _fifths(v), 0.1, 0.05, SETS))
_query("aligned_branches", "SELECT coalesce(a.node, b.node) AS node, a.brlen AS first, b.brlen AS second FROM (SELECT * FROM tree WHERE NOT is_leaf) a FULL JOIN (SELECT node, brlen * 2 AS brlen FROM tree WHERE parent IS NOT NULL) b ON a.node = b.node", "tree")(
    lambda t: distances.aligned_branches(t.filter("not is_leaf"), t.filter("parent is not null").withColumn("brlen", F.col("brlen") * 2))
)
_query(
    "pruned_trees",
    f"""WITH RECURSIVE {CLOSURE}, {DEPTHS}, kp AS (SELECT node FROM tree WHERE is_leaf AND brlen > 0.2e0), dn AS (SELECT u.node, u.ancestor, u.up FROM up u SEMI JOIN kp ON u.node = kp.node),
vi AS (SELECT dn.ancestor, dn.node, dn.up, c.ancestor AS via FROM dn LEFT JOIN up c ON c.node = dn.node AND c.up = dn.up - 1),
sy AS (SELECT ancestor AS node, bool_or(up = 0) AS is_leaf FROM vi GROUP BY ancestor HAVING count(DISTINCT via) > 1 OR bool_or(up = 0)),
nr AS (SELECT u.node, arg_min(u.ancestor, u.up) AS parent, arg_min(u.length, u.up) AS length FROM up u JOIN sy a ON u.node = a.node JOIN sy b ON u.ancestor = b.node WHERE u.up > 0 GROUP BY u.node)
SELECT sy.node, nr.parent, round(coalesce(nr.length, nd.height + t.brlen), 9) AS brlen, sy.is_leaf FROM sy LEFT JOIN nr ON sy.node = nr.node JOIN nd ON nd.node = sy.node JOIN tree t ON t.node = nd.root""",
    "tree",
)(lambda t: distances.pruned(t, t.filter("is_leaf and brlen > 0.2").select("node")).withColumn("brlen", F.round("brlen", 9)))
_query(
    "duplicates_attached",
    """WITH cp AS (SELECT node AS seed, node + 10000000 AS copy FROM tree WHERE is_leaf AND brlen > 0.4e0)
SELECT CASE WHEN seed IS NULL THEN node ELSE -node END AS node, parent, brlen, is_leaf AND seed IS NULL AS is_leaf FROM tree LEFT JOIN cp ON node = seed
UNION ALL SELECT seed, -seed, 0.005e0, true FROM cp UNION ALL SELECT copy, -seed, 0.005e0, true FROM cp""",
    "tree",
)(lambda t: distances.with_duplicates(t, t.filter("is_leaf and brlen > 0.4").select(F.col("node").alias("seed"), (F.col("node") + 10000000).alias("copy"))))

_on_trees(
    "level_likelihood",
    # one value column for each state: zero, silent and the five mutations, as lists; levels from the deepest up
    f"WITH RECURSIVE {CLOSURE}, {DEPTHS}, {LEAVES}, l0 AS (SELECT node, site, CASE WHEN state IS NULL THEN ln(0.05e0) WHEN state = 0 THEN ln(0.95e0) ELSE -1e6 END AS z, CASE WHEN state IS NULL THEN 0e0 ELSE -1e6 END AS sl, list_transform([1, 2, 3, 4, 5], lambda k: CASE WHEN state IS NULL THEN ln(0.05e0) WHEN state = k THEN ln(0.95e0) ELSE -1e6 END) AS al FROM lv), v6 AS (SELECT * FROM l0 WHERE false)"
    + "".join(f""", e{k} AS (SELECT *, greatest(z - d * 1.1e0, sl + ln(1 - exp(-d * 0.1e0)), list_max(al) + ln(0.2e0 * (1 - exp(-d))) - d * 0.1e0) AS m FROM
 (SELECT coalesce(t.parent, t.node) AS node, v.site, t.brlen AS d, z, sl, al FROM (SELECT l0.* FROM l0 UNION ALL SELECT * FROM v{k + 1}) v JOIN tree t ON v.node = t.node JOIN nd ON nd.node = v.node AND nd.depth = {k}) x),
v{k} AS (SELECT node, site, sum(m + ln(exp(z - d * 1.1e0 - m) + exp(sl + ln(1 - exp(-d * 0.1e0)) - m) + list_sum(list_transform(al, lambda a: exp(a + ln(0.2e0 * (1 - exp(-d))) - d * 0.1e0 - m))))) AS z, greatest(-1e7, sum(sl)) AS sl,
 [greatest(-1e7, sum(al2[1])), greatest(-1e7, sum(al2[2])), greatest(-1e7, sum(al2[3])), greatest(-1e7, sum(al2[4])), greatest(-1e7, sum(al2[5]))] AS al
 FROM (SELECT *, list_transform(al, lambda a: greatest(a - d * 0.1e0, sl + ln(1 - exp(-d * 0.1e0))) + ln(exp(a - d * 0.1e0 - greatest(a - d * 0.1e0, sl + ln(1 - exp(-d * 0.1e0)))) + exp(sl + ln(1 - exp(-d * 0.1e0)) - greatest(a - d * 0.1e0, sl + ln(1 - exp(-d * 0.1e0)))))) AS al2 FROM e{k}) y GROUP BY node, site)""" for k in range(5, -1, -1))
    + " SELECT node AS root, site, round(z, 6) AS llh FROM v0",
    lambda t, v: likelihood.level_likelihood(t, v, _fifths(v), 0.1, 0.05).withColumn("llh", F.round("llh", 6)),
)

# -- inference and simulation ----------------------------------------------------------------------------------------


def _simulated(spark):
    return simulation.simulate(simulation.balanced_tree(spark, 6, 0.2), simulation.uniform_priors(spark, 7, 5), 6, 0.1, 0.05)


def _inference_data(spark):
    leaves = _simulated(spark).filter("is_leaf").select(F.col("node").alias("cell"), "site", F.when(F.col("state") >= 0, F.col("state")).alias("state"))
    return inference.data_from(leaves)


def _tree_text() -> str:
    """The balanced tree that the states were simulated on."""
    text = lambda i: (f"({text(2 * i)},{text(2 * i + 1)})" if i < 64 else str(i)) + ":0.2"
    return text(1) + ";"


QUERIES["fit_tree"] = lambda spark, sf_dir: inference.multi_start(spark, _tree_text(), _inference_data(spark), 4, settings=inference.Settings(tolerance=1e-6, most_rounds=200))
QUERIES["search_topology"] = lambda spark, sf_dir: inference.search(spark, _tree_text(), _inference_data(spark), most_moves=2)
QUERIES["simulate_characters"] = lambda spark, sf_dir: _simulated(spark)

# -- streaming -----------------------------------------------------------------------------------------------------

QUERIES["streamed_molecule_counts"] = lambda spark, sf_dir: streaming.drained_counts(spark, sf_dir)
SQL["streamed_molecule_counts"] = "SELECT user_id AS cell, event_type AS intBC, count(*) AS n FROM events GROUP BY user_id, event_type"

QUERIES["streamed_window_counts"] = lambda spark, sf_dir: streaming.drained_windows(spark, sf_dir)
SQL["streamed_window_counts"] = """
SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M') AS started, event_type AS intBC, count(*) AS n
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
"""

# -- preprocess stages ---------------------------------------------------------------------------------------------

QUERIES |= preprocess.QUERIES
SQL |= preprocess.SQL

# -- texts, transforms, priors, results, heat maps and triplets --------------------------------------------------------

QUERIES |= phylogeny.QUERIES
SQL |= phylogeny.SQL
