"""Queries on texts and transforms of trees, priors, results of runs, heat maps and triplets, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladewright.operators import characters, distances, heatmaps, priors, results, tours, transforms, triplets
from cladewright.operators.stored import stored
from cladewright.plans.fragments import CLOSURE, DEPTHS
from cladewright.sources import newick
from cladewright.sources.derived import derive, with_derived

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, f, sql: str | None, source: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(derive(spark, sf_dir, source))
    if sql is not None:
        SQL[name] = with_derived(sql)


# -- walks and texts ---------------------------------------------------------------------------------------------------

_query(
    "subtree_sizes",
    tours.subtree_sizes,
    f"WITH RECURSIVE {CLOSURE}, {DEPTHS} SELECT ancestor AS node, any_value(root) AS root, count(*) AS size FROM up JOIN nd USING (node) GROUP BY ancestor",
    "tree",
)
_query(
    "newick_texts",
    tours.newick,
    """WITH RECURSIVE pt AS (
  SELECT node, [node] AS path, node AS root FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.node, list_append(path, t.node), root FROM pt JOIN tree t ON t.parent = pt.node),
od AS (SELECT node, brlen, is_leaf, parent IS NOT NULL AND row_number() OVER (PARTITION BY parent ORDER BY node) > 1 AS later FROM tree),
tk AS (
  SELECT root, path AS place, CASE WHEN later THEN ',' ELSE '' END || CASE WHEN is_leaf THEN '' ELSE '(' END AS token FROM pt JOIN od USING (node)
  UNION ALL SELECT root, list_append(path, 9000000000000), CASE WHEN is_leaf THEN '' ELSE ')' END || node || ':' || brlen FROM pt JOIN od USING (node))
SELECT root, string_agg(token, '' ORDER BY place) || ';' AS newick FROM tk GROUP BY root""",
    "tree",
)


def _round_trip(tree):
    """Edges of the trees' texts, by the names of nodes."""
    texts = tours.newick(tree).select(F.col("root").alias("tree"), "newick")
    found = newick.edges(texts)
    above = found.select(F.col("node").alias("parent"), F.col("label").alias("above"))
    return found.join(above, "parent", "left").select("tree", "label", "above", "brlen", "is_leaf")


_query(
    "newick_edges",
    _round_trip,
    f"WITH RECURSIVE {CLOSURE}, {DEPTHS} SELECT root AS tree, CAST(node AS varchar) AS label, CAST(parent AS varchar) AS above, brlen, is_leaf FROM tree JOIN nd USING (node)",
    "tree",
)

# -- transforms --------------------------------------------------------------------------------------------------------

_query(
    "scaled_trees",
    lambda t: transforms.scaled(t, 2.5).withColumns({"brlen": F.round("brlen", 9), "rate": F.round("rate", 9)}),
    f"""WITH RECURSIVE {CLOSURE}, {DEPTHS}, rt AS (SELECT root, nullif(max(height) / 2.5e0, 0) AS rate FROM nd GROUP BY root)
SELECT node, parent, round(coalesce(brlen / rate, brlen), 9) AS brlen, is_leaf, round(rate, 9) AS rate FROM tree JOIN nd USING (node) JOIN rt USING (root)""",
    "tree",
)
_query(
    "collapsed_trees",
    lambda t: transforms.collapsed(t, 0.25),
    f"""WITH RECURSIVE {CLOSURE}, kp AS (SELECT * FROM tree WHERE is_leaf OR parent IS NULL OR brlen > 0.25e0),
nr AS (SELECT up.node, arg_min(ancestor, up) AS parent FROM up JOIN kp ON kp.node = ancestor WHERE up > 0 GROUP BY up.node)
SELECT node, nr.parent, brlen, is_leaf FROM kp LEFT JOIN nr USING (node)""",
    "tree",
)
_query(
    "resolved_trees",
    lambda t: transforms.resolved(t, 0.001),
    """WITH ch AS (
  SELECT node, parent, row_number() OVER w AS r, count(*) OVER (PARTITION BY parent) AS k, lag(node) OVER w AS prior, (SELECT max(node) - min(node) + 1 FROM tree) AS span
  FROM tree WHERE parent IS NOT NULL WINDOW w AS (PARTITION BY parent ORDER BY node)),
ab AS (SELECT *, CASE WHEN r > 2 THEN prior + span ELSE parent END AS above FROM ch WHERE k > 2)
SELECT t.node, CASE WHEN r = 1 THEN t.parent WHEN r < k THEN t.node + span WHEN r = k THEN above ELSE t.parent END AS parent, brlen, is_leaf, false AS mark FROM tree t LEFT JOIN ab USING (node)
UNION ALL SELECT node + span, above, 0.001e0, false, true FROM ab WHERE r > 1 AND r < k""",
    "tree",
)
_query(
    "subsampled_trees",
    lambda t: transforms.subsampled(t, 6, 7).withColumn("brlen", F.round("brlen", 9)),
    f"""WITH RECURSIVE {CLOSURE}, {DEPTHS},
kp AS (SELECT node FROM (SELECT node, row_number() OVER (PARTITION BY root ORDER BY md5('7:' || node), node) AS r FROM tree JOIN nd USING (node) WHERE is_leaf) x WHERE r <= 6),
dn AS (SELECT u.node, u.ancestor, u.up FROM up u SEMI JOIN kp ON u.node = kp.node),
vi AS (SELECT dn.ancestor, dn.node, dn.up, c.ancestor AS via FROM dn LEFT JOIN up c ON c.node = dn.node AND c.up = dn.up - 1),
sy AS (SELECT ancestor AS node, bool_or(up = 0) AS is_leaf FROM vi GROUP BY ancestor HAVING count(DISTINCT via) > 1 OR bool_or(up = 0)),
nr AS (SELECT u.node, arg_min(u.ancestor, u.up) AS parent, arg_min(u.length, u.up) AS length FROM up u JOIN sy a ON u.node = a.node JOIN sy b ON u.ancestor = b.node WHERE u.up > 0 GROUP BY u.node)
SELECT sy.node, nr.parent, round(coalesce(nr.length, nd.height + t.brlen), 9) AS brlen, sy.is_leaf FROM sy LEFT JOIN nr USING (node) JOIN nd ON nd.node = sy.node JOIN tree t ON t.node = nd.root""",
    "tree",
)

# -- priors ------------------------------------------------------------------------------------------------------------


def _reconciled(characters):
    """Keys that are as many as the sites, that are all named, that are shifted with one missing, and names without digits."""
    kind, site = F.col("dataset") % 4, F.col("site")
    known = characters.filter("state is not null").filter(~((kind == 2) & (site == 3)) & ~((kind == 3) & (site > 5)))
    given = known.select("dataset", F.when(kind == 0, site * 10).otherwise(site).alias("key"), "state", (F.col("state") / 15.0).alias("q")).distinct()
    more = characters.filter(kind == 1).select("dataset", F.lit(50).alias("key"), F.lit(1).alias("state"), F.lit(1.0).alias("q")).distinct()
    name = F.when((kind == 3) & (site == 2), "x").when(kind >= 2, F.concat(F.lit("r"), site + 20)).otherwise(F.concat(F.lit("r"), site))
    sites = characters.select("dataset", "site", name.alias("site_name")).distinct()
    return priors.reconciled_priors(given.unionByName(more), sites, characters, ("dataset",)).withColumn("q", F.round("q", 9))


_query(
    "reconciled_priors",
    _reconciled,
    r"""WITH pr AS (
  SELECT DISTINCT dataset, CASE dataset % 4 WHEN 0 THEN site * 10 ELSE site END AS key, state, state / 15e0 AS q FROM characters
  WHERE state IS NOT NULL AND NOT (dataset % 4 = 2 AND site = 3) AND NOT (dataset % 4 = 3 AND site > 5)
  UNION ALL SELECT DISTINCT dataset, 50, 1, 1e0 FROM characters WHERE dataset % 4 = 1),
nm AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY site) AS r, count(*) OVER (PARTITION BY dataset) AS n, try_cast(regexp_replace(site_name, '\D', '', 'g') AS bigint) AS digits FROM (
    SELECT DISTINCT dataset, site, CASE WHEN dataset % 4 = 3 AND site = 2 THEN 'x' WHEN dataset % 4 >= 2 THEN 'r' || (site + 20) ELSE 'r' || site END AS site_name FROM characters) x),
ky AS (
  SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY key) AS r, count(*) OVER (PARTITION BY dataset) AS n, min(key) OVER (PARTITION BY dataset) AS least
  FROM (SELECT DISTINCT dataset, key FROM pr) y),
sh AS (
  SELECT nm.dataset, CASE WHEN count(ky.key) = count(*) THEN 0 ELSE min(digits) - (SELECT min(key) FROM ky l WHERE l.dataset = nm.dataset) END AS shift
  FROM nm LEFT JOIN ky ON ky.dataset = nm.dataset AND ky.key = digits GROUP BY nm.dataset),
wt AS (
  SELECT nm.dataset, nm.site, CASE WHEN nm.n = (SELECT count(*) FROM ky m WHERE m.dataset = nm.dataset) THEN ky.key ELSE digits - shift END AS want
  FROM nm JOIN sh USING (dataset) LEFT JOIN ky ON ky.dataset = nm.dataset AND ky.r = nm.r),
fd AS (SELECT wt.dataset, wt.site, ky.key FROM wt LEFT JOIN ky ON ky.dataset = wt.dataset AND ky.key = wt.want),
sn AS (SELECT DISTINCT dataset, site, state FROM characters WHERE state > 0)
SELECT fd.dataset, site, state, round(q, 9) AS q FROM fd JOIN pr ON pr.dataset = fd.dataset AND pr.key = fd.key WHERE state <> 0
UNION ALL SELECT fd.dataset, fd.site, coalesce(state, 1), round(1e0 / count(*) OVER (PARTITION BY fd.dataset, fd.site), 9) FROM fd LEFT JOIN sn ON sn.dataset = fd.dataset AND sn.site = fd.site WHERE fd.key IS NULL""",
    "characters",
)

# -- matrices ----------------------------------------------------------------------------------------------------------


def _torn(alleles):
    """Alleles of cells that differ within a barcode, some of them missing."""
    return alleles.withColumn("r2", F.when(F.col("readCount") % 11 == 0, None).otherwise(F.col("r2")))


def _matrix_parts(alleles):
    t = stored(_torn(alleles))
    ignored = t.filter(F.col("intBC").startswith("AG")).select("intBC")
    given = t.select(F.col("r1").alias("indel"), (F.ascii(F.substring("intBC", 3, 1)) / 100.0).alias("freq")).distinct()
    return t, ignored, given


def _states(alleles):
    t, ignored, given = _matrix_parts(alleles)
    return characters.matrix_states(t, ignored, 0.8, "1I", given).withColumn("q", F.round("q", 9))


def _rows(alleles):
    t, ignored, given = _matrix_parts(alleles)
    states = characters.matrix_states(t, ignored, 0.8, "1I", given).checkpoint()
    rows = characters.matrix_rows(t, states, ignored, 0.8, "1I")
    return rows.select("cellBC", F.array_join(F.transform("row", lambda x: F.array_join(x.cast("array<string>"), "/")), ",").alias("row"))


MATRIX = """tn AS (SELECT * REPLACE (CASE WHEN readCount % 11 = 0 THEN NULL ELSE r2 END AS r2) FROM alleles),
lg AS (SELECT cellBC, intBC || unnest(['r1', 'r2', 'r3']) AS character, unnest([r1, r2, r3]) AS indel FROM tn WHERE NOT starts_with(intBC, 'AG')),
dv AS (SELECT character FROM (SELECT character, indel, count(*) AS n FROM (SELECT DISTINCT * FROM lg) x GROUP BY ALL) y GROUP BY character HAVING max(n) / sum(n) <= 0.8),
kp AS (SELECT cellBC, character, CASE WHEN indel <> '1I' THEN indel END AS indel FROM lg SEMI JOIN dv USING (character)),
co AS (SELECT character, row_number() OVER (ORDER BY character) AS col FROM (SELECT DISTINCT character FROM kp) x),
ct AS (SELECT character, indel, CAST(row_number() OVER (PARTITION BY character ORDER BY min(cellBC), indel) AS int) AS state FROM kp WHERE lower(indel) NOT LIKE '%none%' GROUP BY character, indel)"""
_query(
    "matrix_states",
    _states,
    f"""WITH {MATRIX}, pq AS (SELECT indel, avg(freq) AS q FROM (SELECT DISTINCT r1 AS indel, ascii(substr(intBC, 3, 1)) / 100e0 AS freq FROM tn) x GROUP BY indel)
SELECT co.character, col AS "column", state, indel, round(q, 9) AS q FROM co LEFT JOIN ct ON ct.character = co.character LEFT JOIN pq USING (indel)""",
    "alleles",
)
_query(
    "matrix_rows",
    _rows,
    f"""WITH {MATRIX}, st AS (SELECT DISTINCT cellBC, col, CASE WHEN kp.indel IS NULL THEN -1 WHEN lower(kp.indel) LIKE '%none%' THEN 0 ELSE state END AS state
 FROM kp JOIN co USING (character) LEFT JOIN ct ON ct.character = kp.character AND ct.indel = kp.indel),
tk AS (SELECT cellBC, col, string_agg(CAST(state AS varchar), '/' ORDER BY state) AS token FROM st GROUP BY cellBC, col)
SELECT cellBC, string_agg(coalesce(token, '-1'), ',' ORDER BY col) AS row FROM (SELECT cellBC, col, token FROM (SELECT DISTINCT cellBC FROM tk) c CROSS JOIN co LEFT JOIN tk USING (cellBC, col)) x GROUP BY cellBC""",
    "alleles",
)


def _present(c):
    """The priors of matrices that have no state at one site of every data set."""
    holes = c.withColumn("state", F.when(F.col("dataset") % 7 + 1 != F.col("site"), F.col("state")))
    given = c.filter("state > 0").select("dataset", "site", "state", (F.col("state") / 15.0).alias("q")).distinct()
    cells, kept = characters.present_sites(holes, given, ("dataset",))
    n = cells.groupBy("dataset", "site").agg(F.count(F.lit(1)).alias("n_cells"))
    return kept.join(n, ["dataset", "site"]).withColumn("q", F.round("q", 9))


_query(
    "present_site_priors",
    _present,
    """WITH hl AS (SELECT dataset, site, count(*) AS n_cells FROM characters GROUP BY ALL HAVING count(CASE WHEN dataset % 7 + 1 <> site THEN state END) > 0)
SELECT DISTINCT dataset, site, state, round(state / 15e0, 9) AS q, n_cells FROM characters JOIN hl USING (dataset, site) WHERE state > 0""",
    "characters",
)
_query(
    "normalised_priors",
    lambda c: characters.normalised_priors(c.filter("state is not null").select("site", "state", (F.col("state") / 5.0).alias("q")).distinct()).withColumn("q", F.round("q", 9)),
    """WITH pr AS (SELECT DISTINCT site, state, state / 5e0 AS q FROM characters WHERE state IS NOT NULL)
SELECT site, state, round(q / sum(q) OVER (PARTITION BY site), 9) AS q FROM pr WHERE q > 0 AND q < 1""",
    "characters",
)

# -- results of runs ---------------------------------------------------------------------------------------------------

_query(
    "run_results",
    lambda t: results.compiled(results.result_fields(t)),
    """WITH fl AS (SELECT file,
  trim(substr(max_by(value, line) FILTER (starts_with(value, 'Optimal tree:')), 14)) AS tree,
  CAST(trim(substr(max_by(value, line) FILTER (starts_with(value, 'Optimal negative-llh:')), 22)) AS double) AS llh,
  CAST(trim(substr(max_by(value, line) FILTER (starts_with(value, 'Optimal dropout rate:')), 22)) AS double) AS dropout,
  CAST(trim(substr(max_by(value, line) FILTER (starts_with(value, 'Optimal silencing rate:')), 24)) AS double) AS silencing FROM logs GROUP BY file)
SELECT split_part(split_part(file, '/', 2), '_', 1) AS rep_name, replace(split_part(file, '_', 2), '.txt', '') AS flag, tree, llh, dropout, silencing FROM fl WHERE file NOT LIKE '%_other.txt'""",
    "logs",
)
_query(
    "search_statistics",
    lambda t: results.search_statistics(t).withColumns({"runtime_per_tree": F.round("runtime_per_tree", 9), "trees_per_step": F.round("trees_per_step", 9)}),
    """WITH sp AS (SELECT *, sum(CASE WHEN starts_with(value, 'NNI Iter:') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS step FROM logs),
bs AS (SELECT file, CAST(trim(split_part(max_by(value, line) FILTER (value LIKE '%Optimal score for this search:%'), ':', 2)) AS double) AS best FROM logs GROUP BY file),
st AS (SELECT file, step,
  CAST(trim(split_part(max_by(value, line) FILTER (value LIKE '%Number of trees checked:%'), ':', 2)) AS bigint) AS trees,
  max_by(value, line) FILTER (value LIKE '%Current score:%') AS score,
  CAST(trim(split_part(max_by(value, line) FILTER (value LIKE '%Runtime (s):%'), ':', 2)) AS double) AS runtime FROM sp GROUP BY file, step)
SELECT file, count(*) AS n_steps, CAST(sum(trees) AS bigint) AS n_trees, round(CASE WHEN sum(trees) > 0 THEN sum(runtime) / sum(trees) ELSE 0 END, 9) AS runtime_per_tree,
  round(avg(trees), 9) AS trees_per_step, any_value(best) AS best FROM st JOIN bs USING (file) WHERE coalesce(CAST(trees AS varchar), score, CAST(runtime AS varchar)) IS NOT NULL GROUP BY file""",
    "logs",
)
_SOLVER = results.SOLVER_LINE


def _nonzero(x: str) -> str:
    return f"CASE WHEN round(avg({x}), 9) = 0 THEN 0e0 ELSE round(avg({x}), 9) END"


_query(
    "solver_differences",
    # no difference is 0 on both sides, never -0
    lambda t: results.solver_differences(t).withColumns({c: F.when(F.round(c, 9) == 0, 0.0).otherwise(F.round(c, 9)) for c in ("llh", "phi", "nu", "first_seconds", "second_seconds")}),
    f"""WITH rk AS (
  SELECT file, solver, row_number() OVER (PARTITION BY file, solver ORDER BY line) AS k, CAST(regexp_extract(value, '{_SOLVER}', 2) AS double) AS llh, CAST(regexp_extract(value, '{_SOLVER}', 3) AS double) AS phi,
    CAST(regexp_extract(value, '{_SOLVER}', 4) AS double) AS nu, CAST(regexp_extract(value, '{_SOLVER}', 5) AS double) AS sec
  FROM (SELECT *, regexp_extract(value, '{_SOLVER}', 1) AS solver FROM logs WHERE regexp_matches(value, '{_SOLVER}')) x)
SELECT file, count(a.k + b.k) AS n_pairs, {_nonzero('a.llh - b.llh')} AS llh, {_nonzero('a.phi - b.phi')} AS phi, {_nonzero('a.nu - b.nu')} AS nu, round(avg(a.sec), 9) AS first_seconds, round(avg(b.sec), 9) AS second_seconds
FROM (SELECT * FROM rk WHERE solver = 'oldEM') a FULL JOIN (SELECT * FROM rk WHERE solver = 'fastEM') b USING (file, k) GROUP BY file""",
    "logs",
)

# -- heat maps ---------------------------------------------------------------------------------------------------------


def _grouped(alleles):
    return alleles.withColumn("lineageGrp", F.ascii(F.substring("cellBC", -1, 1)) % 5)


GROUPED = "al AS (SELECT *, ascii(substr(cellBC, length(cellBC), 1)) % 5 AS lineageGrp FROM alleles)"
_query(
    "barcode_overlap",
    lambda t: heatmaps.barcode_overlap(_grouped(t)),
    f"""WITH {GROUPED}, cl AS (SELECT lineageGrp, intBC, row_number() OVER (ORDER BY lineageGrp, intBC) AS col FROM (SELECT DISTINCT lineageGrp, intBC FROM al) x)
SELECT cellBC, intBC, cl.lineageGrp, col FROM (SELECT DISTINCT cellBC, intBC FROM al) c JOIN cl USING (intBC)""",
    "alleles",
)
_query(
    "allele_heatmap",
    lambda t: heatmaps.allele_heatmap(_grouped(t)).withColumn("code", F.round("code", 6)),
    f"""WITH {GROUPED},
rw AS (SELECT *, row_number() OVER (PARTITION BY lineageGrp ORDER BY n_umis, cellBC) AS row FROM (SELECT lineageGrp, cellBC, count(UMI) AS n_umis FROM al GROUP BY ALL) x),
cl AS (SELECT *, row_number() OVER (PARTITION BY lineageGrp ORDER BY n DESC, intBC) AS col, count(*) OVER (PARTITION BY lineageGrp) AS k FROM (SELECT lineageGrp, intBC, count(*) AS n FROM al GROUP BY ALL) x),
cd AS (SELECT lineageGrp, cellBC, intBC, unnest(['s1', 's2', 's3']) AS site, unnest([r1, r2, r3]) AS r FROM al)
SELECT lineageGrp, cellBC, row, n_umis, intBC, col, site, round(avg(CASE WHEN r = 'None' THEN 0.9e0 WHEN r LIKE '%D%' THEN 1.9e0 WHEN r LIKE '%I%' THEN 2.9e0 ELSE 0e0 END), 6) AS code
FROM cd JOIN rw USING (lineageGrp, cellBC) JOIN cl USING (lineageGrp, intBC) WHERE k >= 2 GROUP BY ALL""",
    "alleles",
)
_query(
    "distinct_alleles",
    lambda t: heatmaps.distinct_alleles(_grouped(t)),
    f"WITH {GROUPED} SELECT lineageGrp, intBC, site, count(DISTINCT r) AS n FROM (SELECT lineageGrp, intBC, unnest(['r1', 'r2', 'r3']) AS site, unnest([r1, r2, r3]) AS r FROM al) x GROUP BY ALL",
    "alleles",
)

# -- pairs and triplets ------------------------------------------------------------------------------------------------


def _weights(characters):
    """A prior of each state of each site, but none of state 5."""
    return characters.filter("state between 1 and 4").select("site", "state", (F.col("state") / 10.0).alias("q")).distinct()


_query(
    "pair_classes",
    lambda c: triplets.pair_classes(c, _weights(c), ("dataset",)).withColumn("same", F.array_join(F.transform("same", lambda q: F.round(q * 10, 0).cast("int").cast("string")), "|")),
    """SELECT x.dataset, x.cell AS a, y.cell AS b, count(*) AS n, count(*) FILTER (x.state = 0 AND y.state = 0) AS zz, count(*) FILTER (x.state > 0 AND y.state = 0) AS az,
 count(*) FILTER (x.state = 0 AND y.state > 0) AS za, count(*) FILTER (x.state > 0 AND y.state > 0 AND (x.state <> y.state OR x.state = 5)) AS ab,
 count(*) FILTER (x.state = 0 AND y.state IS NULL) AS zm, count(*) FILTER (x.state IS NULL AND y.state = 0) AS mz, count(*) FILTER (x.state > 0 AND y.state IS NULL) AS am,
 count(*) FILTER (x.state IS NULL AND y.state > 0) AS ma, coalesce(string_agg(CAST(x.state AS varchar), '|' ORDER BY x.state) FILTER (x.state = y.state AND x.state BETWEEN 1 AND 4), '') AS same
FROM characters x JOIN characters y ON x.dataset = y.dataset AND x.site = y.site AND x.cell < y.cell GROUP BY ALL""",
    "characters",
)
_query(
    "pairwise_branches",
    lambda c: triplets.cell_branches(stored(c), _weights(c), ("dataset",), 60),
    None,
    "characters",
)


def _leaf_triplets(tree):
    """Of each leaf and the two after it in its tree: which are closest by the tree's own heights."""
    along = Window.partitionBy("dataset").orderBy("node")
    triples = tree.filter("is_leaf").select(F.col("node").alias("a"), F.lead("node").over(along).alias("b"), F.lead("node", 2).over(along).alias("c")).filter("c is not null")
    heights = distances.node_depths(tree).select(F.col("node").alias("lca"), F.col("height").alias("d_r"))
    return triplets.triplet_topologies(distances.leaf_lcas(tree).join(heights, "lca").select("a", "b", "d_r"), triples)


_query(
    "leaf_triplets",
    _leaf_triplets,
    f"""WITH RECURSIVE {CLOSURE}, {DEPTHS}, lf AS (SELECT up.* FROM up JOIN tree USING (node) WHERE is_leaf),
pr AS (SELECT a.node AS a, b.node AS b, max(nd.height) AS d FROM lf a JOIN lf b ON a.ancestor = b.ancestor AND a.node < b.node JOIN nd ON nd.node = a.ancestor GROUP BY a.node, b.node),
tr AS (SELECT node AS a, lead(node) OVER w AS b, lead(node, 2) OVER w AS c FROM tree WHERE is_leaf WINDOW w AS (PARTITION BY dataset ORDER BY node))
SELECT tr.a, tr.b, tr.c, CAST(CASE WHEN bc.d >= greatest(ab.d, ac.d) THEN 1 WHEN ac.d >= ab.d THEN 2 ELSE 3 END AS int) AS topology
FROM tr JOIN pr ab ON ab.a = tr.a AND ab.b = tr.b JOIN pr ac ON ac.a = tr.a AND ac.b = tr.c JOIN pr bc ON bc.a = tr.b AND bc.b = tr.c""",
    "tree",
)
