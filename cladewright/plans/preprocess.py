"""Registered queries of the preprocess stages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewright.functions import sequences
from cladewright.operators import alignment, alleles, characters, molecules, runner, stages, umis
from cladewright.operators.stored import stored
from cladewright.sources.derived import derive, with_derived

QUERIES: dict = {}
SQL: dict[str, str] = {}

REFERENCE = "ACGTTGCAACGGTTAACCGGATCGATTACGCATGCCATGGTACCTTGGAACCTTAGGCATTACGGTAC"
BARCODE, CUTSITES, WIDTH, SIZE = (8, 14), (20, 32, 40), 4, 3


def _query(name: str, f, sql: str | None, source: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(derive(spark, sf_dir, source))
    if sql is not None:
        SQL[name] = with_derived(sql)


def _piece(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) < 0 OR ({b}) <= ({a}) THEN '' ELSE substr(seq, CAST(({a}) + 1 AS int), CAST(({b}) - ({a}) AS int)) END"


def _site(site: int, name: str) -> str:
    a, b = site - WIDTH, site + WIDTH
    near = lambda x: f"({x} BETWEEN {a} AND {b})"
    found = f"(kind = 'I' AND {near('r')}) OR (kind = 'D' AND ({near('r')} OR {near('r + n')} OR (r <= {a} AND r + n >= {b})))"
    text = f"{_piece(f'q - {SIZE}', 'q')} || '[' || (r + 1) || ':' || n || kind || ']' || {_piece('q', f'q + {SIZE} + CASE WHEN kind = chr(73) THEN n ELSE 0 END')}"
    here = f"q + {site} - r"
    none = f"{_piece(f'{here} - {SIZE}', here)} || '[None]' || {_piece(here, f'{here} + {SIZE}')}"
    return f"coalesce(string_agg(CASE WHEN {found} THEN {text} END, '' ORDER BY i), arg_max(CASE WHEN kind = 'M' AND r <= {site} AND r + n >= {site} THEN {none} END, i), '') AS {name}"


# one row an operation, with running places as sums over those before
_OPS = """op AS (SELECT readName, seq, i, kind, n, ReferenceBegin + coalesce(sum(CASE WHEN kind IN ('M', 'D') THEN n ELSE 0 END) OVER w, 0) AS r, QueryBegin + coalesce(sum(CASE WHEN kind IN ('M', 'I', 'H') THEN n ELSE 0 END) OVER w, 0) AS q
 FROM (SELECT readName, seq, ReferenceBegin, QueryBegin, unnest(range(1, len(ns) + 1)) AS i, unnest(ks) AS kind, CAST(unnest(ns) AS int) AS n
  FROM (SELECT DISTINCT *, regexp_extract_all(CIGAR, '(\\d+)([A-Z])', 1) AS ns, regexp_extract_all(CIGAR, '(\\d+)([A-Z])', 2) AS ks FROM alignments) a) o
 WINDOW w AS (PARTITION BY readName, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_LOW, _HIGH = BARCODE
_PADDED = f"""pd AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'I' AND r = {_LOW} THEN n WHEN kind = 'D' AND r + n = {_LOW} THEN -n END IGNORE NULLS) OVER w, 0) AS pad FROM op
 WINDOW w AS (PARTITION BY readName, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bc AS (SELECT readName, seq, coalesce(arg_max(CASE WHEN kind <> 'M' THEN NULL WHEN r + n >= {_LOW} AND r + n <= {_HIGH} AND r < {_LOW} THEN {_piece(f"q + {_LOW} - r", f"q + {_LOW} - r + r + n - {_LOW} + 1")}
  WHEN r >= {_LOW} AND r <= {_HIGH} AND r + n > {_HIGH} THEN {_piece("q", f"q + {_HIGH} - r + 1")}
  WHEN r <= {_LOW} AND r + n >= {_HIGH} AND pad > {_LOW - _HIGH} THEN {_piece(f"q + {_LOW} - r", f"q + {_HIGH} - r + pad")} END, i), 'NC') AS intBC FROM pd GROUP BY readName, seq)"""
_query(
    "call_alleles",
    lambda t: alleles.call_alleles(t.dropDuplicates(), REFERENCE, BARCODE, CUTSITES, WIDTH, True, SIZE).select("readName", "seq", "intBC", "r1", "r2", "r3", "allele"),
    f"""WITH {_OPS}, {_PADDED}, al AS (SELECT readName, seq, {", ".join(_site(s, f"r{k}") for k, s in enumerate(CUTSITES, 1))} FROM op GROUP BY readName, seq)
SELECT readName, seq, CASE WHEN (intBC = 'NC' OR length(intBC) < {_HIGH - _LOW}) AND {_piece(str(_LOW - 11), str(_LOW))} = '{REFERENCE[_LOW - 11 : _LOW]}' THEN {_piece(str(_LOW), str(_HIGH))} ELSE intBC END AS intBC, r1, r2, r3, r1 || r2 || r3 AS allele FROM al JOIN bc USING (readName, seq)""",
    "alignments",
)


def _barcodes(reads):
    """Raw barcodes of nine bases, and as whitelist those with an even last digit of their name."""
    return reads.select("readName", F.concat("UMI", F.substring("seq", 1, 2)).alias("barcode"), F.substring("qual", 1, 5).alias("barcode_qual")).distinct()


_WHITE = "wl AS (SELECT DISTINCT barcode FROM rw WHERE ascii(substr(barcode, 5, 1)) < 70)"
_query(
    "correct_cells",
    lambda t: alleles.correct_cells(_barcodes(t), _barcodes(t).filter(F.ascii(F.substring("barcode", 5, 1)) < 70).select("barcode"), 0.6).select("readName", "barcode", "barcode_qual", "corrected"),
    f"""WITH rw AS (SELECT DISTINCT readName, UMI || substr(seq, 1, 2) AS barcode, substr(qual, 1, 5) AS barcode_qual FROM reads), {_WHITE},
pr AS (SELECT barcode AS t, count(rw.readName) + 1 AS weight FROM wl LEFT JOIN rw USING (barcode) GROUP BY barcode),
od AS (SELECT DISTINCT barcode, barcode_qual FROM rw ANTI JOIN wl USING (barcode)),
nr AS (SELECT barcode, barcode_qual, t, weight * pow(10e0, -(ascii(substr(barcode_qual, CAST(list_position(list_transform(range(1, 6), lambda i: substr(barcode, CAST(i AS int), 1) <> substr(t, CAST(i AS int), 1)), true) AS int), 1)) - 33) / 10e0) AS p FROM od JOIN pr ON hamming(barcode, t) = 1),
bs AS (SELECT barcode, barcode_qual, max(struct_pack(p := p, t := t)).t AS near FROM nr GROUP BY barcode, barcode_qual HAVING max(p) / sum(p) >= 0.6)
SELECT readName, barcode, barcode_qual, CASE WHEN wl.barcode IS NOT NULL THEN barcode ELSE near END AS corrected FROM rw LEFT JOIN wl USING (barcode) LEFT JOIN bs USING (barcode, barcode_qual)""",
    "reads",
)
_query("mode_sequences", lambda t: alleles.mode_sequences(t), "SELECT cellBC, UMI, seq, n FROM (SELECT cellBC, UMI, seq, count(*) AS n, row_number() OVER (PARTITION BY cellBC, UMI ORDER BY count(*) DESC, seq) AS rn FROM reads GROUP BY cellBC, UMI, seq) x WHERE rn = 1", "reads")
_query(
    "consensus_letters", lambda t: alleles.consensus_letters(t).select("cellBC", "UMI", "pos", "base", "n"),
    "SELECT cellBC, UMI, pos, base, n FROM (SELECT cellBC, UMI, pos, base, count(*) AS n, row_number() OVER (PARTITION BY cellBC, UMI, pos ORDER BY count(*) DESC, base) AS rn FROM (SELECT cellBC, UMI, CAST(unnest(range(0, 8)) AS int) AS pos, unnest(string_split(seq, '')) AS base FROM reads) p GROUP BY cellBC, UMI, pos, base) x WHERE rn = 1",
    "reads",
)
_VOTES = """ps AS (SELECT cellBC, UMI, i AS pos, substr(seq, i, 1) AS base, ascii(substr(qual, i, 1)) - 33 AS q FROM reads, (SELECT unnest(range(1, 9))::int AS i)),
vt AS (SELECT cellBC, UMI, pos, base, count(*) AS c, count(*) FILTER (q >= 30) AS good, sum(q) AS s FROM ps GROUP BY ALL),
rk AS (SELECT *, row_number() OVER w AS rn, lead((good, c, s)) OVER w = (good, c, s) AS tied, sum(c) OVER (PARTITION BY cellBC, UMI, pos) AS n FROM vt WINDOW w AS (PARTITION BY cellBC, UMI, pos ORDER BY good DESC, c DESC, s DESC, base)),
cs AS (SELECT cellBC, UMI, string_agg(CASE WHEN tied THEN 'N' ELSE base END, '' ORDER BY pos) AS seq, string_agg(CASE WHEN tied THEN '#' WHEN c > 0.5e0 * n AND good > 0 THEN '@' ELSE '+' END, '' ORDER BY pos) AS qual, CAST(max(n) AS bigint) AS n FROM rk WHERE rn = 1 GROUP BY cellBC, UMI)"""
_query("consensus_sequences", molecules.call_consensus, f"WITH {_VOTES} SELECT * FROM cs", "reads")
_query(
    "umi_seeds",
    lambda t: umis.propose_seeds(umis.prepared(t)),
    f"""WITH {_VOTES}, md AS (SELECT cellBC, UMI, arg_min(seq, (-n, seq)) AS seq, max(n) AS most, CAST(sum(n) AS bigint) AS total FROM (SELECT cellBC, UMI, seq, count(*) AS n FROM reads GROUP BY ALL) x GROUP BY cellBC, UMI)
SELECT cellBC, UMI, CASE WHEN most > 1 THEN md.seq ELSE cs.seq END AS seed, total FROM md JOIN cs USING (cellBC, UMI)""",
    "reads",
)
_query(
    "seed_mismatches",
    lambda t: umis.mismatches_from_seed(t.join(umis.propose_seeds(umis.prepared(t)), ["cellBC", "UMI"])).select("readName", "cellBC", "UMI", "seq", "seed", "mismatches"),
    f"""WITH {_VOTES}, md AS (SELECT cellBC, UMI, arg_min(seq, (-n, seq)) AS seq, max(n) AS most FROM (SELECT cellBC, UMI, seq, count(*) AS n FROM reads GROUP BY ALL) x GROUP BY cellBC, UMI),
sd AS (SELECT cellBC, UMI, CASE WHEN most > 1 THEN md.seq ELSE cs.seq END AS seed FROM md JOIN cs USING (cellBC, UMI))
SELECT readName, cellBC, UMI, seq, seed, CAST(len(list_filter(range(1, 9), lambda i: substr(seq, i, 1) <> substr(seed, i, 1) AND ascii(substr(qual, i, 1)) >= 53)) AS int) AS mismatches FROM reads JOIN sd USING (cellBC, UMI)""",
    "reads",
)
_query("collapse_umis", lambda t: umis.collapse_umis(t, 1, 1), None, "reads")
_query("collapse_umis_likelihood", lambda t: umis.collapse_umis(t, method="likelihood"), None, "reads")
# reads of eight bases: a gap costs more than the four bases on its far side bring, so the best stretch has none
_query(
    "joined_alignments",
    lambda t: alignment.align_reads(t.select("readName", "seq"), REFERENCE),
    f"""WITH sq AS (SELECT DISTINCT seq FROM reads),
stretch AS (SELECT seq, i, j, n, 5 * n - 9 * hamming(substr(seq, i, n), substr('{REFERENCE}', j, n)) AS score
  FROM sq, (SELECT unnest(range(1, 9))::int AS i), (SELECT unnest(range(1, {len(REFERENCE) + 1}))::int AS j), (SELECT unnest(range(1, 9))::int AS n) WHERE i + n <= 9 AND j + n <= {len(REFERENCE) + 1}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, i + n, j + n, n) AS rn FROM stretch) x WHERE rn = 1)
SELECT readName, seq, n || 'M' AS CIGAR, CAST(i - 1 AS int) AS QueryBegin, CAST(j - 1 AS int) AS ReferenceBegin, CAST(score AS double) AS AlignmentScore FROM reads JOIN best USING (seq)""",
    "reads",
)


def _called(t):
    """Reads of a target like the reference, with its own barcode and a cut, from the sequences of the alignments table."""
    a, b = F.substring("seq", 1, 6), F.substring("seq", 7, 3)
    cut = F.ascii(F.substring("seq", 10, 1)) % 7
    read = F.concat(F.lit(REFERENCE[:8]), a, F.lit(REFERENCE[14:30]), F.when(cut > 3, b).otherwise(""), F.substring(F.lit(REFERENCE), (31 + cut).cast("int"), F.lit(len(REFERENCE))))
    reads = t.select("readName", read.alias("seq")).dropDuplicates()
    return alleles.call_alleles(alignment.align_reads(reads, REFERENCE), REFERENCE, BARCODE, CUTSITES, WIDTH, True, SIZE)


_query("aligned_alleles", lambda t: _called(t).select("readName", "CIGAR", "AlignmentScore", "intBC", "r1", "r2", "r3", "allele"), None, "alignments")
_query(
    "cutsite_codes", lambda t: alleles.cutsite_codes(t).select("cellBC", "intBC", "UMI", "s1", "s2", "s3"),
    "SELECT cellBC, intBC, UMI, " + ", ".join(f"CASE WHEN r{i} = 'None' THEN 0.9e0 WHEN contains(r{i}, 'D') THEN 1.9e0 WHEN contains(r{i}, 'I') THEN 2.9e0 ELSE 0e0 END AS s{i}" for i in (1, 2, 3)) + " FROM alleles", "alleles",
)
_LONG = "lg AS (SELECT DISTINCT cellBC, intBC || '_' || site AS character, indel FROM (SELECT cellBC, intBC, unnest(['r1', 'r2', 'r3']) AS site, unnest([r1, r2, r3]) AS indel FROM alleles) x)"
_query(
    "profile_characters",
    lambda t: alleles.profile_characters(characters.lineage_profile(t), characters.indel_priors(t), "1I").withColumn("q", F.round("q", 9)),
    f"""WITH {_LONG}, ev AS (SELECT cellBC, character, indel FROM (SELECT DISTINCT cellBC FROM lg) c CROSS JOIN (SELECT DISTINCT character FROM lg) k LEFT JOIN lg USING (cellBC, character)),
cd AS (SELECT character, indel, row_number() OVER (PARTITION BY character ORDER BY min(cellBC), indel) AS code FROM lg WHERE NOT contains(lower(indel), 'none') AND indel NOT IN ('NC', 'Missing', '1I') GROUP BY character, indel),
pr AS (SELECT indel, count(*) / (SELECT count(DISTINCT intBC) FROM alleles) AS q FROM (SELECT DISTINCT intBC, unnest([r1, r2, r3]) AS indel FROM alleles) x GROUP BY indel)
SELECT cellBC, character, indel, CAST(CASE WHEN indel IS NULL OR indel IN ('NC', 'Missing', '1I') THEN -1 WHEN contains(lower(indel), 'none') THEN 0 ELSE code END AS int) AS state, round(CASE WHEN code > 0 THEN q END, 9) AS q FROM ev LEFT JOIN cd USING (character, indel) LEFT JOIN pr USING (indel)""",
    "alleles",
)
_query(
    "without_ignored", lambda t: alleles.without_ignored(t, t.groupBy("intBC").count().filter("count % 2 = 0")).select("cellBC", "intBC", "UMI"),
    "SELECT cellBC, intBC, UMI FROM molecules WHERE intBC NOT IN (SELECT intBC FROM molecules GROUP BY intBC HAVING count(*) % 2 = 0)", "molecules",
)
_query(
    "stage_statistics", alleles.stage_statistics,
    """SELECT 'reads_per_umi' AS kind, readCount AS value, count(*) AS n FROM molecules GROUP BY readCount UNION ALL SELECT 'umis_per_cell', v, count(*) FROM (SELECT count(*) AS v FROM molecules GROUP BY cellBC) a GROUP BY v
UNION ALL SELECT 'umis_per_barcode', v, count(*) FROM (SELECT count(*) AS v FROM molecules GROUP BY cellBC, intBC) b GROUP BY v""", "molecules",
)
_pairs = lambda t: t.select("cellBC", "UMI", "readName", "seq", "qual").join(alleles.mode_sequences(t).select("cellBC", "UMI", F.col("seq").alias("mode")), ["cellBC", "UMI"])
_query(
    "quality_mismatches", lambda t: _pairs(t).select("readName", "seq", "UMI", sequences.quality_hamming(F.col("seq"), F.col("mode"), F.col("qual"), F.lit("I" * 8), 20).alias("mismatches")),
    "WITH md AS (SELECT cellBC, UMI, seq AS mode FROM (SELECT cellBC, UMI, seq, row_number() OVER (PARTITION BY cellBC, UMI ORDER BY count(*) DESC, seq) AS rn FROM reads GROUP BY cellBC, UMI, seq) x WHERE rn = 1) SELECT readName, seq, UMI, CAST("
    + " + ".join(f"CASE WHEN substr(seq, {i}, 1) <> substr(mode, {i}, 1) AND ascii(substr(qual, {i}, 1)) - 33 >= 20 THEN 1 ELSE 0 END" for i in range(1, 9)) + " AS int) AS mismatches FROM reads JOIN md USING (cellBC, UMI)", "reads",
)
_query("filter_molecule_table", lambda t: stages.filter_molecule_table(t, 10, 2.0, doublets=0.8), None, "alleles")
_query("call_lineage_groups", lambda t: stages.call_lineage_groups(t), None, "alleles")


def _small_cells(alleles):
    """Cells cut up by the order of their molecules, with few barcodes each; barcodes that begin with AC are not callable."""
    cell = F.concat("cellBC", F.lit("-"), F.substring("UMI", 2, 3))
    return alleles.withColumns({"cellBC": cell, "intBC": F.when(F.col("intBC").startswith("AC"), "NC").otherwise(F.col("intBC"))})


def _refined(t):
    t = stored(_small_cells(t))
    groups = t.select(F.col("cellBC").alias("cell"), (F.ascii(F.substring("cellBC", -1, 1)) % 5).alias("lineageGrp")).distinct().filter("lineageGrp > 0")
    return stages.refine_lineage_groups(t, groups, 3, 20.0, 0.3, 0.2)


_query(
    "refine_lineage_groups",
    _refined,
    """WITH al AS (SELECT * REPLACE (cellBC || '-' || substr(UMI, 2, 3) AS cellBC, CASE WHEN starts_with(intBC, 'AC') THEN 'NC' ELSE intBC END AS intBC) FROM alleles),
bc AS (SELECT cellBC AS cell, intBC, count(UMI) AS n FROM al GROUP BY ALL),
gr AS (SELECT DISTINCT cell, ascii(substr(cell, length(cell), 1)) % 5 AS lg FROM bc WHERE ascii(substr(cell, length(cell), 1)) % 5 > 0),
first_sets AS (SELECT lg, intBC FROM (SELECT lg, intBC, count(*) AS k, max(count(*)) OVER (PARTITION BY lg) AS mx FROM bc JOIN gr USING (cell) GROUP BY lg, intBC) x WHERE k / mx >= 0.3),
sh AS (SELECT cell, intBC, n / sum(n) OVER (PARTITION BY cell) AS share FROM bc JOIN gr USING (cell)),
kin AS (SELECT cell, s.lg, sum(share) AS kin FROM sh JOIN first_sets s USING (intBC) GROUP BY cell, s.lg),
best AS (SELECT cell, lg FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(kin, 9) DESC, lg) AS rn FROM kin) x WHERE rn = 1),
scored AS (SELECT cell, coalesce(best.lg, 1) AS lg FROM gr LEFT JOIN best USING (cell)),
renamed AS (SELECT lg, row_number() OVER (ORDER BY count(*) DESC, lg DESC) AS new FROM scored GROUP BY lg),
named AS (SELECT c.cell, coalesce(new, 0) AS lg FROM (SELECT DISTINCT cell FROM bc) c LEFT JOIN scored USING (cell) LEFT JOIN renamed USING (lg)),
size AS (SELECT lg, count(*) AS cells FROM named GROUP BY lg),
presence AS (SELECT lg, intBC, count(*) / any_value(cells) AS p FROM bc JOIN named USING (cell) JOIN size USING (lg) GROUP BY lg, intBC),
raw AS (SELECT cell, p.lg, sum(p) / any_value(total) AS m FROM bc JOIN presence p USING (intBC) JOIN (SELECT lg, sum(p) AS total FROM presence GROUP BY lg) t ON t.lg = p.lg GROUP BY cell, p.lg),
member AS (SELECT cell, lg, m / sum(m) OVER (PARTITION BY cell) AS m FROM raw),
single AS (SELECT cell, lg FROM member JOIN named USING (cell, lg) WHERE m >= 0.2),
held AS (SELECT lg, intBC FROM (SELECT lg, intBC, count(*) AS k FROM bc JOIN single USING (cell) GROUP BY lg, intBC) x JOIN (SELECT lg, count(*) AS cells FROM single GROUP BY lg) s USING (lg) WHERE k / cells > 0.3 AND intBC <> 'NC'),
final AS (SELECT cellBC, intBC, allele, r1, r2, r3, CAST(lg AS int) AS lineageGrp, count(UMI) AS UMI, CAST(sum(readCount) AS bigint) AS readCount
 FROM al JOIN single ON cell = cellBC SEMI JOIN held USING (lg, intBC) GROUP BY ALL)
SELECT * FROM final WHERE cellBC IN (SELECT cellBC FROM final GROUP BY cellBC HAVING sum(UMI) >= 3 AND sum(readCount) / sum(UMI) >= 20)""",
    "alleles",
)
_SETTINGS = "[general]\nname = x\n[filter_molecules]\nmin_umis = 10\ndoublets = 0.8\n[call_lineages]\nkinship = 0.2\ninter = 0.05\n"
_query("run_stages", lambda t: stages.run_stages(t, _SETTINGS), None, "alleles")


_CONFIGURATION = f"""[general]
name = 'chain'
output_directory = ''
reference_filepath = ''
input_files = []
[align]
ref = '{REFERENCE}'
[call_alleles]
ref = '{REFERENCE}'
barcode_interval = {BARCODE}
cutsite_locations = {list(CUTSITES)}
cutsite_width = {WIDTH}
context_size = {SIZE}
[filter_molecule_table]
min_umi_per_cell = 2
doublet_threshold = 0.9
[call_lineages]
min_umi_per_cell = 2
min_cluster_prop = 0.1
inter_doublet_threshold = 0.05
"""


def _chain(t):
    """From sequences of molecules to lineage groups: five stages."""
    name = F.split("readName", "_")
    near = F.concat(F.lit(REFERENCE[:8]), F.lit("CA"), F.substring("seq", 19, 2), F.substring("seq", 19, 2), F.lit(REFERENCE[14:30]), F.substring(F.lit(REFERENCE), (31 + F.ascii(F.substring("seq", 25, 1)) % 7).cast("int"), F.lit(len(REFERENCE))))
    reads = t.select(F.concat(F.lit("CELL"), name[3]).alias("cellBC"), F.substring("seq", 1, 10).alias("UMI"), near.alias("seq"), (F.ascii(F.substring("seq", 30, 1)) % 5 + 2).cast("long").alias("readCount"))
    reads = reads.groupBy("cellBC", "UMI").agg(F.min("seq").alias("seq"), F.sum("readCount").alias("readCount"))
    reads = reads.withColumn("readName", F.concat_ws("_", "cellBC", "UMI", "readCount"))
    settings = runner.parse_settings(_CONFIGURATION)
    return runner.apply_stages(reads, settings, runner.chosen_stages(settings, "align"))


_query("preprocess_chain", _chain, None, "alignments")
