"""Domain-shaped tables derived from the supplied star-schema tables.

Each is SQL that Spark and DuckDB read alike, so that a query and its oracle start from the same rows. Keys of lineitem
repeat, so molecules are aggregated first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "events", "orders", "customer", "part", "supplier", "nation", "region", "documents")


def _dna(x: str, digits: int) -> str:
    """A number as a string over ACGT, most significant digit first."""
    return " || ".join(f"substr('ACGT', cast(floor({x} / {4**d}e0) as bigint) % 4 + 1, 1)" for d in reversed(range(digits)))


MOLECULES = f"""
SELECT cellBC, intBC, UMI, max(readCount) AS readCount, min(r1) AS r1, min(r2) AS r2, min(r3) AS r3 FROM (
  SELECT 'CELL' || cast(l_suppkey AS varchar(20)) AS cellBC, {_dna("(l_partkey % 40)", 3)} AS intBC,
    {_dna("(l_orderkey * 8 + l_linenumber)", 10)} AS UMI, cast(floor(l_quantity) AS bigint) AS readCount,
    CASE WHEN l_returnflag = 'N' THEN 'None' ELSE l_returnflag || cast(l_partkey % 3 AS varchar(5)) || 'D' END AS r1,
    CASE WHEN l_partkey % 5 = 0 THEN 'None' ELSE cast(l_partkey % 4 AS varchar(5)) || 'I' END AS r2,
    CASE WHEN l_linestatus = 'O' THEN 'None' ELSE cast(l_partkey % 2 AS varchar(5)) || 'D' END AS r3
  FROM lineitem) x GROUP BY cellBC, intBC, UMI
"""

#: Raw reads: several for each cell and UMI, with names and qualities.
READS = f"""
SELECT 'CELL' || cast(l_suppkey % 50 AS varchar(20)) AS cellBC, {_dna("(l_orderkey % 64)", 3)} AS UMI,
  cast(floor(l_quantity) AS bigint) AS readCount, {_dna("(l_partkey)", 8)} AS seq,
  'read' || cast(l_orderkey AS varchar(20)) || '_' || cast(l_linenumber AS varchar(20)) || '_' || cast(l_partkey AS varchar(20)) || '_' || cast(l_suppkey AS varchar(20)) AS readName,
  chr(cast(33 + l_partkey % 40 AS int)) || chr(cast(33 + (l_partkey * 7) % 40 AS int)) || chr(cast(33 + (l_partkey * 11) % 40 AS int)) ||
  chr(cast(33 + (l_orderkey + l_partkey) % 40 AS int)) || chr(cast(33 + (l_orderkey * 3 + l_partkey) % 40 AS int)) || chr(cast(33 + (l_orderkey * 7 + l_partkey) % 40 AS int)) ||
  chr(cast(33 + (l_suppkey + l_partkey * 3) % 40 AS int)) || chr(cast(33 + (l_linenumber * 9 + l_partkey) % 40 AS int)) AS qual
FROM lineitem
"""

#: Allele table: one row for each molecule, cut sites as columns.
ALLELES = "SELECT cellBC, intBC, r1, r2, r3, r1 || r2 || r3 AS allele, UMI, readCount FROM (" + MOLECULES + ") m"

#: Share of barcodes by cell, from events.
CELL_BARCODES = "SELECT user_id AS cell, event_type AS intBC, count(*) AS n FROM events GROUP BY user_id, event_type"

#: Many data sets of SPAN order keys each: the nodes of a tree, whose leaves are cells with 7 sites.
SPAN = 41

#: Character matrix in long form, of all cells: state null when missing; in one of eight data sets a site is unmutated.
CHARACTERS = f"""
SELECT c.o_orderkey + 1 AS cell, cast(floor(c.o_orderkey / {SPAN}e0) AS int) AS dataset, s.site,
  CASE WHEN v.state IS NULL OR v.flag = 'R' THEN NULL WHEN cast(floor(c.o_orderkey / {SPAN}e0) AS int) % 8 = s.site THEN 0 ELSE v.state END AS state
FROM (SELECT DISTINCT o_orderkey FROM orders) c
CROSS JOIN (SELECT DISTINCT cast(l_linenumber AS int) AS site FROM lineitem) s
LEFT JOIN (SELECT l_orderkey AS cell, cast(l_linenumber AS int) AS site, cast(min(l_partkey) % 6 AS int) AS state, min(l_returnflag) AS flag
           FROM lineitem GROUP BY l_orderkey, l_linenumber) v ON c.o_orderkey = v.cell AND s.site = v.site
"""

#: A tree for each data set, none with leaves of one depth: binary ones in turn with ones of three children a node.
TREE = f"""
SELECT base + i AS node, CASE WHEN i = 1 THEN NULL WHEN dataset % 2 = 0 THEN base + cast(floor(i / 2e0) AS bigint) ELSE base + cast(floor((i + 1) / 3e0) AS bigint) END AS parent,
  ((base + i) * 37 % 11 + 1) / 20e0 AS brlen, child > {SPAN} OR base + child > last AS is_leaf, dataset
FROM (SELECT *, CASE WHEN dataset % 2 = 0 THEN 2 * i ELSE 3 * i - 1 END AS child FROM (
  SELECT cast(floor(o_orderkey / {SPAN}e0) AS bigint) * {SPAN} AS base, o_orderkey % {SPAN} + 1 AS i, cast(floor(o_orderkey / {SPAN}e0) AS int) AS dataset, last
  FROM (SELECT DISTINCT o_orderkey FROM orders) o CROSS JOIN (SELECT max(o_orderkey) + 1 AS last FROM orders) m) x) y
"""

#: Alignments of reads of 60 bases or so to a reference, with one insertion and one deletion each.
ALIGNMENTS = f"""
SELECT 'read' || cast(l_orderkey AS varchar(20)) || '_' || cast(l_linenumber AS varchar(20)) || '_' || cast(l_partkey AS varchar(20)) || '_' || cast(l_suppkey AS varchar(20)) AS readName,
  cast(l_partkey % 3 AS int) AS ReferenceBegin, cast(l_suppkey % 2 AS int) AS QueryBegin, {_dna("(l_orderkey * 7 + l_partkey)", 10)} || {_dna("(l_partkey * 31)", 10)} || {_dna("(l_suppkey * 977 + l_orderkey)", 10)} || {_dna("(l_orderkey * 13)", 10)} || {_dna("(l_partkey * 7 + l_linenumber)", 10)} || {_dna("(l_orderkey * 3)", 10)} AS seq,
  cast(5 + l_partkey % 17 AS varchar(5)) || 'M' || cast(1 + l_orderkey % 6 AS varchar(5)) || 'I' || cast(3 + l_suppkey % 20 AS varchar(5)) || 'M' || cast(1 + l_partkey % 9 AS varchar(5)) || 'D' || cast(4 + l_linenumber AS varchar(5)) || 'M' AS CIGAR
FROM lineitem
"""

#: Lines of result files and logs, of one file an order: seven lines for each item of it.
LOGS = """
SELECT 'out/run' || cast(o AS varchar(20)) || '_' || CASE o % 5 WHEN 0 THEN 'nm' WHEN 1 THEN 'bm' WHEN 2 THEN 'nd' WHEN 3 THEN 'ns' ELSE 'other' END || '.txt' AS file,
  cast(0 AS bigint) AS block, cast(i * 10 + k AS bigint) AS line,
  CASE k WHEN 1 THEN CASE WHEN (o + i) % 4 = 0 THEN '' ELSE 'NNI Iter: ' || cast(i AS varchar(5)) END
    WHEN 2 THEN 'Number of trees checked: ' || cast(p % 50 AS varchar(20))
    WHEN 3 THEN '  Current score: -' || cast(s AS varchar(20)) || '.' || cast(p % 10 AS varchar(5))
    WHEN 4 THEN 'Runtime (s): ' || cast(p % 9 AS varchar(5)) || '.5'
    WHEN 5 THEN CASE (o + i) % 5 WHEN 0 THEN 'Optimal tree: (a' || cast(p AS varchar(20)) || ':1,b:2);' WHEN 1 THEN 'Optimal negative-llh: ' || cast(s AS varchar(20)) || '.25'
      WHEN 2 THEN 'Optimal dropout rate: 0.' || cast(p % 10 AS varchar(5)) WHEN 3 THEN 'Optimal silencing rate: 0.' || cast(s % 10 AS varchar(5))
      ELSE 'Optimal score for this search: -' || cast(s AS varchar(20)) || '.75' END
    WHEN 6 THEN 'Current oldEM_solver score: -' || cast(s AS varchar(20)) || '.5, 0.' || cast(p % 10 AS varchar(5)) || ', 0.' || cast(s % 10 AS varchar(5)) || ', ' || cast(i AS varchar(5)) || '.25 seconds'
    ELSE CASE WHEN (o + i) % 6 = 0 THEN 'no score' ELSE 'Current fastEM_solver score: -' || cast(s AS varchar(20)) || '.0, 0.' || cast(p % 7 AS varchar(5)) || ', 0.1, 0.' || cast(i AS varchar(5)) || ' seconds' END END AS value
FROM (SELECT l_orderkey AS o, cast(l_linenumber AS int) AS i, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber) x
CROSS JOIN (SELECT DISTINCT cast(l_linenumber AS int) AS k FROM lineitem) y
"""

ALL = {"logs": LOGS, "alignments": ALIGNMENTS, "molecules": MOLECULES, "reads": READS, "alleles": ALLELES, "cell_barcodes": CELL_BARCODES, "characters": CHARACTERS, "tree": TREE}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables; the base tables are read as views of this call only."""
    text = ALL[name]
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text}
    for t in args:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text.replace("varchar(20)", "string").replace("varchar(5)", "string"), **args)


def with_derived(sql: str) -> str:
    """An oracle's SQL with the derived tables that it names as common table expressions."""
    used = [n for n in ALL if re.search(rf"\b{n}\b", sql)]
    tables = ", ".join(f"{n} AS ({ALL[n]})" for n in used)
    head = re.match(r"\s*WITH (RECURSIVE )?", sql)
    return f"WITH {head[1] or ''}{tables}, {sql[head.end() :]}" if head else f"WITH {tables} {sql}"
