"""Licence scan: canonical digests of whole texts, joined to the digests of known licence texts.

Canonical form: A-Z in lower case; lines that state a copyright left out; equivalent spellings made one; all but words
reduced to single spaces. Two texts have one digest exactly when their canonical forms are equal. The known texts are a
parameter; their table is broadcast only while it has at most BROADCAST_TEXTS rows.

Defined cases: null texts are empty; a text without words has the digest of the empty string and no licence; if several
known texts have one canonical form, the first name by code point stands for them; rows are scanned one by one, so
repeated rows and null doc_ids stay; texts of any length are taken whole; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BREAKS, LOWER, UPPER, ascii_lower, table
from .license_texts import KNOWN

BROADCAST_TEXTS = 10_000
#: A line that states a copyright: the mark and then a year, a holder or another mark; "copyright notice" is no such line.
COPYRIGHT_LINE = r"^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9]|<|\[|by )|\(c\)[ \t]*[0-9<\[]|©|all rights reserved)"
#: Equivalent spellings of whole words, fixed values; applied in this order.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("licencee", "licensee"), ("licencees", "licensees"), ("licences", "licenses"), ("licencing", "licensing"), ("maximise", "maximize"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organisations", "organizations"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub licence", "sublicense"),
    ("sub license", "sublicense"), ("sublicence", "sublicense"), ("sublicenced", "sublicensed"), ("sublicences", "sublicenses"), ("sub licensing", "sublicensing"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
)


def spelled(words: str) -> str:
    """A word form with a space on each side of every word, so that replacing meets whole words only."""
    return " " + words.replace(" ", "  ") + " "


def canonical(text: Column | str) -> Column:
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n")
    kept = F.array_join(F.filter(lines, lambda x: ~x.rlike(COPYRIGHT_LINE)), "\n")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, BREAKS, "  ")), F.lit(" "))
    for other, one in SPELLINGS:
        words = F.replace(words, F.lit(spelled(other)), F.lit(spelled(one)))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def scan(docs: DataFrame, known: dict[str, str] = KNOWN) -> DataFrame:
    """doc_id, canonical_sha256 and license (null if unknown) for each document."""
    rows = docs.sparkSession.createDataFrame(sorted(known.items()), "license string, body string")
    digests = rows.select(F.sha2(canonical("body"), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))
    if len(known) <= BROADCAST_TEXTS:
        digests = F.broadcast(digests)
    return docs.select("doc_id", F.sha2(canonical("text"), 256).alias("canonical_sha256")).join(digests, F.col("canonical_sha256") == F.col("digest"), "left").select("doc_id", "canonical_sha256", "license")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    lines = f"string_split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), chr(10))"
    words = f"' ' || trim(regexp_replace(array_to_string(list_filter({lines}, lambda x: NOT regexp_matches(x, '{COPYRIGHT_LINE}')), chr(10)), '{BREAKS}', '  ', 'g')) || ' '"
    for other, one in SPELLINGS:
        words = f"replace({words}, '{spelled(other)}', '{spelled(one)}')"
    return f"sha256(trim(replace({words}, '  ', ' ')))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP7_SQL = f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT {_sql_canonical("body")} AS digest, license FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(KNOWN.items()))}) AS t(license, body)) GROUP BY digest)
SELECT doc_id, d.digest AS canonical_sha256, license FROM (SELECT doc_id, {_sql_canonical("text")} AS digest FROM documents) d LEFT JOIN known ON d.digest = known.digest
"""
