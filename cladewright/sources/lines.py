"""Readers of files in which the number of a line tells what it is, whatever splits Spark reads them in.

A split's lines are counted first; the counts before it in its file number its lines. Text is read twice and not shuffled
for that: only one row a split is aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewright.functions.sequences import soft_states


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line, value): the lines of text files, numbered from 0 in each file; block is where their split starts."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    # ids grow by one within a split, as its lines are read in order by one task
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(splits, ["file", "block"]).select("file", "block", (F.col("at") + F.col("shift")).alias("line"), "value")


def counted_before(lines: DataFrame, found: Column, name: str) -> DataFrame:
    """lines with the number of lines before each in its file for which found holds; no task sees more than a split."""
    told = lines.withColumn("__found", found.cast("int"))
    totals = told.groupBy("file", "block").agg(F.sum("__found").alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier"))
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    here = told.withColumn("__here", F.coalesce(F.sum("__found").over(within), F.lit(0))).join(totals, ["file", "block"])
    return here.withColumn(name, F.col("__here") + F.col("__earlier")).drop("__found", "__here", "__earlier")


# -- reads -------------------------------------------------------------------------------------------------------------


def _records(lines: DataFrame, *keys: str) -> DataFrame:
    """Four lines a record as columns name, seq and qual, by keys and record number."""
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = lines.withColumn("record", F.floor(F.col("line") / 4)).groupBy(*keys, "record").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    name = F.regexp_extract("head", r"^@(\S*)", 1)
    return rows.filter(F.col("head").startswith("@") & F.col("qual").isNotNull()).select(*keys, "record", name.alias("name"), "seq", "qual")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(readName, seq, qual): four lines a read, told apart by their number alone, as qualities may begin with '@'.

    An unfinished last read goes.
    """
    return _records(numbered_lines(spark, path), "file").select(F.col("name").alias("readName"), "seq", "qual")


def read_fastq_pairs(spark: SparkSession, first: str, second: str, layout: dict[str, tuple]) -> DataFrame:
    """readName and the fields of a layout with their qualities, from two files whose reads of one number belong together.

    layout: field -> (1 or 2 for the file, start, end) with places from 0, end None for the rest of the read. A field f has
    its qualities in f_qual, seq in qual. Reads of one number with different names (less /1 and /2) are an error; reads
    without a mate go.
    """
    both = numbered_lines(spark, first).withColumn("mate", F.lit(1)).unionByName(numbered_lines(spark, second).withColumn("mate", F.lit(2)))
    reads = _records(both, "mate").withColumn("name", F.regexp_replace("name", "/[12]$", ""))
    side = lambda m: F.max(F.when(F.col("mate") == m, F.struct("name", "seq", "qual"))).alias(f"r{m}")
    pairs = reads.groupBy("record").agg(side(1), side(2)).filter("r1 is not null and r2 is not null")
    wrong = F.raise_error(F.concat(F.lit("reads out of step: "), F.col("r1.name"), F.lit(" and "), F.col("r2.name")))
    named = pairs.withColumn("readName", F.when(F.col("r1.name") == F.col("r2.name"), F.col("r1.name")).otherwise(wrong.cast("string")))
    columns = ["readName"]
    for field, (mate, start, end) in layout.items():
        length = F.lit((1 << 30) if end is None else end - start)
        piece = lambda c: F.substring(F.col(f"r{mate}.{c}"), F.lit(start + 1), length)  # noqa: B023, E731
        columns += [piece("seq").alias(field), piece("qual").alias("qual" if field == "seq" else f"{field}_qual")]
    return named.select(*columns)


# -- characters --------------------------------------------------------------------------------------------------------


def read_record_sets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, set, name, states): a name behind '>', on the next line its states between '|', and '_' at the end of a set.

    Sets are numbered from 0 in each file. What follows the last '_' is no set and goes. Of equal names in a set the last
    holds. Lines that are none of these, and states without a name right before them, go.
    """
    lines = counted_before(numbered_lines(spark, path), F.col("value").startswith("_"), "set")
    ends = lines.groupBy("file").agg(F.count_if(F.col("value").startswith("_")).alias("sets"))
    names = lines.filter(F.col("value").startswith(">")).select("file", "set", (F.col("line") + 1).alias("line"), F.trim(F.substring("value", 2, 1 << 30)).alias("name"))
    rows = lines.filter(F.trim("value").rlike(r"^-?\d+(\|-?\d+)*$")).select("file", "line", F.split(F.trim("value"), r"\|").cast("array<int>").alias("states"))
    found = names.join(rows, ["file", "line"]).join(ends, "file").filter("set < sets")
    return found.groupBy("file", "set", "name").agg(F.max_by("states", "line").alias("states"))


def _token_rows(lines: DataFrame) -> DataFrame:
    f = F.split("value", ",")
    rows = lines.select("file", F.trim(f[0]).alias("label"), F.posexplode(F.slice(f, F.lit(2), F.size(f))).alias("site", "token"))
    return rows.withColumn("token", F.trim("token"))


def read_annotation(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(trees: file, newick) and (rows: file, label, site, probs) of annotated trees.

    The first line is the tree, each other one a node and a state for each site: 'a', or 'a:p/b:p' with probabilities.
    probs maps states to probabilities and is null where the state is '?'.
    """
    lines = numbered_lines(spark, path)
    rows = _token_rows(lines.filter("line > 0 and trim(value) <> ''"))
    probs = F.when(F.col("token") == "?", None).when(F.col("token").contains(":"), soft_states(F.col("token"))).otherwise(F.create_map("token", F.lit(1.0)))
    return lines.filter("line = 0").select("file", F.trim("value").alias("newick")), rows.select("file", "label", "site", probs.alias("probs"))


def read_ground_truth(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(trees: file, newick) and (rows: file, label, site, state) of simulated truths.

    The first line is a header; rows of states follow until the line that begins with 'Evolve tree:', which has the tree.
    """
    mark = F.col("value").startswith("Evolve tree")
    lines = counted_before(numbered_lines(spark, path), mark, "trees")
    rows = _token_rows(lines.filter(~mark & (F.col("trees") == 0) & (F.col("line") > 0) & (F.trim("value") != "")))
    trees = lines.filter(mark & (F.col("trees") == 0)).select("file", F.trim(F.regexp_replace("value", "^Evolve tree:?", "")).alias("newick"))
    return trees, rows.withColumnRenamed("token", "state")
