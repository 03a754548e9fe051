"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source should be taken target / source_size times, which is rarely whole. The fractional parts are
rounded in pairs: words move from one document's expected share to the other's, up or down at random so that both
expectations hold, until one of the two is whole. Each pair keeps the source's total of words, so the total is off by
less than one document in the end. Pairs are met inside blocks of about BLOCK documents; what one block leaves over
meets the leftovers of other blocks one level up, until each source has a single leftover, which is drawn last.

Defined cases: a null text has size 0; null sources form one source, which comes last; null doc_ids are kept; repeated
rows are rounded one by one; documents of size 0 take 0 words; without any words all targets are 0; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

BLOCK = 64
MOST_COPIES = 3
WEIGHTS = (5, 2, 1)
_EPS = 1e-12


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copy): copy tells equal rows apart."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"))
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))


def source_targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: its size, number of documents and target.

    Targets are min(most * size, level * weight): the level is found on the sources sorted by the share at which they
    fill up, from running sums. The windows run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")).withColumn("weight", weight)
    found = found.withColumn("most", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    found = found.withColumn("level", left / open_weight)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))
    found = found.withColumn("level", F.min(fits).over(everything)["level"])  # of the first source that does not fill up
    target = F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return found.select("source", "source_size", "n_docs", target.alias("target"))


def _settle(state: Column, b: Column, level: int, seed: int) -> Column:
    """One pivotal step: state.open meets b; whoever becomes whole joins state.done."""
    a = state["open"]
    up_a, down_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
    up_b, down_b = (1 - b["p"]) * b["size"], b["p"] * b["size"]
    alpha, beta = F.least(up_a, down_b), F.least(down_a, up_b)
    draw = (F.xxhash64(F.lit(seed), F.lit(level), a["key"], b["key"]).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) * (alpha + beta) < beta
    p_a = F.when(draw, a["p"] + alpha / a["size"]).otherwise(a["p"] - beta / a["size"])
    p_b = F.when(draw, b["p"] - alpha / b["size"]).otherwise(b["p"] + beta / b["size"])

    def rounded(p: Column) -> Column:
        return F.when(p <= _EPS, F.lit(0.0)).when(p >= 1 - _EPS, F.lit(1.0)).otherwise(p)

    pair = F.array(a.withField("p", rounded(p_a)), b.withField("p", rounded(p_b)))
    whole = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)
    met = F.struct(F.get(F.filter(pair, lambda x: ~whole(x)), F.lit(0)).alias("open"), F.concat(state["done"], F.filter(pair, whole)).alias("done"))
    return F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).otherwise(met)


def _round_blocks(items: DataFrame, level: int, seed: int) -> DataFrame:
    """Rounds the items of each (source, block); columns source, open (null if none is left), done."""
    item = F.struct("size", "key", "doc_id", "base", "p")
    listed = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    kind = "struct<size:bigint,key:bigint,doc_id:bigint,base:bigint,p:double>"
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    return listed.select("source", F.aggregate("items", start, lambda s, x: _settle(s, x, level, seed)).alias("s")).select("source", "s.open", "s.done")


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 20240607) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each document."""
    rows = saved(sized(docs), "sizes")
    targets = saved(source_targets(rows, weights, most), "targets")
    t = targets.withColumnRenamed("source", "t_source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    joined = joined.withColumn("share", share).withColumn("base", F.floor("share").cast("long")).withColumn("p", F.col("share") - F.col("base"))
    joined = joined.withColumn("key", F.xxhash64("doc_id", "source", "size", "copy"))
    fractional = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS) & (F.col("size") > 0)
    settled = [joined.filter(~fractional).select("doc_id", "source", "size", (F.col("base") + F.when(F.col("p") >= 1 - _EPS, 1).otherwise(0)).alias("copies"))]

    # block counts shrink by BLOCK a level; only the largest count, one number, comes to the driver
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most_docs, 2), BLOCK)))
    blocks = lambda level: F.greatest(F.lit(1), F.ceil(F.col("n_docs") / float(BLOCK ** (level + 1))))
    block_of = lambda level: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), blocks(level))
    items = joined.filter(fractional).withColumn("block", block_of(0))
    for level in range(levels):
        last = level == levels - 1
        done = saved(_round_blocks(items, level, seed), f"level{level}")
        settled.append(done.select("source", F.explode("done").alias("x")).select("x.doc_id", "source", "x.size", (F.col("x.base") + F.col("x.p").cast("long")).alias("copies")))
        open_rows = done.filter(F.col("open").isNotNull()).select("source", "open.*")
        if last:
            draw = F.xxhash64(F.lit(seed), F.lit(-1), "key").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53) < F.col("p")
            settled.append(open_rows.select("doc_id", "source", "size", (F.col("base") + draw.cast("long")).alias("copies")))
        else:
            items = open_rows.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source").withColumn("block", block_of(level + 1))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
