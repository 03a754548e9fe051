"""Simulators: trees and character matrices; every draw is a hash of its place, so partitions do not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *place: str) -> Column:
    """A number in [0, 1) from the seed and the named columns."""
    return F.xxhash64(F.lit(seed), *place).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def balanced_tree(spark: SparkSession, height: int, length: float) -> DataFrame:
    """(node, parent, brlen, is_leaf) of 2^height leaves, heap-numbered from 1; the root has an edge of its own."""
    return spark.range(1, 1 << (height + 1)).select(F.col("id").cast("int").alias("node"), F.floor(F.col("id") / 2).cast("int").alias("parent"), F.lit(float(length)).alias("brlen"), (F.col("id") >= 1 << height).alias("is_leaf"))


def simulate(tree: DataFrame, priors: DataFrame, depth: int, nu: float, phi: float, seed: int = 0) -> DataFrame:
    """(node, site, state, is_leaf): states down a balanced tree; -1 silenced, null dropped out at a leaf.

    One join a level. priors: site, state, q.
    """
    from pyspark.sql import Window

    upto = F.sum("q").over(Window.partitionBy("site").orderBy("state"))
    cuts = priors.select("site", "state", upto.alias("upto")).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("upto", "state"))).alias("cuts"))
    sites = priors.select("site").distinct()
    level, out = sites.select(F.lit(0).alias("node"), "site", F.lit(0).alias("state")), None
    for _ in range(depth + 1):
        edge = level.withColumnRenamed("node", "parent").join(tree, "parent").join(cuts, "site")
        d = F.col("brlen")
        silenced = uniform(seed, "node", "site") < 1 - F.exp(-d * nu)
        mutated = uniform(seed + 1, "node", "site") < 1 - F.exp(-d)
        draw = uniform(seed + 2, "node", "site")
        pick = F.coalesce(F.get(F.filter("cuts", lambda c: draw < c["upto"]), F.lit(0))["state"], F.element_at("cuts", -1)["state"])
        state = F.when((F.col("state") == -1) | silenced, -1).when((F.col("state") == 0) & mutated, pick).otherwise(F.col("state"))
        level = edge.select("node", "site", state.alias("state"), "is_leaf")
        out = level if out is None else out.unionByName(level)
        level = level.select("node", "site", "state")
    dropped = F.col("is_leaf") & (F.col("state") != -1) & (uniform(seed + 3, "node", "site") < phi)
    return out.withColumn("state", F.when(~dropped, F.col("state")))


def extra_dropout(characters: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """States of (cell, site) made missing with this chance each, the same on every run; what is missing stays so."""
    return characters.withColumn("state", F.when(uniform(seed, "cell", "site") >= rate, F.col("state")))


def uniform_priors(spark: SparkSession, sites: int, states: int) -> DataFrame:
    rows = spark.range(sites).select(F.col("id").cast("int").alias("site"), F.explode(F.sequence(F.lit(1), F.lit(states))).alias("state"))
    return rows.withColumn("q", F.lit(1.0 / states))
