"""Priors whose keys are not the names of the sites of a matrix, brought to its sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.operators.ordering import numbered


def prior_keys(priors: DataFrame, sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., site, site_name, key): which key of the priors each site takes, null if none.

    priors: by..., key (whole number), state, q; sites: by..., site, site_name. With as many keys as sites, they belong
    together in order. Else a site's key is the number that the digits of its name make, if all of these numbers are keys;
    if not, that number less the difference between the least number and the least key. A name without digits has no key.
    """
    by = list(by)
    one = {"__all": F.lit(0)} if not by else {}
    keys = by or ["__all"]
    known = priors.withColumns(one).filter("key is not null").select(*keys, "key").distinct()
    named = sites.withColumns(one).select(*keys, "site", "site_name", F.regexp_replace("site_name", r"\D", "").try_cast("long").alias("digits")).distinct()
    n_keys = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("least_key"))
    found = named.join(known.withColumn("hit", F.lit(1)).withColumnRenamed("key", "digits"), [*keys, "digits"], "left")
    n_sites = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"), F.count("hit").alias("n_hits"), F.min("digits").alias("least"))
    told = n_sites.join(n_keys, keys, "left")
    paired = F.col("n_sites") == F.col("n_keys")
    ordered = numbered(named, keys, ["site"], "r").join(told, keys)
    of_place = numbered(known, keys, ["key"], "r").withColumnRenamed("key", "paired_key")
    shift = F.when(F.col("n_hits") == F.col("n_sites"), F.lit(0)).otherwise(F.col("least") - F.col("least_key"))
    wanted = ordered.join(of_place, [*keys, "r"], "left").withColumn("want", F.when(paired, F.col("paired_key")).otherwise(F.col("digits") - shift))
    real = known.select(*keys, F.col("key").alias("want"), F.col("key").alias("key"))
    return wanted.join(real, [*keys, "want"], "left").select(*by, "site", "site_name", "key")


def reconciled_priors(priors: DataFrame, sites: DataFrame, characters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., site, state, q): the priors of each site by prior_keys(), uniform ones where it has no key.

    characters: by..., site, state. Uniform means over the mutated states seen at the site, or state 1 alone if none is.
    Rows of state 0 go, as nothing mutates to it. A key without rows of mutated states leaves its site without rows.
    """
    by = list(by)
    keyed = prior_keys(priors, sites, by).checkpoint()
    given = keyed.filter("key is not null").join(priors.filter("state <> 0").select(*by, "key", "state", "q"), [*by, "key"])
    bare = keyed.filter("key is null").select(*by, "site")
    seen = characters.filter("state > 0").select(*by, "site", "state").distinct()
    counts = seen.groupBy(*by, "site").agg(F.count(F.lit(1)).alias("n"))
    filled = bare.join(counts, [*by, "site"], "left").join(seen, [*by, "site"], "left")
    uniform = filled.select(*by, "site", F.coalesce("state", F.lit(1)).alias("state"), (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("q"))
    return given.select(*by, "site", "state", "q").unionByName(uniform)
