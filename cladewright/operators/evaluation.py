"""Reconstructed states scored against the truth, and written as annotations of nodes."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewright.operators import bundles, likelihood

#: States of a simulated truth that stand for a dropout and for silencing, and the state of a silenced site.
DROPPED, SILENCED, SILENT = "d", "s", "-1"


def hardened(probs: Column) -> Column:
    """A map of states to probabilities with the likeliest state alone, at 1; of equal ones the first of the map."""
    entries = F.map_entries(probs)
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.when(probs.isNotNull(), F.create_map(F.get(F.filter(entries, lambda e: e["value"] == best), F.lit(0))["key"], F.lit(1.0)))


def score_sequences(truth: DataFrame, estimates: DataFrame, soft: bool = True) -> DataFrame:
    """(label, score, n_sites): the average probability that estimates give to what is true, over the sites they tell of.

    truth: label, site, state (text); estimates: label, site, probs (a map, null where nothing is told). A dropped-out
    site scores what is not given to silencing; a silenced one is the state -1. soft=False takes the likeliest state at 1.
    A label of which no site is told has a null score.
    """
    told = truth.select("label", "site", "state").join(estimates.select("label", "site", "probs"), ["label", "site"])
    probs = F.col("probs") if soft else hardened(F.col("probs"))
    of = lambda state: F.coalesce(F.try_element_at(probs, state), F.lit(0.0))
    wanted = F.when(F.col("state") == SILENCED, F.lit(SILENT)).otherwise(F.col("state"))
    one = F.when(F.col("state") == DROPPED, 1 - of(F.lit(SILENT))).otherwise(of(wanted))
    one = F.when(F.col("probs").isNotNull(), one)
    return told.groupBy("label").agg(F.avg(one).alias("score"), F.count(one).alias("n_sites"))


def format_states(p_zero: Column, p_silent: Column, p_mutated: Column, states: Column) -> Column:
    """'state' where one rounds to 1, else 'state:p/state:p': 0 and -1 to two places, the states of p_mutated to three.

    Probabilities that round to 0 are left out; halves go to the even digit.
    """
    parts = F.concat(
        F.array(F.struct(F.lit("0").alias("state"), F.bround(p_zero, 2).alias("p")), F.struct(F.lit(SILENT).alias("state"), F.bround(p_silent, 2).alias("p"))),
        F.zip_with(states, p_mutated, lambda s, p: F.struct(s.cast("string").alias("state"), F.bround(p, 3).alias("p"))),
    )
    shown = F.filter(parts, lambda x: x["p"] > 0)
    sure = F.filter(shown, lambda x: x["p"] == 1)
    return F.when(F.size(sure) > 0, F.get(sure, F.lit(0))["state"]).otherwise(F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["state"], x["p"].cast("string"))), "/"))


def annotation_lines(posteriors: DataFrame, priors: DataFrame) -> DataFrame:
    """(root, node, line): a node and its states at all sites, from likelihood.outside_pass(), as read_annotation() reads it."""
    alphabet = priors.groupBy("site").agg(F.sort_array(F.collect_list("state")).alias("states"))
    token = format_states(F.col("p_zero"), F.col("p_silent"), F.col("p_mutated"), F.col("states")).alias("token")
    sites = posteriors.join(alphabet, "site").select("root", "node", "site", token)
    rows = sites.groupBy("root", "node").agg(F.sort_array(F.collect_list(F.struct("site", "token"))).alias("s"))
    return rows.select("root", "node", F.concat_ws(",", F.col("node").cast("string"), F.array_join("s.token", ",")).alias("line"))


def _places(p: np.ndarray, places: int) -> np.ndarray:
    """p in units of its last place, halves to the even digit of p as it is written; 0 where unknown."""
    units = np.nan_to_num(p) * 10**places
    out = np.rint(units).astype(np.int64)
    near = np.flatnonzero(np.abs(np.abs(units - out) - 0.5) < 1e-6)
    out[near] = [int(Decimal(repr(x)).scaleb(places).to_integral_value(ROUND_HALF_EVEN)) for x in p[near].tolist()]
    return out


def _tokens(told: likelihood.Outside, states: np.ndarray, at: np.ndarray) -> pa.Array:
    """format_states() of some cells; states are those of their sites' alphabets."""
    given = told.given[at]
    sides = [(np.zeros(len(at), np.int64), told.p_zero[at], 2), (np.full(len(at), int(SILENT)), told.p_silent[at], 2)]
    sides += [(np.where(given[:, k], states[:, k], 0), np.where(given[:, k], told.p_mutated[at, k], 0.0), 3) for k in range(given.shape[1])]
    parts, sure = [], pa.nulls(len(at), pa.string())
    for state, p, places in sides:
        units, name = _places(p, places), pa.array(state).cast(pa.string())
        texts = pa.array([repr(k / 10**places) for k in range(int(units.max(initial=0)) + 1)])
        parts.append(pc.if_else(pa.array(units > 0), pc.binary_join_element_wise(name, texts.take(pa.array(np.maximum(units, 0))), ":"), None))
        sure = pc.coalesce(sure, pc.if_else(pa.array(units == 10**places), name, None))
    return pc.coalesce(sure, pc.binary_join_element_wise(*parts, "/", null_handling="skip"))


def tree_annotations(tree: DataFrame, leaves: DataFrame, priors: DataFrame, nu: float, phi: float, by: tuple[str, ...] = ()) -> DataFrame:
    """annotation_lines() of likelihood.outside_pass(), written where they are made."""

    def kernel(trees, shared):
        told = likelihood.Outside(trees, shared, nu, phi)
        at = np.flatnonzero(told.present)
        tokens = _tokens(told, told.states[trees.cell_site[at]], at)
        n = np.bincount(trees.cell_node[at], minlength=len(trees.node))
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[some])).astype(np.int32)), tokens)
        node = pa.array(trees.node[some])
        yield [pa.array(trees.node[trees.root[some]]), node, pc.binary_join_element_wise(node.cast(pa.string()), pc.binary_join(lists, ","), ",")]

    joined = lambda t, v: annotation_lines(likelihood.outside_joined(t, v, priors, nu, phi), priors)
    return likelihood.on_bundles(tree, leaves, priors, by, kernel, "root long, node long, line string", joined)
