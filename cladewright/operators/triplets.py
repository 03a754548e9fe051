"""Three-branch estimates of pairs of cells, and which two of three cells are closest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.operators import bundles, distances, pairs

#: Counts of a pair's sites: both zero, one mutated, different mutations, and one missing beside a zero or a mutation.
COUNTS = ("zz", "az", "za", "ab", "zm", "mz", "am", "ma")


def pair_classes(characters: DataFrame, priors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., a, b, n, counts as COUNTS, same): classes of the sites of each pair of cells a < b of a data set.

    characters: by..., cell, site, state (null: missing); priors: site, state, q. n is the number of the pair's sites, same
    the priors of the mutations that both have; one without a prior counts as different mutations.
    """
    told = characters.join(priors.select("site", "state", "q"), ["site", "state"], "left").select(*by, "cell", "site", "state", "q")
    equal = lambda x, y: (x["state"] > 0) & (x["state"] == y) & x["q"].isNotNull()

    def kind(x, y):
        zero, mutated, gone = lambda c: c == 0, lambda c: c > 0, lambda c: c.isNull()
        s = x["state"]
        kinds = {
            "zz": zero(s) & zero(y), "az": mutated(s) & zero(y), "za": zero(s) & mutated(y), "ab": mutated(s) & mutated(y),
            "zm": zero(s) & gone(y), "mz": gone(s) & zero(y), "am": mutated(s) & gone(y), "ma": gone(s) & mutated(y),
        }
        out = F.when(equal(x, y), -1)
        for k, name in enumerate(COUNTS):
            out = out.when(kinds[name], k)
        return out.otherwise(-1)

    pairs = distances.cell_pairs(told, tuple(by), F.struct("state", "q"), F.col("state"))
    same = F.sort_array(F.filter(F.zip_with("x", "y", lambda x, y: F.when(equal(x, y), x["q"])), lambda q: q.isNotNull())).alias("same")
    sites = distances.kinds_of_sites(pairs, [*by, "a", "b", same], kind)
    return sites.select(*by, "a", "b", F.size("kinds").cast("long").alias("n"), *[distances.of_kind(k).alias(name) for k, name in enumerate(COUNTS)], "same")


def fitted_branches(counts: dict[str, np.ndarray], q: np.ndarray, pair: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], rounds: int):
    """(d_a, d_b, d_r, llh) of many pairs at once, by expectation and maximisation within bounds of each branch.

    q are the priors of shared mutations, pair the numbers of the pairs that they belong to. A site mutates on the way down
    at rate one; a site's mutation, if not told by its class, is shared out among the branches it may lie on.
    """
    c = {k: v.astype(float) for k, v in counts.items()}
    n = len(c["zz"])
    d = [np.clip(np.full(n, 0.3), *bounds) for _ in range(3)]

    def parts():
        stay = [np.exp(-x) for x in d]
        both = (1 - stay[2])[pair] * q
        apart = ((1 - stay[0]) * (1 - stay[1]) * stay[2])[pair] * q * q
        return stay, both, apart

    for _ in range(rounds):
        stay, both, apart = parts()
        shared = np.bincount(pair, both / (both + apart), n)
        single = np.bincount(pair, apart / (both + apart), n)
        # a mutation beside a missing state lies on the shared branch, or on the own one after that
        own_a, own_b = ((1 - stay[2]) / (1 - stay[2] * stay[i]) for i in (0, 1))
        r_mut = shared + c["am"] * own_a + c["ma"] * own_b
        r_stay = c["zz"] + c["az"] + c["za"] + c["ab"] + c["zm"] + c["mz"] + single + c["am"] * (1 - own_a) + c["ma"] * (1 - own_b)
        a_mut, b_mut = c["az"] + c["ab"] + single + c["am"] * (1 - own_a), c["za"] + c["ab"] + single + c["ma"] * (1 - own_b)
        a_stay, b_stay = c["zz"] + c["za"] + c["zm"], c["zz"] + c["az"] + c["mz"]
        new = []
        for old, mut, stays in zip(d, (a_mut, b_mut, r_mut), (a_stay, b_stay, r_stay), strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                x = -np.log(stays / (stays + mut))
            new.append(np.clip(np.where(mut + stays > 0, x, old), *bounds))
        d = new
    stay, both, apart = parts()
    lost = [np.log1p(-s) for s in stay]
    llh = -(c["zz"] + c["za"] + c["zm"]) * d[0] - (c["zz"] + c["az"] + c["mz"]) * d[1] - (c["zz"] + c["az"] + c["za"] + c["ab"] + c["zm"] + c["mz"]) * d[2]
    llh += (c["az"] + c["ab"]) * lost[0] + (c["za"] + c["ab"]) * lost[1] + np.bincount(pair, np.log(both + apart), n)
    llh += c["am"] * np.log1p(-stay[2] * stay[0]) + c["ma"] * np.log1p(-stay[2] * stay[1])
    return *d, llh


def pairwise_branches(classes: DataFrame, by: Sequence[str] = (), rounds: int = 200) -> DataFrame:
    """(by..., a, b, d_a, d_b, d_r, llh) of pair_classes(): the likeliest lengths of the two own branches and the shared one.

    Lengths lie between half of -ln(1 - 1/n) and twice -ln(1/n) for n sites; pairs of fewer than two sites have none. The
    likelihood leaves out the choice among different mutations and missing states. Pairs are fitted in Arrow batches.
    """
    names = [*by, "a", "b"]
    kinds = dict(classes.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in names] + [f"{c} double" for c in ("d_a", "d_b", "d_r", "llh")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            # pairs of equal classes have equal branches: each kind of pair is fitted once
            counts, seen = np.column_stack([f[k].to_numpy() for k in ("n", *COUNTS)]), {}
            of = np.array([seen.setdefault((c.tobytes(), x.tobytes()), len(seen)) for c, x in zip(counts, f["same"].map(lambda x: np.asarray(x, float)), strict=True)], int)
            first = np.unique(of, return_index=True)[1]
            some = f.iloc[first]
            sizes = some["same"].map(len).to_numpy() if len(some) else np.zeros(0, int)
            q = np.concatenate([np.asarray(x, float) for x in some["same"]]) if sizes.sum() else np.zeros(0)
            bounds = -np.log1p(-1 / some["n"].to_numpy(float)) / 2, 2 * np.log(some["n"].to_numpy(float))
            got = fitted_branches({k: some[k].to_numpy() for k in COUNTS}, q, np.repeat(np.arange(len(some)), sizes), bounds, rounds)
            yield f[names].assign(**{k: v[of] for k, v in zip(("d_a", "d_b", "d_r", "llh"), got, strict=True)})

    return classes.filter("n > 1").mapInPandas(run, schema)


#: Kinds of sites by the classes of both states (0 zero, 1 mutated, 2 missing); the last is a mutation that both have.
_KINDS = {(0, 0): 0, (1, 0): 1, (0, 1): 2, (1, 1): 3, (0, 2): 4, (2, 0): 5, (1, 2): 6, (2, 1): 7}
#: Distinct priors of a step up to which equal pairs are told by how often they have each.
FEW = 64


def _told_apart(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): where each distinct row of small whole numbers comes first, and which of these each row is."""
    packed = np.zeros((len(rows), -(-rows.shape[1] // 4) * 4), np.uint16)
    packed[:, : rows.shape[1]] = rows
    keys = packed.view(np.uint64)
    order = np.lexsort(keys.T)
    new = np.ones(len(rows), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def cell_branches(characters: DataFrame, priors: DataFrame, by: Sequence[str] = (), rounds: int = 200) -> DataFrame:
    """pairwise_branches() of pair_classes(), fitted where pairs meet: neither pairs nor their classes are rows on the way."""
    given = priors.select("site", "state", F.col("q").cast("double").alias("q"))
    # rows have few sites and states, so that a shuffle by these would put them into few tasks
    few = given.limit(bundles.MOST_PRIORS + 1).count() <= bundles.MOST_PRIORS
    told = characters.join(F.broadcast(given) if few else given, ["site", "state"], "left")
    table = {(u, v, same): k for (u, v), k in _KINDS.items() for same in (0, 1)}

    def coded(state, q):
        return *distances._states(state), *q

    def result(x, y, start):
        total = len(x[0])
        kinds = distances._kinds(table, x, y)
        # the prior is that of the first of the two
        at = np.flatnonzero((kinds == 3) & (x[0] == y[0]) & x[3])
        kinds[at] = -1
        size = np.diff(np.append(start, total))
        pair = np.repeat(np.arange(len(start)), size)
        counts = np.column_stack([size, *distances._counted(kinds, start, len(COUNTS))])
        order = np.lexsort((x[2][at], pair[at]))
        q, of = x[2][at][order], pair[at][order]
        first, inverse = np.arange(len(start)), np.arange(len(start))
        values, number = np.unique(q, return_inverse=True)
        if len(values) <= FEW and (not len(size) or size.max() < 1 << 16):
            # pairs of equal classes have equal branches: each kind of pair is fitted once
            each = np.bincount(of * len(values) + number, minlength=len(start) * len(values)).reshape(len(start), len(values))
            first, inverse = _told_apart(np.column_stack((counts, each)))
            q, of = np.tile(values, len(first)), np.repeat(np.arange(len(first)), len(values))
            n = each[first].ravel()
            q, of = np.repeat(q, n), np.repeat(of, n)
        some = counts[first]
        n = np.maximum(some[:, 0], 2).astype(float)
        bounds = -np.log1p(-1 / n) / 2, 2 * np.log(n)
        got = fitted_branches({k: some[:, 1 + i] for i, k in enumerate(COUNTS)}, q, of, bounds, rounds)
        return [pa.array(counts[:, 0]), *[pa.array(v[inverse]) for v in got]]

    schema = "n long, d_a double, d_b double, d_r double, llh double"
    return pairs.pair_results(told, tuple(by), ["state", "q"], coded, result, schema, told=tuple(by)).filter("n > 1").drop("n")


def triplet_topologies(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(triples..., topology): 1 where b and c are closest, 2 for a and c, 3 for a and b, by the longest shared branch.

    pairs: a, b, d_r with a < b; triples: a, b, c and further columns. Of equal ones the first in that order. Null where one
    of the three pairs is missing.
    """
    out = triples
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        d = pairs.select(F.col("a").alias("__x"), F.col("b").alias("__y"), F.col("d_r").alias(f"__{x}{y}"))
        out = out.join(d, (F.least(x, y) == F.col("__x")) & (F.greatest(x, y) == F.col("__y")), "left").drop("__x", "__y")
    most = F.greatest("__ab", "__ac", "__bc")
    known = F.col("__ab").isNotNull() & F.col("__ac").isNotNull() & F.col("__bc").isNotNull()
    told = F.when(~known, F.lit(None)).when(F.col("__bc") == most, 1).when(F.col("__ac") == most, 2).otherwise(3)
    return out.withColumn("topology", told.cast("int")).select(*triples.columns, "topology")
