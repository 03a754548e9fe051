"""Whole trees worked out in Arrow batches: nodes and leaves' states are shuffled once, and no ancestor or site of one is a row on the way.

Spark deals sets of trees to tasks and sorts them. A task takes some whole sets at a time and works out all their trees at
once in numpy, level by level. A set of more than LARGE rows is left to joins, so that no task holds it; both ways give the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cladewright.operators import ancestry

#: Rows (nodes, and states of leaves) of a set beyond which joins work it out; rows taken at once; nodes times sites worked out at once.
LARGE, STEP, CELLS = 1 << 18, 1 << 17, 1 << 17
#: Classes of sets whose rows are counted to tell whether any set may be large.
CLASSES = 1 << 16
#: Rows of priors that go to all tasks; more of them are left to joins.
MOST_PRIORS = 1 << 18


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of wanted is among keys, which rise; -1 if nowhere."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


class Trees:
    """Some trees: nodes in the order of their depths, and the sites that the leaves of each tree have.

    parent is -1 above a root. A parent that no row has is the root of what hangs from it where phantoms are asked for, and
    not real; else what hangs from it are roots. A cell is a node at a site of its tree: those of a node are in the order of
    sites and lie beside each other, and those of a level too. row_cell and state (known: not null) tell the leaves' states.
    """

    def __init__(self, nodes: dict, cells: dict, phantoms: bool):
        # nodes are numbered by set and number
        order = np.lexsort((nodes["node"], nodes["set"]))
        name, group, above, known = (nodes[c][order] for c in ("node", "set", "parent", "has_parent"))
        real = np.ones(len(name), bool)
        brlen, is_leaf = nodes["brlen"][order], nodes["is_leaf"][order]
        numbers = np.unique(np.concatenate((name, above[known], cells["node"])))
        key = lambda s, v: s.astype(np.int64) * len(numbers) + np.searchsorted(numbers, v)
        keys = key(group, name)
        parent = np.full(len(name), -1)
        parent[known] = _found(keys, key(group[known], above[known]))
        if phantoms and (known & (parent < 0)).any():
            lost = np.unique(key(group, np.where(known, above, name))[known & (parent < 0)])
            more = {"node": numbers[lost % len(numbers)], "set": lost // len(numbers)}
            name, group, real = np.append(name, more["node"]), np.append(group, more["set"]), np.append(real, np.zeros(len(lost), bool))
            brlen, is_leaf, parent = np.append(brlen, np.zeros(len(lost))), np.append(is_leaf, np.zeros(len(lost), bool)), np.append(parent, np.full(len(lost), -1))
            hung = np.flatnonzero(known & (parent[: len(known)] < 0))
            parent[hung] = len(known) + np.searchsorted(lost, key(group[hung], above[hung]))
        # depths and roots by doubling
        here = np.arange(len(name))
        up, depth = np.where(parent < 0, here, parent), (parent >= 0).astype(np.int64)
        for _ in range(64):
            if (parent[up] < 0).all():
                break
            depth, up = depth + depth[up], up[up]
        else:
            raise ValueError("a circle of nodes")
        at_node = _found(keys, key(cells["set"], cells["node"]))
        kept = at_node >= 0
        order = np.argsort(depth, kind="stable")
        new = np.empty_like(order)
        new[order] = here
        self.node, self.real, self.brlen, self.is_leaf, self.depth = name[order], real[order], brlen[order], is_leaf[order], depth[order]
        self.parent = np.where(parent[order] < 0, -1, new[parent[order]])
        self.root = new[up[order]]
        row_node = new[at_node[kept]]
        # the sites of each tree
        site = cells["site"][kept]
        self.sites = cells["sites"]
        wide = max(len(self.sites), 1)
        pair, of = np.unique(self.root[row_node] * wide + site, return_inverse=True)
        self.slot_root, self.slot_site = pair // wide, pair % wide
        width = np.bincount(self.slot_root, minlength=len(name))
        first = np.cumsum(width) - width
        self.width = width[self.root]
        self.start = np.cumsum(self.width) - self.width
        total = int(self.width.sum())
        self.cell_node = np.repeat(np.arange(len(name)), self.width)
        place = np.arange(total) - self.start[self.cell_node]
        self.cell_slot = first[self.root[self.cell_node]] + place
        self.cell_site = self.slot_site[self.cell_slot]
        above = self.parent[self.cell_node]
        self.above = np.where(above < 0, -1, self.start[above] + place)
        self.row_cell = self.start[row_node] + of - first[self.root[row_node]]
        self.state, self.known = cells["state"][kept], cells["known"][kept]
        ends = np.searchsorted(self.depth, np.arange(int(self.depth.max(initial=-1)) + 2))
        self.levels = [slice(int(a), int(b)) for a, b in zip(np.append(self.start, total)[ends[:-1]], np.append(self.start, total)[ends[1:]], strict=True)]

    def site_values(self, codes: np.ndarray) -> pa.Array:
        return self.sites.take(pa.array(codes))


def _columns(t: pa.Table) -> dict:
    return {c: t[c].chunk(0) if t[c].num_chunks == 1 else pa.concat_arrays(t[c].chunks) for c in t.column_names}


def _numbers(values: pa.Array, kind=None) -> np.ndarray:
    values = pc.fill_null(values, 0) if values.null_count else values
    out = values.to_numpy(zero_copy_only=False)
    return out if kind is None else out.astype(kind)


def _step(t: dict, group: np.ndarray, phantoms: bool) -> Iterator[Trees]:
    """The trees of whole sets, some at a time."""
    inner = t["kind"].to_numpy(zero_copy_only=False) == 0
    coded = t["site"].dictionary_encode()
    sites = coded.dictionary
    ranks = pc.sort_indices(sites).to_numpy(zero_copy_only=False)
    place = np.empty(max(len(ranks), 1), np.int64)
    place[ranks] = np.arange(len(ranks))
    site = place[_numbers(coded.indices, np.int64)]
    sites = sites.take(pa.array(ranks))
    values = {"node": _numbers(t["node"]), "parent": _numbers(t["parent"]), "state": _numbers(t["state"], np.int64)}
    has_parent, known = (t[c].is_valid().to_numpy(zero_copy_only=False) for c in ("parent", "state"))
    brlen = pc.fill_null(t["brlen"], np.nan).to_numpy(zero_copy_only=False)
    is_leaf = pc.fill_null(t["is_leaf"], False).to_numpy(zero_copy_only=False)
    # a set's cells are its nodes times the sites of its leaves, or less
    sets = int(group[-1]) + 1
    pairs = np.unique(group[~inner] * max(len(ranks), 1) + site[~inner])
    work = np.cumsum(np.bincount(group[inner], minlength=sets) * np.bincount(pairs // max(len(ranks), 1), minlength=sets))
    at = 0
    while at < sets:
        upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + CELLS, "right")))
        a, b = np.searchsorted(group, [at, upto])
        at = upto
        own, some = np.flatnonzero(inner[a:b]) + a, np.flatnonzero(~inner[a:b]) + a
        nodes = {"set": group[own] - group[a], "has_parent": has_parent[own], "brlen": brlen[own], "is_leaf": is_leaf[own]} | {c: values[c][own] for c in ("node", "parent")}
        cells = {"set": group[some] - group[a], "site": site[some], "sites": sites, "known": known[some]} | {c: values[c][some] for c in ("node", "state")}
        yield Trees(nodes, cells, phantoms)


def _task(by: tuple[str, ...], phantoms: bool, kernel: Callable, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def worked(whole: pa.Table, last: bool):
            """Batches of results, and the rows of sets that may go on."""
            t = _columns(whole)
            new = np.zeros(len(t["kind"]), bool)
            new[0] = True
            for c in by:
                new[1:] |= pc.not_equal(t[c][1:], t[c][:-1]).to_numpy(zero_copy_only=False)
            upto = len(new) if last else int(np.flatnonzero(new)[-1])
            out = []
            if upto:
                group = np.cumsum(new[:upto]) - 1
                for trees in _step({c: v[:upto] for c, v in t.items()}, group, phantoms):
                    # counts of nothing are whole numbers in numpy, whatever they count
                    out += [pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema, strict=True)], schema=schema) for cols in kernel(trees)]
            return out, whole.slice(upto)

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n >= STEP:
                out, rest = worked(pa.Table.from_batches(held).combine_chunks(), False)
                yield from out
                held, n = rest.to_batches(), 0
        if sum(map(len, held)):
            yield from worked(pa.Table.from_batches(held).combine_chunks(), True)[0]

    return run


def _large(rows: DataFrame, by: tuple[str, ...], most: int) -> DataFrame | None:
    """The sets of more than most rows, or None if there is none."""
    kind = F.pmod(F.xxhash64(*by), F.lit(CLASSES)).alias("class")
    full = [r["class"] for r in rows.groupBy(kind).count().filter(F.col("count") > most).collect()]
    if not full:
        return None
    sets = rows.filter(kind.isin(full)).groupBy(*by).count().filter(F.col("count") > most).select(*by).checkpoint()
    return None if sets.isEmpty() else sets


def in_bundles(tree: DataFrame, leaves: DataFrame, by: tuple[str, ...], kernel: Callable, schema: str, joined: Callable, phantoms: bool = True, most: int | None = None) -> DataFrame:
    """What kernel makes of all trees: lists of Arrow arrays, one for each column of schema, of some Trees at a time.

    by are columns of tree and leaves that name a set, in which a tree lies whole; without them trees are told apart by
    their roots. joined(tree, leaves) gives the same columns for sets of more than most rows (LARGE).
    """
    if not by:
        roots = ancestry.doubled(tree)[0].select("node", F.col("root").alias("__set"))
        tree, leaves, by = tree.join(roots, "node"), leaves.join(roots, "node"), ("__set",)
    none = lambda t, c: F.lit(None).cast(dict(t.dtypes)[c]).alias(c)
    own = ("parent", "brlen", "is_leaf")
    nodes = tree.select(*by, F.lit(0).alias("kind"), "node", "parent", F.col("brlen").cast("double").alias("brlen"), "is_leaf", *[none(leaves, c) for c in ("site", "state")])
    states = leaves.filter("site is not null").select(*by, F.lit(1).alias("kind"), "node", *[none(nodes, c) for c in own], "site", "state")
    rows = nodes.unionByName(states).dropna(subset=[*by, "node"])
    large = _large(rows, by, LARGE if most is None else most)
    if large is not None:
        rows = rows.join(large, list(by), "left_anti")
    # the work of a task is in numpy, out of proportion to its bytes
    width = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = to_arrow_schema(StructType.fromDDL(schema))
    out = rows.repartition(width, *by).sortWithinPartitions(*by).mapInArrow(_task(by, phantoms, kernel, told), schema)
    if large is None:
        return out
    more = joined(*[t.join(large, list(by), "left_semi").drop("__set") for t in (tree, leaves)])
    return out.unionByName(more.select(*told.names))


def shared_priors(priors: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """(sites, states, q) in the order of sites and states, or None where they are too many for all tasks."""
    got = priors.select("site", F.col("state").cast("long").alias("state"), F.col("q").cast("double").alias("q")).dropna().limit(MOST_PRIORS + 1).toArrow()
    if len(got) > MOST_PRIORS:
        return None
    got = _columns(got.sort_by([("site", "ascending"), ("state", "ascending")]).combine_chunks())
    return got["site"], _numbers(got["state"]), _numbers(got["q"])
