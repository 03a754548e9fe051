"""Pairs of cells of a data set, made in Arrow batches: bundles of cells are shuffled, and no site or pair is a row on the way.

Spark deals data sets to tasks and sorts them. A task packs whole data sets into bundles of PIECE cells; a larger one becomes
several pieces, every two of which meet by a join. The pairs of a bundle, or of two pieces, are worked out in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a bundle, rows of sites packed at once, sites of pairs worked out at once.
PIECE, STEP, SITES = 1024, 1 << 17, 1 << 20


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before in any column; none is null."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _packing(by: tuple[str, ...], values: list[str], names: list[str], piece: int):
    """Rows of sites in the order of data sets and cells -> bundles; a data set of more than piece cells is several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, keys = TaskContext.get().partitionId() << 32, 0
        long = None  # key and number of the next piece of a data set that is too large for a bundle

        def bundle(t, first, sets, c0, c1, key, no):
            rows = slice(first[c0], first[c1])
            per_cell = {"set": pa.array(sets[c0:c1].astype(np.int32)), "rows": pa.array(np.diff(first[c0 : c1 + 1]).astype(np.int32))}
            at = pa.array(first[c0:c1])
            per_cell |= {c: t[c].take(at) for c in (*by, "cell")}
            lists = per_cell | {c: t[c][rows] for c in ("site", *values)}
            cols = [pa.array([key], pa.int64()), pa.array([no], pa.int64())]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(lists[c])], pa.int32()), lists[c]) for c in names]
            return pa.RecordBatch.from_arrays(cols, ["key", "no", *names])

        def packed(t, last):
            """The bundles of t, and how many of its rows they take."""
            nonlocal keys, long
            new_set = _starts([t[c] for c in by]) if by else np.arange(len(t["cell"])) == 0
            first = np.flatnonzero(new_set | _starts([t["cell"]]))
            sets = np.cumsum(new_set[first]) - 1
            edges = np.append(np.flatnonzero(np.diff(sets, prepend=-1)), len(first)).tolist()
            first = np.append(first, len(t["cell"]))
            out, at = [], 0  # cells from at on are not yet in a bundle

            def flush(upto):
                nonlocal keys, at
                if upto > at:
                    # without data sets all bundles meet, under one key and in the order of cells
                    out.append(bundle(t, first, sets, at, upto, task + keys if by else 0, 0 if by else task + keys))
                    keys, at = keys + 1, upto

            for i, (c0, c1) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                whole = last or i < len(edges) - 2
                if not by:
                    while c1 - at > piece:
                        flush(at + piece)
                    if whole:
                        flush(c1)
                elif long or c1 - c0 > piece:
                    flush(c0)
                    key, no = long or (task + keys, 0)
                    keys += not long
                    while c1 - at > piece or whole and at < c1:
                        upto = min(at + piece, c1)
                        out.append(bundle(t, first, sets, at, upto, key, no))
                        at, no = upto, no + 1
                    long = None if whole else (key, no)
                elif not whole or c1 - at > piece:
                    flush(c0)
                if whole and i == len(edges) - 2:
                    flush(c1)
            return out, int(first[at])

        held, n = [], 0

        def table():
            whole = pa.Table.from_batches(held).combine_chunks()
            return {c: whole[c].chunk(0) if whole[c].num_chunks == 1 else pa.concat_arrays(whole[c].chunks) for c in whole.column_names}, whole

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= STEP:
                t, whole = table()
                out, taken = packed(t, False)
                yield from out
                held = whole.slice(taken).to_batches()
                n = 0
        if sum(map(len, held)):
            yield from packed(table()[0], True)[0]

    return run


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, zero where null, and where they are known."""
    known = values.is_valid().to_numpy(zero_copy_only=False)
    return (pc.fill_null(values, 0) if values.null_count else values).to_numpy(zero_copy_only=False), known


def _positions(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class _Side:
    """The cells of one bundle of a batch, their rows and coded values."""

    def __init__(self, batch: pa.RecordBatch, row: int, end: str, names: list[str], values: list[str], coded: Callable):
        lists = {c: batch.column(f"{c}_{end}")[row].values for c in names}
        self.cells, self.lists = lists["cell"], lists
        self.set, self.rows = (lists[c].to_numpy(zero_copy_only=False) for c in ("set", "rows"))
        self.site = lists["site"].to_numpy(zero_copy_only=False)
        self.codes = coded(*[_numbers(lists[v]) for v in values])
        self.first = np.cumsum(self.rows) - self.rows

    def plain(self) -> np.ndarray | None:
        """The sites that each cell has once, if they are the same ones."""
        width = int(self.rows[0])
        if not (self.rows == width).all():
            return None
        site = self.site.reshape(-1, width)
        return site[0] if (site == site[0]).all() and (site[0, 1:] != site[0, :-1]).all() else None


def _met(a: _Side, b: _Side, same: bool, most: int):
    """(i, j, x, y, start): pairs of cells by their places, the rows at their common sites, and where each pair's rows start; most rows at once."""
    n, m = len(a.rows), len(b.rows)
    if same:
        end = np.searchsorted(a.set, a.set, "right")
        later = np.arange(n) + 1
    else:
        end, later = np.full(n, m), np.zeros(n, np.int64)
    pairs = end - later
    one, two = a.plain(), b.plain()
    plain = one is not None and two is not None and len(one) == len(two) and (one == two).all()
    if plain:
        work = pairs * len(one)
    else:
        # rows meet by site and data set: those of b are put in that order, and each of a finds where they start
        _, code = np.unique(np.concatenate((a.site, b.site)), return_inverse=True)
        sites = int(code.max()) + 1
        set_a, set_b = (np.repeat(s.set if same else np.zeros(len(s.set), np.int64), s.rows).astype(np.int64) for s in (a, b))
        code_a, code_b = set_a * sites + code[: len(a.site)], set_b * sites + code[len(a.site) :]
        order = np.argsort(code_b, kind="stable")
        low, high = (np.searchsorted(code_b[order], code_a, side) for side in ("left", "right"))
        cell_b = np.repeat(np.arange(m), b.rows)
        work = np.add.reduceat(high - low, a.first)
    done = np.cumsum(work)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        if plain:
            i = np.repeat(np.arange(at, upto), pairs[at:upto])
            j = np.repeat(later[at:upto], pairs[at:upto]) + _positions(pairs[at:upto])
            steps = np.arange(len(one))
            x, y = ((s.first[k][:, None] + steps).ravel() for s, k in ((a, i), (b, j)))
            start = np.arange(len(i)) * len(one)
        else:
            rows = np.arange(a.first[at], a.first[upto - 1] + a.rows[upto - 1])
            found = (high - low)[rows]
            x, y = np.repeat(rows, found), order[np.repeat(low[rows], found) + _positions(found)]
            i, j = np.repeat(np.repeat(np.arange(at, upto), a.rows[at:upto]), found), cell_b[y]
            kept = np.flatnonzero(j > i) if same else np.arange(len(i))
            kept = kept[np.lexsort((y[kept], x[kept], j[kept], i[kept]))]
            i, j, x, y = i[kept], j[kept], x[kept], y[kept]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            start = np.flatnonzero(new)
            i, j = i[start], j[start]
        at = upto
        if len(i):
            yield i, j, x, y, start


def pair_results(characters: DataFrame, by: tuple[str, ...], values: list[str], coded: Callable, result: Callable, schema: str, told: tuple[str, ...] = (), piece: int = PIECE) -> DataFrame:
    """(told..., a, b, schema): for each pair of cells a < b of a data set with common sites what result makes of these.

    characters: by..., cell, site and values. coded gets (numbers, known) of each of values and gives arrays of a row each;
    result gets those arrays of both cells' rows at the common sites, in the order of sites, and where each pair's rows
    start, and gives an Arrow array of a value a pair for each column of schema. told are the columns of by that come back.
    """
    rows = characters.select(*by, "cell", "site", *values).dropna(subset=[*by, "cell", "site"])
    rows = rows.repartition(*by) if by else rows.repartitionByRange("cell")
    rows = rows.sortWithinPartitions(*by, "cell", "site", *values)
    kinds = dict(rows.dtypes)
    names = ["set", "rows", *by, "cell", "site", *values]
    lists = [f"`{c}` array<{kinds.get(c, 'int')}>" for c in names]
    bundles = rows.mapInArrow(_packing(by, values, names, piece), ", ".join(["key long", "no long", *lists]))
    kept = [c for c in names if c not in by or c in told]
    bundles = bundles.select("key", "no", *kept)
    if by:
        # every piece of a data set meets itself and those after it
        bundles = bundles.withColumn("pieces", F.count(F.lit(1)).over(Window.partitionBy("key")))
        one = bundles.withColumn("high", F.explode(F.sequence("no", F.col("pieces") - 1)))
        # pieces is asked for here as well, so that both sides are the same up to it and bundles are made once
        two = bundles.filter("no < pieces").withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), "no")))
    else:
        one = two = bundles
    ends = [t.select(*[F.col(c).alias(f"{c}_{end}") for c in t.columns]) for t, end in ((one, "a"), (two, "b"))]
    if by:
        met = ends[0].join(ends[1], (F.col("key_a") == F.col("key_b")) & (F.col("no_a") == F.col("low_b")) & (F.col("high_a") == F.col("no_b")))
    else:
        met = ends[0].crossJoin(ends[1]).filter("no_a <= no_b")
    met = met.select(*[f"{c}_{end}" for end in "ab" for c in ("no", *kept)])
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in told], f"a {kinds['cell']}", f"b {kinds['cell']}", schema])
    columns = [*told, "a", "b", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pc.equal(batch.column("no_a"), batch.column("no_b")).to_pylist()
            for row in range(len(batch)):
                a, b = (_Side(batch, row, end, kept, values, coded) for end in "ab")
                for i, j, x, y, start in _met(a, b, same[row], SITES):
                    got = result([c[x] for c in a.codes], [c[y] for c in b.codes], start)
                    at = pa.array(i)
                    ids = [*[a.lists[c].take(at) for c in told], a.cells.take(at), b.cells.take(pa.array(j))]
                    yield pa.RecordBatch.from_arrays([*ids, *got], columns)

    return met.mapInArrow(run, out)
