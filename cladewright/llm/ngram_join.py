"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Documents are sets of hashed shingles of WIDTH words (a shorter text, if not wordless, is one shingle). Equal sets are
one member of the join, with a count. Each member has a signature of TREES x DEPTH minima, one row of DEPTH for each
tree; a tree is the prefix trie of its rows, kept as rows sorted by prefix. Matched prefixes are shortened from DEPTH
until a pair at the threshold shares one in some tree with probability TARGET, and members under a common prefix of
that length are candidates.

Candidates are met in blocks, not as rows of pairs: a prefix with many members is dealt into chunks, and every two
chunks are one block, so that no task holds more than two chunks. A first round compares signatures and keeps members
with a likely partner, each pair in the first tree that joins it only. A second round has the kept members' shingles and
counts exactly. It returns a number of links for each member and the links that connect the block's groups.

Defined cases: null and wordless texts have no shingles, link to nothing and are classes of their own; rows that repeat
a doc_id are told apart by their text; equal rows are one member counted twice; a null doc_id comes first in the order
in which a class picks its id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, mix, saved, shingle_hashes, table, text_steps, word_bytes
from .components import components

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET = 16, 6, 0.999
CHUNK = 256
#: Standard deviations of the estimate by signatures below the threshold at which a pair is still verified.
SLACK = 4.5


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """Prefixes shortened from depth until a pair at the threshold meets in some tree with probability target."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < target:
        k -= 1
    return k


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in ascending order, number for each text)."""
    hashes, n = shingle_hashes(*hashed_words(data, offsets, word_bytes()), width)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(n))


@functools.cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 1 << 32, (2, n), dtype=np.uint32) | np.array([[1], [0]], np.uint32)


def signatures(sets: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Minima of n hash functions for each non-empty set."""
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1][counts > 0]
    out = np.empty((len(starts), n), np.uint32)
    a, b = _multipliers(n)
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    for j in range(n):
        out[:, j] = np.minimum.reduceat((high ^ b[j]) * a[j] + low, starts) if len(starts) else 0
    return out


def _signature_task(width: int, trees: int, depth: int, prefix: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row, data, offsets in text_steps(batch.column("text")):
                sets, counts = shingle_sets(data, offsets, width)
                some = counts > 0
                starts = np.concatenate(([0], np.cumsum(counts)))[:-1][some]
                found = signatures(sets, counts, trees * depth)
                key = mix(np.add.reduceat(mix(sets), starts) + counts[some].astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
                bands = np.zeros((len(starts), trees), np.uint64)
                for k in range(prefix):
                    bands = mix(bands * np.uint64(0x9FB21C651E98DF25) + found.reshape(len(starts), trees, depth)[:, :, k].astype(np.uint64) + np.uint64(k + 1))
                at = pa.array(np.flatnonzero(some) + row)
                estimate = (found & np.uint32(255)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * trees, pa.int32()), pa.array(bands.view(np.int64).ravel()))
                cols = [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(key.view(np.int64)), pa.array(counts[some], pa.int32()), lists, pa.array([r.tobytes() for r in estimate], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "member", "n_shingles", "bands", "signature"])

    return run


@functools.lru_cache(1024)
def _pairs(n: int):
    return np.triu_indices(n, 1)


def blocks_of(frames):
    """Regroups pandas frames sorted by block so that each has whole blocks only."""
    import pandas as pd

    held = []
    for f in frames:
        if not len(f):
            continue
        last = f["block"].iloc[-1]
        if f["block"].iloc[0] == last:
            held.append(f)
            continue
        cut = len(f) - int((f["block"].to_numpy()[::-1] != last).argmax())
        yield pd.concat([*held, f.iloc[:cut]], ignore_index=True)
        held = [f.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def pair_steps(block: np.ndarray, side: np.ndarray, most: int = 200_000):
    """Yields (a, b) row pairs of the same block, about most at a time.

    A block of two chunks (sides 0 and 1) has pairs across them only; its rows are sorted by side.
    """
    edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
    left, right, size = [], [], 0
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        first = hi - lo if side[lo] == 2 else int((side[lo:hi] == 0).sum())
        step = max(1, most // (hi - lo))
        for row in range(0, first, step):
            if side[lo] == 2 and first <= step:
                a, b = _pairs(hi - lo)
            else:
                a, b = np.indices((min(step, first - row), hi - lo - (row if side[lo] == 2 else first))).reshape(2, -1)
                a, b = a + row, b + (row if side[lo] == 2 else first)
                if side[lo] == 2:
                    a, b = a[b > a], b[b > a]
            left.append(a + lo)
            right.append(b + lo)
            size += len(a)
            if size >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _matrix(column, dtype, width) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), width)


def _likely_task(threshold: float, trees: int, n: int):
    floor = threshold - SLACK * (threshold * (1 - threshold) / n) ** 0.5

    def run(frames):
        for f in blocks_of(frames):
            keep = np.zeros(len(f), bool)
            signature = _matrix(f["signature"], np.uint8, n)
            bands = np.stack(f["bands"].to_numpy())
            size, tree = f["n_shingles"].to_numpy(), f["tree"].to_numpy()
            for a, b in pair_steps(f["block"].to_numpy(), f["side"].to_numpy()):
                fits = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
                a, b = a[fits], b[fits]
                likely = (signature[a] == signature[b]).mean(1) >= floor
                a, b = a[likely], b[likely]
                earlier = (bands[a] == bands[b]) & (np.arange(trees) < tree[a][:, None])
                first = ~earlier.any(1)
                keep[a[first]] = True
                keep[b[first]] = True
            yield f.loc[keep, ["block", "side", "tree", "member"]]

    return run


def _shingle_task(width: int):
    """Texts with the blocks that want them -> a row with the text's shingles for each block."""

    def run(batches):
        import pyarrow as pa

        names = ["block", "side", "tree", "member", "copies", "bands", "shingles"]
        for batch in batches:
            wanted = batch.column("wanted")
            for row, data, offsets in text_steps(batch.column("text")):
                sets, counts = shingle_sets(data, offsets, width)
                edges = np.concatenate(([0], np.cumsum(counts)))
                cols = {k: [] for k in names}
                for i in range(len(counts)):
                    raw, bands = sets[edges[i] : edges[i + 1]].tobytes(), batch.column("bands")[row + i].as_py()
                    for w in wanted[row + i].as_py():
                        for k, v in (("block", w["block"]), ("side", w["side"]), ("tree", w["tree"]), ("member", batch.column("member")[row + i].as_py()), ("copies", batch.column("copies")[row + i].as_py()), ("bands", bands), ("shingles", raw)):
                            cols[k].append(v)
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in zip(names, types, strict=True)], names)

    return run


def jaccard_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """For each pair of indices into sets: whether the Jaccard similarity reaches the threshold; exact."""
    size = np.array([len(s) for s in sets])
    edges = np.concatenate(([0], np.cumsum(size)))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    mark = np.zeros(len(codes) + 1, bool)
    out = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(a[order])) + 1, [len(a)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if lo == hi:
            continue
        i, partners = int(a[order[lo]]), b[order[lo:hi]]
        own = codes[edges[i] : edges[i + 1]]
        mark[own] = True
        n = size[partners]
        at = np.repeat(edges[partners] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        common = np.add.reduceat(mark[codes[at]].astype(np.int64), np.concatenate(([0], np.cumsum(n)))[:-1])
        out[order[lo:hi]] = common >= threshold * (size[i] + n - common) - 1e-9
        mark[own] = False
    return out


def _verify_task(threshold: float, trees: int):
    """Whole blocks -> for each member with links: copies linked to, and the least member of its group in the block."""

    def run(frames):
        import pandas as pd

        for f in blocks_of(frames):
            f = f.drop_duplicates(["block", "side", "member"], ignore_index=True)
            bands = np.stack(f["bands"].to_numpy())
            member, copies, tree = f["member"].to_numpy(), f["copies"].to_numpy(), f["tree"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in f["shingles"]]
            size = np.array([len(s) for s in sets])
            links, root = np.zeros(len(f), np.int64), np.arange(len(f))
            for a, b in pair_steps(f["block"].to_numpy(), f["side"].to_numpy(), 50_000):
                fits = (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])) & ~((bands[a] == bands[b]) & (np.arange(trees) < tree[a][:, None])).any(1)
                a, b = a[fits], b[fits]
                if not len(a):
                    continue
                lo, hi = int(a.min()), int(b.max()) + 1  # pairs of a step lie in consecutive blocks
                ok = jaccard_links(sets[lo:hi], a - lo, b - lo, threshold)
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                while True:  # least row of each group, by repeated minima along the links
                    least = np.minimum(root[a], root[b])
                    if (root[a] == least).all() and (root[b] == least).all():
                        break
                    np.minimum.at(root, a, least)
                    np.minimum.at(root, b, least)
            on = links > 0
            yield pd.DataFrame({"member": member[on], "links": links[on], "root": member[root[on]]})

    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, class_key, n_copies, n_links, n_shingles.

    n_copies counts the documents with the same shingles, n_links the other documents at the threshold or above,
    copies included. class_id and class_key name the first document of the connected class.
    """
    n, prefix = trees * depth, prefix_length(threshold, trees, depth, target)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id long, text_key long, member long, n_shingles int, bands array<long>, signature binary"
    found = saved(source.mapInArrow(_signature_task(width, trees, depth, prefix), schema), "signatures")
    members = found.groupBy("member").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("first"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "signature")])
    members = saved(members, "members")

    under = members.select("member", F.posexplode("bands").alias("tree", "prefix"))
    met = under.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    under = under.join(met, ["tree", "prefix"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    under = under.withColumn("chunk", F.pmod(F.xxhash64("member", "tree"), F.col("chunks")).cast("int"))
    under = under.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = F.xxhash64("tree", "prefix", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block")
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side")
    placed = under.select(block, side, "tree", "member")
    likely = placed.join(members.select("member", "n_shingles", "bands", "signature"), "member").repartition("block").sortWithinPartitions("block", "side", "member")
    likely = saved(likely.mapInPandas(_likely_task(threshold, trees, n), "block long, side int, tree int, member long"), "likely")

    wanted = likely.groupBy("member").agg(F.collect_list(F.struct("block", "side", "tree")).alias("wanted"))
    wanted = wanted.join(members.select("member", "copies", "bands", "first"), "member").select("member", "copies", "bands", "wanted", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("t"))
    texts = source.join(wanted, source["doc_id"].eqNullSafe(F.col("d")) & (source["text_key"] == F.col("t"))).select("member", "copies", "bands", "wanted", "text")
    shingled = texts.mapInArrow(_shingle_task(width), "block long, side int, tree int, member long, copies long, bands array<long>, shingles binary")
    linked = shingled.repartition("block").sortWithinPartitions("block", "side", "member").mapInPandas(_verify_task(threshold, trees), "member long, links long, root long")
    linked = saved(linked, "links")

    roots = components(linked.select(F.col("member").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member")
    links = linked.groupBy("member").agg(F.sum("links").alias("links"))
    named = members.select("member", "copies", "first").join(roots, "member", "left").join(links, "member", "left").withColumn("root", F.coalesce("root", "member"))
    classes = named.groupBy("root").agg(F.min("first").alias("class"))
    named = saved(named.join(classes, "root").select("member", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("class.doc_id").alias("class_id"), F.col("class.text_key").alias("class_key")), "classes")
    some = found.select("doc_id", "text_key", "member", "n_shingles").join(named, "member")
    some = some.select("doc_id", "text_key", "class_id", "class_key", F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("n_shingles").cast("long").alias("n_shingles"))
    none = source.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_key"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_shingles"))
    return some.unionByName(none)


def first_of_each_class(docs: DataFrame) -> DataFrame:
    """The first document of each class and all documents without words, with all their columns.

    Of rows equal in doc_id and text one stays.
    """
    classes = jaccard_classes(docs).filter("n_links > 0")
    later = classes.filter(~F.col("doc_id").eqNullSafe(F.col("class_id")) | (F.col("text_key") != F.col("class_key"))).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    key = lambda d: docs["doc_id"].cast("long").eqNullSafe(d["__d"]) & (F.xxhash64(docs["text"]) == d["__t"])
    kept = docs.join(later, key(later), "left_anti")
    twice = saved(classes.groupBy(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).count().filter("count > 1").drop("count"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept["doc_id"].cast("long").eqNullSafe(twice["__d"]) & (F.xxhash64(kept["text"]) == twice["__t"]), "left_anti")
    many = kept.join(twice, kept["doc_id"].cast("long").eqNullSafe(twice["__d"]) & (F.xxhash64(kept["text"]) == twice["__t"])).select(kept["*"], "__d", "__t")
    return once.unionByName(many.groupBy("__d", "__t").agg(*[F.first(F.struct(*[many[c] for c in docs.columns])).alias("row")]).select("row.*"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key", "class_key")
