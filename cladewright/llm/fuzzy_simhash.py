"""Near duplicates by SimHash, found with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of at most 22 bits. The binary Golay code of length 23 is perfect:
every word is within three bits of exactly one of its 4,096 codewords, and flipping a bit leads to one of at most five other
codewords at distance four. So two segments that differ in at most two bits share one of the (at most) six codewords within
four bits of each: the one that the word between them decodes to. Four differences leave two cases (the pigeonhole):

* One segment is equal, and another differs in at most two bits. Keys: the bits of one segment with each codeword near
  another, at most 36 of 34 bits.
* No segment is equal, so they differ in 1, 1 and at most 2 bits. A word with one bit flipped in each of two segments lies
  between. Keys: triples of codewords, of which at most two are not the nearest, at most 91 of 36 bits.

No link is lost so, and all candidates are verified by the number of differing bits.

Only distinct fingerprints meet. A key's members are compared in one block, which gives each member the least fingerprint
of its group there and no lists of pairs. Keys with more than CHUNK members are told by counts over every SAMPLE-th row and
dealt out to blocks of two chunks each; the estimate decides only where members are compared, never whether. Keys of more
than MOST members (a ball of fingerprints packed so densely that almost all are links) take another exact way whose work
grows with the members only: each is sent to all words within two bits, of which two linked ones share one.
Groups are then joined by connected components.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, spans, table, text_steps, visible_bytes
from .components import components

WIDTH, SEED, BITS = 4, 42, 64
#: Fingerprints link at this many differing bits; the cases of the segments are for four.
DISTANCE = 4
#: (lowest bit, number of bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CHUNK, MOST, SAMPLE = 2_048, 65_536, 64


# -- fingerprints --------------------------------------------------------------------------------------------------


def _step_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The fingerprint of each text of a step."""
    import xxhash

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    start, end = spans(data, offsets, visible_bytes())
    counts = np.diff(np.searchsorted(start, offsets))
    out = np.zeros(len(counts), np.uint64)
    if not len(start):
        return out
    # the words of the step, joined by single blanks: a shingle is then one slice
    length = end - start + 1
    to = np.cumsum(length) - length
    joined = np.full(int(length.sum()), 32, np.uint8)
    place = np.arange(len(joined)) - to.repeat(length)
    inside = place < (length - 1).repeat(length)
    joined[inside] = lower[data[(start.repeat(length) + place)[inside]]]
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = (np.cumsum(counts) - counts).repeat(shingles) + np.arange(shingles.sum()) - (np.cumsum(shingles) - shingles).repeat(shingles)
    last = np.minimum(first + width, np.cumsum(counts).repeat(shingles)) - 1
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], seed) for a, b in zip(to[first].tolist(), (to[last] + length[last] - 1).tolist(), strict=True)], np.uint64)
    some = np.flatnonzero(shingles)
    begins = (np.cumsum(shingles) - shingles)[some]
    for k in range(BITS):
        ones = np.add.reduceat(((hashes >> np.uint64(k)) & np.uint64(1)).astype(np.int64), begins)
        out[some] |= (2 * ones > shingles[some]).astype(np.uint64) << np.uint64(k)
    return out


def _fingerprint_task(width: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [_step_fingerprints(data, offsets, width, seed) for _, data, offsets in text_steps(batch.column("text"))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, bits (64-bit SimHash as a long). A text without words has bits 0."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long"
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_task(width, seed), schema)


# -- the Golay code ------------------------------------------------------------------------------------------------

#: Generator of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1; 12 message bits stand above 11 check bits.
GENERATOR, LENGTH, CHECKS = 0xAE3, 23, 11


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - CHECKS), 0)
    return rest


@functools.cache
def error_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the only error of at most three bits, and the five of four bits (0 where there are none)."""
    patterns = lambda n: np.array([sum(1 << b for b in c) for c in itertools.combinations(range(LENGTH), n)], np.int64)
    nearest, others = np.zeros(1 << CHECKS, np.int64), np.zeros((1 << CHECKS, 5), np.int64)
    for n in range(4):
        nearest[syndromes(patterns(n))] = patterns(n)
    four = patterns(4)
    found = syndromes(four)
    order = np.argsort(found, kind="stable")
    rank = np.arange(len(four)) - np.searchsorted(found[order], found[order], "left")
    others[found[order], rank] = four[order]
    return nearest, others


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(message of the codeword within three bits, messages of the up to five at four bits, or -1), for 23-bit words."""
    nearest, others = error_tables()
    found = syndromes(words)
    near, far = (words ^ nearest[found]) >> CHECKS, others[found]
    return near, np.where(far > 0, (words[:, None] ^ far) >> CHECKS, -1)


def segment_keys(bits: np.ndarray) -> np.ndarray:
    """Up to 127 keys of each fingerprint, -1 where there are fewer; one row for each fingerprint."""
    bits = bits.view(np.uint64)
    exact = [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    decoded = [codewords(x) for x in exact]
    near = [np.concatenate([c[:, None], others], 1) for c, others in decoded]
    out = [np.where(near[j] >= 0, (k << 40) | (exact[i][:, None] << 12) | near[j], -1) for k, (i, j) in enumerate(itertools.permutations(range(3), 2))]
    # codeword numbers (0 the nearest) of the triples: not more than two others
    picks = np.array([p for p in itertools.product(range(6), repeat=3) if min(p) == 0])
    a, b, c = (near[k][:, picks[:, k]] for k in range(3))
    out.append(np.where((a >= 0) & (b >= 0) & (c >= 0), (6 << 40) | (a << 24) | (b << 12) | c, -1))
    return np.concatenate(out, 1)


def _key_task(batches):
    for df in batches:
        bits = df["bits"].to_numpy(np.int64)
        keys = segment_keys(bits)
        on = keys >= 0
        yield pd.DataFrame({"key": keys[on], "bits": np.repeat(bits, on.sum(1))})


# -- links ---------------------------------------------------------------------------------------------------------


def _settle(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers the roots of both ends of each link to the lesser of them until all agree."""
    while len(a):
        least = np.minimum(root[a], root[b])
        open_ = (root[a] != least) | (root[b] != least)
        a, b, least = a[open_], b[open_], least[open_]
        for ends in (a, b):
            np.minimum.at(root, root[ends], least)
            np.minimum.at(root, ends, least)
        while (higher := root[root]).tobytes() != root.tobytes():
            root[:] = higher


def block_roots(block: np.ndarray, bits: np.ndarray, distance: int = DISTANCE, most_pairs: int = 1 << 20) -> np.ndarray:
    """For rows sorted by block: the row that stands for each row's group of linked rows within the block."""
    root, unsigned = np.arange(len(block)), bits.view(np.uint64)
    waiting, n = [], 0
    left = np.arange(len(block))
    for lag in range(1, len(block)):
        left = left[left < len(block) - lag]
        left = left[block[left] == block[left + lag]]  # rows whose block reaches so far
        if not len(left):
            break
        linked = left[np.bitwise_count(unsigned[left] ^ unsigned[left + lag]) <= distance]
        linked = linked[root[linked] != root[linked + lag]]
        if len(linked):
            waiting.append((linked, linked + lag))
            n += len(linked)
        if n > most_pairs or lag == 1:
            for a, b in waiting:
                _settle(root, a, b)
            waiting, n = [], 0
    for a, b in waiting:
        _settle(root, a, b)
    return root


def _block_task(distance: int):
    def run(batches):
        held = None
        for df in itertools.chain(batches, [None]):
            if df is not None:
                held = df if held is None else pd.concat([held, df], ignore_index=True)
                if not len(held):
                    continue
                # the last block may go on in the next batch
                cut = int(held["block"].searchsorted(held["block"].iloc[-1], "left"))
                ready, held = held.iloc[:cut], held.iloc[cut:]
            elif held is not None:
                ready = held
            else:
                return
            if not len(ready):
                continue
            block = ready["block"].to_numpy(np.int64)
            again = block[1:] == block[:-1]
            ready = ready[np.concatenate((again, [False])) | np.concatenate(([False], again))]  # most keys have one member
            bits = ready["bits"].to_numpy(np.int64)
            root = bits[block_roots(ready["block"].to_numpy(np.int64), bits, distance)] if len(bits) else bits
            on = root != bits
            yield pd.DataFrame({"a": bits[on], "b": root[on]}).drop_duplicates()

    return run


def near_words(bits: np.ndarray, radius: int = DISTANCE // 2) -> np.ndarray:
    """All words within radius bits of each fingerprint."""
    masks = [sum(1 << b for b in c) for n in range(radius + 1) for c in itertools.combinations(range(BITS), n)]
    return bits.view(np.uint64)[:, None] ^ np.array(masks, np.uint64)


def _near_task(batches):
    for df in batches:
        bits = df["bits"].to_numpy(np.int64)
        for k in range(0, len(bits), 256):
            words = near_words(bits[k : k + 256])
            yield pd.DataFrame({"word": words.ravel().view(np.int64), "bits": np.repeat(bits[k : k + 256], words.shape[1])})


def links(distinct: DataFrame, chunk: int = CHUNK, most: int = MOST, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column bits) that join all those within DISTANCE of each other."""
    keys = distinct.select("bits").mapInPandas(_key_task, "key long, bits long")
    some = keys.filter(F.pmod(F.xxhash64("key", "bits"), F.lit(sample)) == 0)
    large = some.groupBy("key").agg((sample * F.count(F.lit(1))).alias("n")).filter(F.col("n") > chunk)
    large = saved(large.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "large-keys")
    placed = keys.select(F.col("key").alias("block"), "bits")
    if not large.isEmpty():
        placed = keys.join(large, "key", "left_anti").select(F.col("key").alias("block"), "bits")
        met = keys.join(large, "key")
        # one block for each pair of chunks
        chunked = met.filter(F.col("n") <= most).withColumn("chunk", F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))
        chunked = chunked.withColumn("other", F.explode(others))
        block = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).bitwiseOR(F.lit(-(1 << 63)))
        placed = placed.unionByName(chunked.select(block.alias("block"), "bits"))
    placed = placed.repartition("block").sortWithinPartitions("block")
    found = placed.mapInPandas(_block_task(DISTANCE), "a long, b long")
    if not large.filter(F.col("n") > most).isEmpty():
        crowded = keys.join(large.filter(F.col("n") > most), "key").select("bits").distinct()
        words = saved(crowded.mapInPandas(_near_task, "word long, bits long"), "near-words")
        least = words.groupBy("word").agg(F.min("bits").alias("b"))
        found = found.unionByName(words.join(least, "word").filter("bits <> b").select(F.col("bits").alias("a"), "b"))
    return saved(found.distinct(), "links")


def classes(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, bits, component_id (the least doc_id of the documents reachable over links).

    Null and empty texts have the fingerprint 0 and link like others; texts of fewer words than a shingle are one shingle.
    Copies have one fingerprint and are not expanded into pairs. Rows that repeat a doc_id are documents of their own. A
    null doc_id is passed over for the least; a component of nulls only has none. Very long texts are whole steps of one
    task. Empty docs give no rows. Other columns are not read.
    """
    found = saved(fingerprints(docs, width, seed), "fingerprints")
    distinct = saved(found.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    named = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(named.join(least, "root").select("bits", "component_id"), "classes")
    return found.join(named, "bits").select("doc_id", "bits", "component_id")


def first_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the least of their class, with all their columns; doc_id must be unique and not null."""
    least = classes(docs, **options).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept"))
    return docs.join(least, docs["doc_id"] == least["__kept"], "left_semi")


def op12_fuzzy_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
