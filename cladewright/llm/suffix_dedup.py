"""Exact-substring deduplication with longest-previous-factor arrays over bucketed suffixes.

A string of LENGTH bytes that occurs twice is to be found, wherever its copies lie. Suffixes cannot all be sorted in one
place, so they are first dealt into buckets that are whole with regard to such strings:

1. Anchors. Each string of LENGTH bytes picks its GRAM-byte gram of least hash (the leftmost, if several). Equal strings
   pick equal grams at the same place in them. One vectorised pass finds the anchors of a document and the range of
   string starts that each anchor owns, about 1.2 anchors for 100 bytes. Suffixes whose strings own the same gram are a bucket.
2. Buckets met once are left aside; they cannot hold a repeat. In a bucket, anchors whose owned stretch of text is equal
   are copies, counted rather than listed. A bucket with a single such stretch is settled by its count.
3. The other buckets are gathered with one stretch of text for each distinct one. A task builds the suffix array of the
   stretches (prefix doubling, to LENGTH bytes), the array of longest common prefixes, and from the previous and next
   smaller positions in suffix order the longest previous factor (LPF) of each suffix; the mirrored array gives the
   longest next factor (LNF). LPF >= LENGTH marks later copies; LPF or LNF >= LENGTH marks every copy.
4. Marked starts return to the documents as byte ranges, which are merged and cut out of the text.

Counting and joining by gram or stretch use partial aggregation and a join that AQE can split, so that a gram that a
third of all texts share does not fill a task: its copies are counted where they are read.

Defined cases: null texts are empty; texts under LENGTH bytes have no repeats; cuts can fall inside a character, so kept
bytes are hashed as bytes and decoded with replacement marks when text is asked for; null and repeated doc_ids are fine,
as rows are told apart by the text as well; rows equal in both are copies of each other, but where first copies stay they
stay together; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PrefixHash, mix, saved, table, text_steps

LENGTH = 200
GRAM = 32


# -- kernels -------------------------------------------------------------------------------------------------------


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least key in each window: block-wise running minima from both sides (van Herk)."""
    n = len(keys)
    place_bits = np.uint64(24)
    assert n < 1 << 24
    tagged = (keys >> place_bits << place_bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~np.uint64(0), np.uint64)
    padded[:n] = tagged
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """For all texts of a step: (text, first owned start, last owned start, gram hash, stretch hash) of each anchor."""
    texts, lows, highs, gram_hash, stretch_hash = [], [], [], [], []
    prefix = PrefixHash(data)
    width = length - gram + 1
    # keys of all grams at once; grams across two texts are skipped below as each text takes its own part
    if len(data) < length:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    at = np.arange(len(data) - gram + 1)
    keys = prefix.of(at, at + gram)
    for i in np.flatnonzero(np.diff(offsets) >= length):
        a, b = int(offsets[i]), int(offsets[i + 1])
        chosen = _argmin_in_parts(keys[a : b - gram + 1], width)
        change = np.flatnonzero(np.diff(chosen)) + 1
        low = np.concatenate(([0], change))
        high = np.concatenate((change - 1, [len(chosen) - 1]))
        place = chosen[low]
        texts.append(np.full(len(low), i))
        lows.append(low)
        highs.append(high)
        gram_hash.append(keys[a + place])
        # the place of the anchor within the stretch is part of what must agree
        stretch_hash.append(mix(prefix.of(a + low, a + high + length) + (place - low).astype(np.uint64)))
    if not texts:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return [np.concatenate(x) for x in (texts, lows, highs, gram_hash, stretch_hash)]


def _argmin_in_parts(keys: np.ndarray, width: int, part: int = 1 << 22) -> np.ndarray:
    out = []
    n = len(keys) - width + 1
    for a in range(0, n, part):
        out.append(a + sliding_argmin(keys[a : min(a + part + width - 1, len(keys))], width))
    return np.concatenate(out)


def suffix_array(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int):
    """Suffix array of the suffixes at starts, compared to depth bytes, and the LCP of each with the one before.

    ends: for each byte the end of its stretch, which no comparison passes. Prefix doubling: ranks by 8 bytes, then by
    two ranks at once; depth is met by a last step with overlapping halves.
    """
    n = len(data)
    room = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)))
    at = np.arange(n)
    code = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes at nine bits each, so that an end sorts before every byte
        code = (code << np.uint64(9)) | np.where(at + k < ends, room[at + k], np.uint64(0))
    levels, size = [], 7
    rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
    levels.append((size, rank))
    while size < depth:
        step = min(size, depth - size)
        ahead = at + step
        second = np.where(ahead < ends, rank[np.minimum(ahead, n - 1)] + 1, 0)
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64)
        size += step
        levels.append((size, rank))
    order = starts[np.lexsort((starts, rank[starts]))]
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for width, ranks in reversed(levels):
        # overlapping steps make widths irregular, so each level is tried until it no longer moves on
        for _ in range(2):
            inside = (a < ends[order[:-1]]) & (b < ends[order[1:]]) & (common + width <= depth)
            equal = inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
            equal &= (a + width <= ends[order[:-1]]) & (b + width <= ends[order[1:]])
            move = np.where(equal, width, 0)
            a, b, common = a + move, b + move, common + move
    for _ in range(8):  # the last few bytes
        inside = (a < ends[order[:-1]]) & (b < ends[order[1:]]) & (common < depth)
        equal = inside & (data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)])
        a, b, common = a + equal, b + equal, common + equal
    lcp[1:] = common
    return order, lcp


def longest_previous_factor(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """LPF of each suffix in suffix order: its longest common prefix with any suffix of smaller position.

    position: text position of each suffix, in suffix order; lcp: with the suffix before. The best partner is the
    previous or the next smaller position in suffix order. Only values of at least least are followed: a lower LCP ends
    a run, and no partner is sought beyond it. The neighbours are found by pointer jumping over whole arrays.
    """
    n = len(position)
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        partner = np.arange(n) + step
        height = np.zeros(n, np.int64)
        ok = (partner >= 0) & (partner < n)
        height[ok] = lcp[np.maximum(np.arange(n), partner)[ok]]
        alive = ok & (height >= least)
        while True:
            todo = np.flatnonzero(alive & (position[np.clip(partner, 0, n - 1)] >= position))
            if not len(todo):
                break
            p = partner[todo]
            # the partner's own partner bounds everything between: smaller positions can only lie beyond it
            height[todo] = np.minimum(height[todo], height[p])
            partner[todo] = partner[p]
            alive[todo] = alive[p] & (height[todo] >= least)
        best = np.maximum(best, np.where(alive, height, 0))
    return best


# -- tasks ---------------------------------------------------------------------------------------------------------

ANCHOR = "doc_id long, text_key long, low int, high int, gram long, stretch long"


def _anchor_task(length: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for row, data, offsets in text_steps(batch.column("text")):
                text, low, high, g, s = anchors(data, offsets, length, gram)
                at = pa.array(text + row)
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(g.view(np.int64)), pa.array(s.view(np.int64))], ["doc_id", "text_key", "low", "high", "gram", "stretch"])

    return run


def _stretch_task(length: int):
    """Texts with the stretches wanted of them -> the bytes of each stretch."""

    def run(batches):
        import pyarrow as pa

        names = ["gram", "stretch", "doc_id", "text_key", "low", "body"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for doc, key, text, wanted in zip(*(batch.column(c) for c in ("doc_id", "text_key", "text", "wanted")), strict=True):
                raw, doc, key = (text.as_py() or "").encode(), doc.as_py(), key.as_py()
                rows += [(w["gram"], w["stretch"], doc, key, w["low"], raw[w["low"] : w["high"] + length]) for w in wanted.as_py()]
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 20_000], strict=True), types, strict=True)], names)

    return run


def _mark_task(length: int, keep_first: bool, most: int = 1 << 20):
    """Stretches sorted by gram -> marked starts of each stretch, as runs relative to its first byte.

    Buckets are worked on together until their stretches fill most bytes; a single bucket stays whole.
    """

    def settle(body):
        sizes = np.array([len(b) for b in body])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(body), np.uint8)
        ends = np.repeat(offsets[1:], sizes)
        of = np.repeat(np.arange(len(body)), sizes)
        starts = np.flatnonzero(np.arange(len(data)) + length <= ends)
        order, lcp = suffix_array(data, ends, starts, length)
        # strings of different buckets differ, as equal strings pick equal grams; within a bucket rows are in text order
        position = order
        later = longest_previous_factor(position, lcp, length) >= length
        if keep_first:
            marked = later
        else:
            marked = later | (longest_previous_factor(-position, lcp, length) >= length)
        hit = np.zeros(len(data) + 1, bool)
        hit[order[marked]] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit))))
        run_start, run_end = edge[::2], edge[1::2]  # starts of one stretch never touch those of the next
        runs = [[] for _ in body]
        for a, b in zip(run_start.tolist(), run_end.tolist(), strict=True):
            k = int(of[a])
            runs[k].append({"low": a - int(offsets[k]), "high": b - 1 - int(offsets[k])})
        return runs

    def run(batches):
        import pandas as pd

        held, size = [], 0

        def flush(frames):
            f = pd.concat(frames).drop_duplicates(["gram", "stretch"])  # a text of repeated rows comes once for each
            return pd.DataFrame({"gram": f["gram"], "stretch": f["stretch"], "runs": settle(f["body"].tolist())})

        for frame in batches:
            if not len(frame):
                continue
            held.append(frame)
            size += int(frame["body"].map(len).sum())
            while size >= most:
                f = pd.concat(held)
                total = f["body"].map(len).cumsum().to_numpy()
                cut = int(np.searchsorted(total, most))
                same = f["gram"].to_numpy() == f["gram"].iloc[min(cut, len(f) - 1)]
                begin = int(np.argmax(same))
                if begin == 0:  # the bucket fills the step: take all of it that is here, if it has ended
                    begin = int(same.sum())
                    if begin == len(f):
                        break
                yield flush([f.iloc[:begin]])
                held = [f.iloc[begin:]]
                size = int(held[0]["body"].map(len).sum())
        if held:
            yield flush(held)

    return run


def _cut_task(length: int, with_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n_bytes, removed, spans, digest, texts = [], [], [], [], []
            for text, lows, highs in zip(batch.column("text"), batch.column("lows"), batch.column("highs"), strict=True):
                raw = (text.as_py() or "").encode()
                kept, end, n = [], 0, 0
                if lows.is_valid:
                    low, high = lows.values.to_numpy(), highs.values.to_numpy() + length
                    order = np.argsort(low, kind="stable")
                    low, reach = low[order], np.maximum.accumulate(high[order])
                    first = np.concatenate(([True], low[1:] > reach[:-1]))
                    for a, b in zip(low[first].tolist(), reach[np.concatenate((first[1:], [True]))].tolist(), strict=True):
                        kept.append(raw[end:a])
                        end, n = b, n + 1
                kept.append(raw[end:])
                rest = b"".join(kept)
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(n)
                digest.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest.decode("utf-8", "replace") if with_text else None)
            cols = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


# -- the operator --------------------------------------------------------------------------------------------------


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """(doc_id, text_key, low, high): starts low..high of strings of length bytes that are later copies, or any copies."""
    source = _keyed(docs)
    found = saved(source.mapInArrow(_anchor_task(length, gram), ANCHOR), "anchors")
    counted = [F.count(F.lit(1)).alias("bucket"), F.min("stretch").alias("least"), F.max("stretch").alias("most")]
    place = F.struct("doc_id", "text_key", "low")
    buckets = saved(found.groupBy("gram").agg(*counted, *[F.min(place).alias("at")] * keep_first).filter("bucket > 1"), "buckets")
    # a bucket with one stretch only is settled; of the others one copy of each stretch is fetched from its text
    met = saved(found.join(buckets, "gram").withColumn("single", F.col("least") == F.col("most")).drop("bucket", "least", "most"), "met")
    mixed = met.filter("not single")
    stretches = saved(mixed.groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "low", "high")).alias("first")), "stretches")
    wanted = stretches.groupBy(F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("t")).agg(F.collect_list(F.struct("gram", "stretch", "first.low", "first.high")).alias("wanted"))
    bodies = source.join(wanted, source["doc_id"].eqNullSafe(F.col("d")) & (source["text_key"] == F.col("t"))).select("doc_id", "text_key", "text", "wanted")
    bodies = bodies.mapInArrow(_stretch_task(length), "gram long, stretch long, doc_id long, text_key long, low int, body binary")
    order = [F.col("doc_id").isNotNull(), "doc_id", "text_key", "low"]
    bodies = bodies.repartition("gram").sortWithinPartitions("gram", *order, "stretch")
    marked = saved(bodies.mapInPandas(_mark_task(length, keep_first), "gram long, stretch long, runs array<struct<low:int,high:int>>"), "marked")
    marked = stretches.join(marked, ["gram", "stretch"]).select(F.col("gram").alias("g"), F.col("stretch").alias("s"), "copies", F.struct("first.doc_id", "first.text_key", "first.low").alias("at"), "runs")

    everything = F.array(F.struct(F.lit(0).alias("low"), (F.col("high") - F.col("low")).alias("high")))
    settled = met.filter("single")
    theirs = mixed.drop("at").join(marked, (F.col("gram") == F.col("g")) & (F.col("stretch") == F.col("s")))
    if keep_first:
        settled = settled.filter(~place.eqNullSafe(F.col("at")))
        runs = F.when(~place.eqNullSafe(F.col("at")), everything).otherwise(F.col("runs"))
    else:
        runs = F.when(F.col("copies") > 1, everything).otherwise(F.col("runs"))
    both = [x.select("doc_id", "text_key", "low", F.explode(r).alias("r")) for x, r in ((settled, everything), (theirs, runs))]
    return both[0].unionByName(both[1]).select("doc_id", "text_key", (F.col("low") + F.col("r.low")).alias("low"), (F.col("low") + F.col("r.high")).alias("high"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text for each document."""
    ranges = repeated_ranges(docs, length, gram, keep_first)
    per_text = ranges.groupBy("doc_id", "text_key").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")).withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    source = _keyed(docs)
    joined = source.join(per_text, source["doc_id"].eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left").select("doc_id", "text", "lows", "highs")
    return joined.mapInArrow(_cut_task(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_first=False, with_text=False).drop("kept_text")
