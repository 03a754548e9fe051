"""Importance resampling towards a target: hashed n-gram weights, Gumbel keys, and a distributed top-k.

Every run of one to three words is a feature; its bucket is the CRC-32 of its bytes modulo the number of buckets. The gain
of a bucket is the scaled log ratio of its share in the target to its share in the corpus, and a document's weight is the
sum over its features. Adding a Gumbel variate drawn from the document's id and taking the highest scores samples without
replacement in proportion to exp(weight).

Texts are read from the Arrow buffers: a table of byte classes marks the bytes of words, differences of the marks are the
ends of words, and the CRC registers of all words of a step advance together, one byte a turn. CRC-32 is linear, so words
are cut into pieces of at most PIECE bytes and joined again by feeding zeros (four table entries a join); a word of any
length takes at most PIECE turns, and longer runs of words are made of the registers of shorter ones.

The corpus is read twice: once for the counts of the buckets (one row a bucket and task), once for the weights. Only the
gains, one number a bucket, pass through the driver. Ranks come from one range shuffle of narrow rows, partition counts and
positions within partitions; no task holds more than one range.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, spans, table, text_steps, word_bytes

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: A draw of SHARE in 100 of the documents with at least LEAST_WORDS words.
LEAST_WORDS, SHARE = 20, 5
#: Bytes that a CRC register takes one by one.
PIECE = 64
_FULL = np.uint32(0xFFFFFFFF)


@functools.cache
def crc_table() -> np.ndarray:
    """The register after one byte, for each value of its low byte: reflected CRC-32, polynomial 0xEDB88320."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Tables of feeding the zeros of first and then those of second; tables are (4 bytes of a register, 256)."""
    r = first
    return second[0][r & 255] ^ second[1][(r >> 8) & 255] ^ second[2][(r >> 16) & 255] ^ second[3][r >> 24]


@functools.cache
def zero_tables() -> tuple[np.ndarray, np.ndarray]:
    """What 0..PIECE zero bytes, and PIECE times 1, 2, 4, ... of them, make of each byte of a register."""
    byte = np.arange(256, dtype=np.uint32)
    none = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    one = crc_table()[none & 255] ^ (none >> np.uint32(8))
    short = [none]
    for _ in range(PIECE):
        short.append(_then(short[-1], one))
    doubled = [short[-1]]
    for _ in range(40):
        doubled.append(_then(doubled[-1], doubled[-1]))
    return np.stack(short), np.stack(doubled)


def after_zeros(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n zero bytes each."""
    short, doubled = zero_tables()

    def fed(r, t):
        return t[..., 0, r & 255] ^ t[..., 1, (r >> 8) & 255] ^ t[..., 2, (r >> 16) & 255] ^ t[..., 3, r >> 24]

    rest = n % PIECE
    out = short[rest, 0, register & 255] ^ short[rest, 1, (register >> 8) & 255] ^ short[rest, 2, (register >> 16) & 255] ^ short[rest, 3, register >> 24]
    many = n // PIECE
    k = 0
    while len(on := np.flatnonzero(many >> k)):
        bit = on[(many[on] >> k) & 1 == 1]
        out[bit] = fed(out[bit], doubled[k])
        k += 1
    return out


def word_registers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The register that each range of bytes leaves of zero; all ranges advance at once."""
    length = end - start
    pieces = np.maximum(-(-length // PIECE), 1)
    first = np.cumsum(pieces) - pieces
    at = start.repeat(pieces) + PIECE * (np.arange(pieces.sum()) - first.repeat(pieces))
    size = np.minimum(end.repeat(pieces) - at, PIECE)
    order = np.argsort(-size, kind="stable")
    at, by_size = at[order], size[order]
    register, step = np.zeros(len(at), np.uint32), crc_table()
    active = np.searchsorted(-by_size, -np.arange(int(by_size[0]) if len(at) else 0), "left")
    for k, n in enumerate(active):  # the longest pieces are in front, so those still open are a prefix
        r = register[:n]
        register[:n] = step[(r ^ data[at[:n] + k]) & 255] ^ (r >> np.uint32(8))
    back = np.empty_like(register)
    back[order] = register
    if len(back) > len(start):
        many = np.flatnonzero(pieces.repeat(pieces) > 1)
        behind = end.repeat(pieces) - (start.repeat(pieces) + PIECE * (np.arange(len(back)) - first.repeat(pieces))) - size
        back[many] = after_zeros(back[many], behind[many])
    return np.bitwise_xor.reduceat(back, first) if len(start) else back


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST):
    """(bucket of the run of n words from each word, or -1 beyond its text's end; one array for each n), words of each text."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    start, end = spans(data, offsets, word_bytes())
    counts = np.diff(np.searchsorted(start, offsets))
    if not len(start):
        return [np.zeros(0, np.int64)] * longest, counts
    length, word = end - start, word_registers(lower[data], start, end)
    blank = after_zeros(np.full(len(word), crc_table()[0x20]), length) ^ word
    run, left = after_zeros(np.full(len(word), _FULL), length) ^ word, np.cumsum(counts).repeat(counts) - np.arange(len(word))
    out = []
    for n in range(1, longest + 1):
        if n > 1:  # the run from word i takes a blank and word i + n - 1
            run = run[:-1]
            run = after_zeros(run, length[n - 1 :] + 1) ^ blank[n - 1 :]
        bucket = np.full(len(word), -1, np.int64)
        bucket[: len(run)] = (run ^ _FULL) % np.uint32(buckets)
        bucket[left < n] = -1
        out.append(bucket)
    return out, counts


def _count_task(buckets: int, longest: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_steps(batch.column("text")):
                for found in feature_buckets(data, offsets, buckets, longest)[0]:
                    total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "n": total[some]})

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Features by bucket (bucket int, n long) over all rows of the column text; a null text has none."""
    found = texts.select("text").mapInArrow(_count_task(buckets, longest), "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per bucket: bucket, gain = floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))).

    s and t are the bucket's features in docs and target, S and T the totals of all buckets.
    """
    spark = docs.sparkSession
    s = bucket_counts(docs, buckets, longest).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets, longest).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    both = saved(both, "buckets")
    whole = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(whole)).select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain"))


def _weight_task(gains: np.ndarray, buckets: int, longest: int):
    padded = np.append(gains, 0)  # a bucket of -1 weighs nothing

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words, features, weight = [], [], []
            for _, data, offsets in text_steps(batch.column("text")):
                found, counts = feature_buckets(data, offsets, buckets, longest)
                gained = np.zeros(int(counts.sum()) + 1, np.int64)
                for f in found:
                    gained[1:] += padded[f]
                gained, ends = np.cumsum(gained), np.concatenate(([0], np.cumsum(counts)))
                words.append(counts)
                features.append(sum(np.maximum(counts - n, 0) for n in range(longest)))
                weight.append(gained[ends[1:]] - gained[ends[:-1]])
            if words:
                columns = [np.concatenate(x).astype(np.int64) for x in (words, features, weight)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def document_weights(docs: DataFrame, gains: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight (sum of the gains of its features, repeats counted)."""
    found = gains.toPandas()  # one number a bucket
    by_bucket = np.zeros(buckets, np.int64)
    by_bucket[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return docs.select("doc_id", "text").mapInArrow(_weight_task(by_bucket, buckets, longest), schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256("seed:doc_id"); a null id is an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, wanted: Column, order: list[Column]) -> tuple[DataFrame, int]:
    """rows with __place (1, 2, 3 ... over the wanted ones in the order given, null for others), and the number wanted.

    A range shuffle deals the rows out, each partition numbers its own, and partition counts give the offsets.
    """
    tied = rows.withColumn("__wanted", F.coalesce(wanted, F.lit(False))).withColumn("__tie", F.monotonically_increasing_id())
    by = [F.col("__wanted").desc(), *order, F.col("__tie")]
    dealt = tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = saved(dealt.drop("__tie"), "ranked")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.filter("__wanted").groupBy(part.alias("__part")).count().orderBy("__part").collect()  # one row a partition
    n, offsets = 0, []
    for row in sizes:
        offsets.append((row["__part"], n))
        n += row["count"]
    if not offsets:
        return dealt.withColumn("__place", F.lit(None).cast("long")).drop("__at", "__wanted"), 0
    known = rows.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    placed = dealt.withColumn("__part", part).join(F.broadcast(known), "__part", "left")
    place = F.when(F.col("__wanted"), F.col("__offset") + within + 1)
    return placed.withColumn("__place", place).drop("__at", "__part", "__offset", "__wanted"), n


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    Of the documents with least_words words floor(share in 100) are drawn: the highest scores, ties to the smaller doc_id.
    Null and empty texts have no words, weigh 0 and are not drawn. A null doc_id comes before others in ties. Rows that
    repeat a doc_id are documents of their own. Very long texts are whole steps of one task; a word of any length is
    hashed in pieces. An empty target gives every bucket the gain of its rarity; empty docs give no rows. Other columns
    are not read.
    """
    gains = bucket_gains(docs, target, buckets, longest)
    weighed = document_weights(docs, gains, buckets, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").desc(), F.col("n_features")]
    placed, n = ranked(weighed, F.col("n_words") >= least_words, order)
    rank = F.when(F.col("__place") <= share * n // 100, F.col("__place")).alias("rank")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that resample draws, with all their columns; doc_id must be unique."""
    picks = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("__picked"))
    return docs.join(picks, docs["doc_id"].eqNullSafe(picks["__picked"]), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")
