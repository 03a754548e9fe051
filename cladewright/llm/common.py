"""Shared pieces of the training-data operators: scratch tables and vectorised text hashing.

Text hashing works on the Arrow buffers of a whole batch: words are found with byte-class masks and hashed
through prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import functools
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but 0-9, A-Z, a-z and non-ASCII characters parts words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column | str) -> Column:
    """Array of the lower-cased words of a text; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


# -- scratch tables ------------------------------------------------------------------------------------------------

_made: list[str] = []
_tables: list[str] = []
#: Spark's switch that lets the shuffle files of a query go as soon as the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only where the session names none (tests) a local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that goes with cleanup()."""
    path = f"{shared_dir(spark)}/cladewright-{name}"
    _made.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps survive lost executors.

    The table stays until cleanup(), as lazy results may still read it.
    """
    spark = df.sparkSession
    path = scratch(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Writes within leave no shuffle files behind, as nothing reads them once what they led to is written."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def saved_in_buckets(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """As saved(), but a table in one bucket for each shuffle partition, so that joins on columns don't shuffle it again."""
    spark = df.sparkSession
    table_name = f"cladewright_{name}_{uuid.uuid4().hex}"
    _tables.append(table_name)
    df.write.option("path", scratch(spark, table_name)).bucketBy(shuffle_width(spark), *columns).saveAsTable(table_name)
    return spark.table(table_name)


def cleanup(spark: SparkSession) -> None:
    """Deletes the scratch tables written so far; call it when their results have been consumed."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- vectorised text hashing ---------------------------------------------------------------------------------------

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


@functools.cache
def byte_codes(fold_case: bool, fold_digits: bool = False) -> np.ndarray:
    """A fixed random 64-bit code for each byte value; A-Z share those of a-z, and digits one, when folded."""
    codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold_case:
        codes[65:91] = codes[97:123]
    if fold_digits:
        codes[48:58] = codes[48]
    return codes


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n, or more, of the multiplier and of its inverse, modulo 2**64."""
    return _powers(max(STEP_BYTES, 1 << n.bit_length()))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_MULTIPLIER, _INVERSE):
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return tuple(both)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial hashes of any byte range in constant time after one cumulative sum."""

    def __init__(self, data: np.ndarray, fold_case: bool = False, fold_digits: bool = False):
        self.up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes(fold_case, fold_digits)[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def text_steps(column, most: int = STEP_BYTES):
    """Yields (first row, bytes, offsets) over an Arrow string column in steps of whole texts; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@functools.cache
def word_bytes() -> np.ndarray:
    """True for the bytes of words: 0-9, A-Z, a-z and those of non-ASCII characters."""
    is_word = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        is_word[a:b] = True
    return is_word


@functools.cache
def visible_bytes() -> np.ndarray:
    """True for all bytes but space and 9 to 13: those of tokens between white space."""
    is_word = np.ones(256, bool)
    is_word[32] = False
    is_word[9:14] = False
    return is_word


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which inside holds; runs do not cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], on[:-1])) & ~edge[:-1]
    after = np.concatenate((on[1:], [False])) & ~edge[1:]
    return np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold_case: bool = True, fold_digits: bool = False):
    """(hash of each word, number of words of each text)."""
    start, end = spans(data, offsets, inside)
    counts = np.diff(np.searchsorted(start, offsets))
    return (PrefixHash(data, fold_case, fold_digits).of(start, end) if len(start) else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of word shingles, number for each text), repeats kept; a text of fewer words, but not none, is one."""
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    at = np.repeat(first - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
    last = np.repeat(first + counts, n)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        i = at + k
        ok = i < last
        total = total * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, words[np.minimum(i, len(words) - 1)], np.uint64(k)) if len(at) else total
    return mix(total), n
