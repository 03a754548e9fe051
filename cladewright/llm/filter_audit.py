"""Audit of filters that act one after another: what each removes, alone and in every order.

Texts are scanned as Arrow buffers: byte classes mark capitals, symbols, continuation bytes and the bytes of words, and
prefix sums of the marks give each text's counts. Words are hashed through prefix sums as well; a sort by text and hash
puts equal words side by side, and the bytes of neighbours are compared, so the number of distinct words is exact. A text
where two different words share a hash is counted again with a set of its words.

Whether an equal text has a smaller doc_id is asked of all rows: the least doc_id of each SHA-256 is aggregated before it
is shuffled, and only digests of several doc_ids are joined back. Each document becomes one mask of the filters that it
fails; rows are counted by part and mask, so at most 2 to the power of the number of filters numbers a part go on. The 120
orders are a fixed matrix over masks, and all parts of a batch are multiplied with it at once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, saved, spans, table, text_steps, visible_bytes

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")


# -- measures of a text ----------------------------------------------------------------------------------------------


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges of length bytes from a and from b are equal; eight bytes of all open pairs are compared a turn."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):  # the eight bytes from each position as one number
        wide = wide[:-step] | (wide[step:] << np.uint64(8 * step))
    same, on, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(on := on[length[on] > k]):
        short = np.maximum(8 - (length[on] - k), 0).astype(np.uint64) * np.uint64(8)
        differ = ((wide[a[on] + k] ^ wide[b[on] + k]) << short) != 0
        same[on[differ]] = False
        on, k = on[~differ], k + 8
    return same


def distinct_words(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """The number of different words of each text, case-sensitive."""
    start, end = spans(data, offsets, visible_bytes())
    if hashes is None:
        hashes = hashed_words(data, offsets, visible_bytes(), fold_case=False)[0]
    counts = np.diff(np.searchsorted(start, offsets))
    of = np.arange(len(counts)).repeat(counts)
    order = np.lexsort((hashes, of))
    again = (of[order[1:]] == of[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    a, b = order[:-1][again], order[1:][again]
    length = end - start
    same = (length[a] == length[b]) & _same_bytes(data, start[a], start[b], np.minimum(length[a], length[b]))
    out = counts - np.bincount(of[a], minlength=len(counts))
    for text in np.unique(of[a[~same]]):
        whole = data[offsets[text] : offsets[text + 1]].tobytes()
        first = offsets[text]
        mine = of == text
        out[text] = len({whole[s - first : e - first] for s, e in zip(start[mine], end[mine], strict=True)})
    return out


def step_measures(data: np.ndarray, offsets: np.ndarray, symbols: str = SYMBOLS) -> list[np.ndarray]:
    """n_words, n_distinct, n_capitals, n_symbols and n_chars (code points) of each text of a step."""
    start, _ = spans(data, offsets, visible_bytes())
    value = np.arange(256)
    capital, first_byte = (value >= 65) & (value <= 90), (value & 0xC0) != 0x80
    symbol = np.isin(value, np.frombuffer(symbols.encode("ascii"), np.uint8))

    def counted(kind):
        sums = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    return [np.diff(np.searchsorted(start, offsets)), distinct_words(data, offsets), counted(capital), counted(symbol), counted(first_byte)]


def _measure_task(symbols: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [step_measures(data, offsets, symbols) for _, data, offsets in text_steps(batch.column("text"))]
            if found:
                measured = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "digest")), *measured], names=["doc_id", "part", "digest", *MEASURES])

    return run


def measures(docs: DataFrame, part: str = "source", symbols: str = SYMBOLS) -> DataFrame:
    """One row per document: doc_id, part (null: empty), digest (SHA-256 of the text), and MEASURES. Null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, digest binary, " + ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(_measure_task(symbols), schema)


# -- filters -----------------------------------------------------------------------------------------------------------


def default_filters() -> dict[str, Column]:
    """Failure conditions over the measures and __later (an equal text has a smaller doc_id), by letter."""
    return {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_chars"),
        "D": F.col("n_symbols") > 0,
        "E": F.col("__later"),
    }


def failures(measured: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """measured with mask (int): bit k is set where the k-th filter fails."""
    filters = filters or default_filters()
    ends = measured.groupBy("digest").agg(F.min("doc_id").alias("__least"), F.max("doc_id").alias("__most")).filter("__least < __most")
    both = measured.join(ends.select("digest", "__least"), "digest", "left")
    both = both.withColumn("__later", F.coalesce(F.col("doc_id") > F.col("__least"), F.lit(False)))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), start=F.lit(0))
    return both.withColumn("mask", mask.cast("int")).drop("__least", "__later")


# -- orders ------------------------------------------------------------------------------------------------------------


def order_effects(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """(all orders of n filters, and for each order, step and mask: is it kept, removed, redundant there)."""
    orders = list(itertools.permutations(range(n)))
    mask = np.arange(1 << n)
    kept, removed, redundant = (np.zeros((len(orders), n, 1 << n), np.int64) for _ in range(3))
    for o, order in enumerate(orders):
        alive = np.ones(1 << n, bool)
        for s, f in enumerate(order):
            fails = (mask >> f) & 1 == 1
            removed[o, s], redundant[o, s] = alive & fails, ~alive & fails
            alive &= ~fails
            kept[o, s] = alive
    return orders, kept, removed, redundant


def _order_task(letters: str):
    n = len(letters)
    orders, kept, removed, redundant = order_effects(n)
    names, steps = ["".join(letters[f] for f in o) for o in orders], n * len(orders)
    which = np.array(orders).ravel()

    def run(batches):
        for df in batches:
            for at in range(0, len(df), 64):  # parts at a time, n * n! rows each
                some = df.iloc[at : at + 64]
                total, good, toxic = (np.array(some[c].tolist(), np.int64).reshape(len(some), 1 << n) for c in ("total", "good", "toxic"))
                over = lambda counts, effect: counts @ effect.reshape(steps, -1).T
                gone = over(total, removed)
                alone = total[:, 1 << which]
                value = np.stack([gone[:, which == f].sum(1) for f in range(n)], 1)[:, which]
                columns = {"kept": over(total, kept), "removed": gone, "redundant": over(total, redundant), "unique_fails": alone, "good_lost": over(good, removed), "toxic_lost": over(toxic, removed), "shapley": value}
                heads = {"part": some["part"].repeat(steps).to_numpy(), "filter_order": np.tile(np.repeat(names, n), len(some)), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(some) * len(orders))}
                yield pd.DataFrame(heads | {k: v.ravel() for k, v in columns.items()})

    return run


def interactions(masked: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """From (part, mask, good, toxic) a row per part, order and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley."""
    n = 1 << len(letters)
    yes = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0))
    counts = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("total"), yes("good").alias("good"), yes("toxic").alias("toxic"))
    # at most n rows a part
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("total", "good", "toxic")))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("m")[k])
    of_every = lambda name: F.transform(every, lambda x: F.coalesce(x[name], F.lit(0))).alias(name)
    rows = by_mask.select("part", *map(of_every, ("total", "good", "toxic")))
    return rows.mapInPandas(_order_task(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, Column] | None = None) -> DataFrame:
    """The interactions of filters over docs, by part; labels (doc_id, quality, toxic) tell what should not be lost.

    Null texts are empty, null parts the empty string. A null doc_id is never a later copy and has no labels. Rows that
    repeat a doc_id count each; of several labels of a doc_id the highest hold. Very long texts are whole steps of one task.
    Empty docs give no rows. Other columns are not read, but for those that filters of one's own name among the measures.
    """
    filters = filters or default_filters()
    # written once: both the digests and the masks are read from it
    masked = failures(saved(measures(docs, part), "measures"), filters).select("doc_id", "part", "mask")
    known = labels.groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    both = masked.join(known, masked["doc_id"] == known["__labelled"], "left")
    return interactions(both.select("part", "mask", "good", "toxic"), "".join(filters))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH measured AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), known AS (
    SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), failing AS (
    SELECT part, m.doc_id,
           CASE WHEN len(words) < 50 THEN 1 ELSE 0 END AS a,
           CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 1 ELSE 0 END AS b,
           CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 1 ELSE 0 END AS c,
           CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
           CASE WHEN m.doc_id > min(m.doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS e,
           CASE WHEN k.quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN k.toxic = 1 THEN 1 ELSE 0 END AS toxic
    FROM measured m LEFT JOIN known k ON m.doc_id = k.doc_id
), masks AS (
    SELECT part, a, b, c, d, e, a + b + c + d + e AS n_failing, count(*) AS total, sum(good) AS good, sum(toxic) AS toxic
    FROM failing GROUP BY ALL
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE q.f <> p.f AND r.f NOT IN (p.f, q.f) AND s.f NOT IN (p.f, q.f, r.f) AND t.f NOT IN (p.f, q.f, r.f, s.f)
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
    FROM orders, range(1, 6) t(step)
), acted AS (
    SELECT part, filter_order, step, f, n_failing, total, good, toxic,
           CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
           greatest(a * CAST(contains(before, 'A') AS INTEGER), b * CAST(contains(before, 'B') AS INTEGER), c * CAST(contains(before, 'C') AS INTEGER),
                    d * CAST(contains(before, 'D') AS INTEGER), e * CAST(contains(before, 'E') AS INTEGER)) AS gone
    FROM masks, steps
), counted AS (
    SELECT part, filter_order, step, f,
           CAST(sum(total * (1 - gone) * (1 - fails)) AS BIGINT) AS kept, CAST(sum(total * (1 - gone) * fails) AS BIGINT) AS removed,
           CAST(sum(total * gone * fails) AS BIGINT) AS redundant,
           CAST(sum(CASE WHEN fails = 1 AND n_failing = 1 THEN total ELSE 0 END) AS BIGINT) AS unique_fails,
           CAST(sum(good * (1 - gone) * fails) AS BIGINT) AS good_lost, CAST(sum(toxic * (1 - gone) * fails) AS BIGINT) AS toxic_lost
    FROM acted GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
