"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is WINDOW consecutive words of an item (a shorter item is one window of all its words). A document is hit where
a whole window occurs in it. As containment must be exact, a window's necessary prefix is one shingle: a window can only
occur where its rarest shingle does. One scan of the documents meets every shingle that any item has; their frequencies
over all documents give the order by rarity; the occurrences of each window's rarest shingle are its candidates. Their
position and the document's length bound where the window must lie, and its words are compared there.

The item side is broadcast only while it has at most BROADCAST_WINDOWS windows; beyond that Spark shuffles both sides.

Defined cases: null or wordless texts have no words and no hits; wordless items have no windows; items without an
item_id count as hits but are not listed; rows that repeat a doc_id are told apart by their text, and equal rows get
equal results; an empty table of documents gives no rows, one of items no hits; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, words_of

WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 200_000


def _shingle(parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(parts)), *parts)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w: words of a window, item_id), each pair once."""
    words = items.select("item_id", words_of("text").alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("w")).distinct()


def window_shingles(windows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(w, shift, shingle) for each shingle of each distinct window; shift counts words before it."""
    n = F.least(F.size("w"), F.lit(width))
    shifts = F.sequence(F.lit(0), F.size("w") - n)
    at = windows.select("w").distinct().select("w", n.alias("n"), F.explode(shifts).alias("shift"))
    of = F.coalesce(*[F.when(F.col("n") == k, _shingle([F.get("w", F.col("shift") + j) for j in range(k)])) for k in range(1, width + 1)])
    return at.select("w", "n", "shift", of.alias("shingle"))


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items (sorted ids as strings)."""
    windows = saved(item_windows(items, window), "windows")
    small = windows.count() <= BROADCAST_WINDOWS
    shingles = saved(window_shingles(windows), "shingles")
    widths = sorted(r.n for r in shingles.select("n").distinct().collect())  # at most SHINGLE numbers

    # One scan: a row for each document's first position and one wherever an item's shingle occurs, with the words
    # around it. The array stays a reference inside the generated code and is sliced only in rows that stay.
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of("text").alias("words"))
    shifted = [F.col("words"), *[F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))) for k in range(1, max(widths, default=1))]]
    scan = words.select("doc_id", "text_key", "words", F.posexplode_outer(F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(shifted)])).alias("pos", "z"))
    for n in widths:
        known = shingles.filter(F.col("n") == n).select(F.col("shingle").alias(f"s{n}")).distinct()
        scan = scan.withColumn(f"h{n}", _shingle([F.col("z")[f"c{k}"] for k in range(n)]))
        scan = scan.join(_sized(known, small), F.col(f"h{n}") == F.col(f"s{n}"), "left")
    met = reduce(lambda a, b: a | b, [F.col(f"s{n}").isNotNull() for n in widths], F.lit(False))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    reach = window - 1
    from_word = F.greatest(F.col("pos") - reach, F.lit(0))
    found = scan.filter(met | first).select(
        "doc_id", "text_key", F.when(first, F.size("words")).alias("n_words"), F.size("words").alias("length"), "pos",
        F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"s{n}").alias("shingle")) for n in widths] or [F.lit(None).cast("struct<n:int,shingle:bigint>")]).alias("met"),
        from_word.alias("from_word"), F.when(met, F.slice("words", from_word + 1, 2 * reach + 1)).alias("around"),
    )
    found = saved(found, "occurrences")

    occurrences = found.filter(F.col("around").isNotNull()).select("doc_id", "text_key", "length", "pos", "from_word", "around", F.explode("met").alias("m")).filter("m.shingle is not null")
    occurrences = occurrences.select("doc_id", "text_key", "length", "pos", "from_word", "around", F.col("m.shingle").alias("shingle"))
    frequency = occurrences.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_corpus"))
    by_rarity = Window.partitionBy("w").orderBy("n_corpus", "shingle", "shift")
    # a window with a shingle that no document has cannot occur: the left join leaves it a count of 0 and no candidates
    prefix = shingles.join(frequency, "shingle", "left").fillna(0, ["n_corpus"]).withColumn("rank", F.row_number().over(by_rarity)).filter("rank = 1").select("shingle", "shift", "w")
    start = F.col("pos") - F.col("shift")
    fits = (start >= 0) & (start + F.size("w") <= F.col("length"))
    same = F.slice("around", F.greatest(start - F.col("from_word") + 1, F.lit(1)), F.size("w")) == F.col("w")
    matches = occurrences.join(_sized(prefix, small), "shingle").filter(fits & same).select("doc_id", "text_key", start.alias("start"), F.size("w").alias("n"), "w").distinct()
    matches = saved(matches, "matches")

    in_document = Window.partitionBy("doc_id", "text_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    covered = matches.select("doc_id", "text_key", "start", "n").distinct().withColumn("before", F.coalesce(F.max(end).over(in_document), F.lit(0)))
    hit = covered.groupBy("doc_id", "text_key").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    ids = windows.select("w", F.col("item_id").cast("string").alias("item"))
    named = matches.select("doc_id", "text_key", "w").distinct().join(_sized(ids, small), "w").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_text = hit.join(named.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    per_text = per_text.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "n_hit", "items")
    every = found.filter("n_words is not null").select("doc_id", "text_key", "n_words")
    out = every.join(per_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "text_key", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns."""
    bad = benchmark_hits(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__t")), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB: windows of items joined to windows of the same length of every document.
OP1_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[i : i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
occ AS (SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
m AS (SELECT o.doc_id, o.i, o.n, iw.item_id FROM occ o JOIN iw ON o.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
