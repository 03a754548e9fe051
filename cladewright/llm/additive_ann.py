"""Approximate nearest neighbours by additive quantisation with exact reranking.

A vector is approximated by the sum of one full-dimensional codeword from each of BOOKS codebooks. Codebooks start as
residual k-means on a bounded sample (SAMPLE vectors of least hash) and are refitted by least squares to the codes that
a beam search finds. Every vector is encoded by beam search in parallel tasks and stored with its codes and the norm of
its approximation. A query scores codes with one lookup table of inner products; the stored norms serve Euclidean
search, where the order is by norm - 2 * inner product. The best RERANK of a block are scored exactly on the original
vectors in double precision.

Queries and candidates meet in blocks of QUERY_BLOCK by DATA_BLOCK rows: a row is sent once to each block of the other
side, a task holds one block of each, and it returns at most k neighbours for each of its queries.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; fewer candidates than k give fewer rows; ties go to the smaller vec_id; rows that repeat a vec_id are candidates
like others, but no query meets rows of its own vec_id, and a repeated query row is asked once; null vec_ids take no
part; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

BOOKS, WORDS, BEAM = 8, 256, 4
SAMPLE = 8192
QUERY_BLOCK, DATA_BLOCK, RERANK = 1024, 8192, 640


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    return rows


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1)


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, refits: int = 2, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dim): residual k-means, then least-squares refits to beam-searched codes."""
    rng, left, out = np.random.default_rng(seed), sample.copy(), []
    for _ in range(books):
        centres = left[rng.choice(len(left), words, replace=len(left) < words)]
        for _ in range(rounds):
            code = _nearest(left, centres)
            total = np.zeros_like(centres)
            np.add.at(total, code, left)
            n = np.bincount(code, minlength=words)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], left[rng.integers(0, len(left), words)])
        left = left - centres[_nearest(left, centres)]
        out.append(centres)
    out = np.stack(out)
    for _ in range(refits):
        codes = encode(sample, out)
        flat = codes + np.arange(books) * words
        gram, target = np.zeros((books * words,) * 2), np.zeros((books * words, sample.shape[1]))
        for i in range(books):
            np.add.at(target, flat[:, i], sample)
            for j in range(books):
                np.add.at(gram, (flat[:, i], flat[:, j]), 1.0)
        out = np.linalg.solve(gram + np.eye(len(gram)) * 0.1, target + 0.1 * out.reshape(-1, sample.shape[1])).reshape(out.shape)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search: each step keeps the beam partial sums of least squared error."""
    n, (m, k, _) = len(x), books.shape
    codes, left = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    for b in range(m):
        error = (left**2).sum(2)[:, :, None] - 2 * left @ books[b].T + (books[b] ** 2).sum(1)
        flat = error.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        if b == m - 1:
            best = np.take_along_axis(best, np.take_along_axis(flat, best, 1).argmin(1)[:, None], 1)
        path, word = best // k, best % k
        rows = np.arange(n)[:, None]
        codes = np.concatenate((codes[rows, path], word[:, :, None].astype(np.uint8)), axis=2)
        left = left[rows, path] - books[b][word]
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[np.arange(len(books)), codes].sum(1)


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, object]:
    """(rows vec_id, raw, codes, norm for every usable vector; the broadcast codebooks, or None without vectors)."""
    spark, rows = vectors.sparkSession, usable(vectors)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.col("v")).toPandas()["v"]
    if not len(picked):
        return rows.select("vec_id", F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm")).limit(0), None
    lengths = [len(v) for v in picked]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    books = spark.sparkContext.broadcast(train(np.stack([v for v in picked if len(v) == dim])))

    def run(frames):
        import pandas as pd

        for f in frames:
            x = np.stack(f["v"].to_numpy()) if len(f) else np.zeros((0, dim))
            out = {"vec_id": f["vec_id"], "raw": [r.tobytes() for r in x]}
            codes = np.concatenate([encode(x[a : a + 2048], books.value) for a in range(0, len(x), 2048)]) if len(x) else np.zeros((0, BOOKS), np.uint8)
            yield pd.DataFrame(out | {"codes": [c.tobytes() for c in codes], "norm": (decode(codes, books.value) ** 2).sum(1)})

    return rows.filter(F.size("v") == dim).mapInPandas(run, "vec_id long, raw binary, codes binary, norm double"), books


def best_k(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores in each row, best first, ties to the smaller id."""
    return np.stack([np.lexsort((i, -s))[:k] for s, i in zip(score, ids, strict=True)])


def _block_task(books, k: int, rerank: int):
    def run(block):
        import pandas as pd

        queries, data = block[block["asks"]], block[~block["asks"]]
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "scores": pd.Series(dtype=object)})
        q, x, ids = _matrix(queries["raw"]), _matrix(data["raw"]), data["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(data["codes"]), np.uint8).reshape(len(data), -1)
        tables = np.einsum("qd,bwd->qbw", q, books.value).astype(np.float32)
        out = []
        for i, own in enumerate(queries["vec_id"]):
            guess = tables[i][np.arange(codes.shape[1]), codes].sum(1)
            guess[ids == own] = -np.inf
            n = min(rerank, len(guess))
            near = np.argpartition(-guess, n - 1)[:n]
            near = near[ids[near] != own]
            exact = (x[near] * q[i]).sum(1)
            top = np.lexsort((ids[near], -exact))[:k]
            out.append((own, ids[near][top].tolist(), exact[top].tolist()))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    return run


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of each row for which is_query holds."""
    rows, books = index(vectors)
    empty = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return vectors.sparkSession.createDataFrame([], empty)
    stored = saved(rows, "codes")
    queries = stored.filter(is_query).dropDuplicates(["vec_id"])
    n, n_queries = stored.count(), queries.count()
    # row keys spread repeated ids over the blocks too; counts are scalars
    blocks, query_blocks = max(1, -(-n // DATA_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    data = stored.select(F.lit(False).alias("asks"), "vec_id", "raw", "codes", F.pmod(F.xxhash64("vec_id", "raw"), F.lit(blocks)).alias("d"), upto(query_blocks).alias("q"))
    asked = queries.select(F.lit(True).alias("asks"), "vec_id", "raw", F.lit(None).cast("binary").alias("codes"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("q"), upto(blocks).alias("d"))
    found = data.unionByName(asked).groupBy("q", "d").applyInPandas(_block_task(books, k, rerank), "query_id long, ids array<long>, scores array<double>")
    each = F.transform(F.arrays_zip("scores", "ids"), lambda z: F.struct((-z["scores"]).alias("far"), z["ids"].alias("id")))
    best = found.select("query_id", each.alias("z")).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
    ranked = best.select("query_id", F.posexplode("z").alias("p", "z"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("z.id").alias("vec_id"), (-F.col("z.far")).alias("score"))


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
