"""Toxicity: a small convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first bytes. Filters of several widths slide
over the words; the largest response of each filter in the text, through a rectifier, feeds a logistic output. Training
uses a bounded sample of labelled rows (SAMPLE, the rows of least hash) on the driver: the sample holds hashed words, not
texts, and only the windows that win the pooling carry gradients. Every text is scored whole, in tasks that share the
broadcast weights, whose size is fixed by BUCKETS. A part of the sample is kept from training to calibrate one
threshold for each language; a language with few such rows takes the threshold over all.

Defined cases: null and wordless texts get the score of no evidence; a null doc_id counts as not held out and is never
learned from; labels that are null are left out, and a document labelled more than once counts as toxic if any label
says so; without labels of both kinds every score is 0; rows are scored one by one, so repeated rows get equal scores;
an empty table gives no rows; further columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PrefixHash, spans, table, text_steps, word_bytes

BUCKETS, STEM = 1 << 15, 5
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
SAMPLE = 12_000
STEPS, BATCH, RATE = 1600, 64, 0.08


@dataclass
class Model:
    word: np.ndarray
    stem: np.ndarray
    filters: np.ndarray  # (DIM, sum of widths * FILTERS), one block of FILTERS for each place in each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    trained: bool = True
    thresholds: dict = field(default_factory=dict)


def blank_model(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    n = sum(WIDTHS) * FILTERS
    small = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
    return Model(small(BUCKETS, DIM), small(BUCKETS, DIM), rng.normal(0, DIM**-0.5, (DIM, n)).astype(np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), small(len(WIDTHS) * FILTERS), -1.0)


def hashed_tokens(data: np.ndarray, offsets: np.ndarray):
    """(word bucket, stem bucket) of each word and the number of words of each text."""
    start, end = spans(data, offsets, word_bytes())
    counts = np.diff(np.searchsorted(start, offsets))
    if not len(start):
        return np.zeros(0, np.uint16), np.zeros(0, np.uint16), counts
    prefix = PrefixHash(data, fold_case=True)
    shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
    return (prefix.of(start, end) >> shift).astype(np.uint16), (prefix.of(start, np.minimum(start + STEM, end)) >> shift).astype(np.uint16), counts


def responses(m: Model, word: np.ndarray, stem: np.ndarray, counts: np.ndarray):
    """(word vectors, response of each filter at each word); a filter that reaches past the text's end sees zeros there."""
    x = m.word[word] + m.stem[stem]
    part = x @ m.filters
    n = len(x)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the text's end
    cols, k = [], 0
    for width in WIDTHS:
        total = part[:, k * FILTERS : (k + 1) * FILTERS].copy()
        for j in range(1, width):
            block = part[j:, (k + j) * FILTERS : (k + j + 1) * FILTERS]
            total[: n - j] += block * (left[: n - j] > j)[:, None] if n > j else 0
        cols.append(total)
        k += width
    return x, np.concatenate(cols, axis=1)


def scores(m: Model, word: np.ndarray, stem: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not m.trained:
        return np.zeros(len(counts))
    pooled = np.zeros((len(counts), len(m.bias)), np.float32)
    some = counts > 0
    if some.any():
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1][some]
        pooled[some] = np.maximum(np.maximum.reduceat(responses(m, word, stem, counts)[1], starts, axis=0) + m.bias, 0)
    return 1 / (1 + np.exp(-(pooled @ m.out + m.out_bias).astype(np.float64)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Model:
    """Adagrad on the logistic loss; texts are (word buckets, stem buckets)."""
    m, rng = blank_model(seed), np.random.default_rng(seed + 1)
    past = {k: np.full_like(getattr(m, k), 1e-2) for k in ("word", "stem", "filters", "bias", "out")}
    past_b, n_filters = 1e-2, len(m.bias)
    place = np.concatenate([np.arange(w) + k for w, k in zip(WIDTHS, np.cumsum((0, *WIDTHS)), strict=False)])
    of_place = np.repeat(np.arange(len(WIDTHS)), WIDTHS)
    usable = np.array([i for i, t in enumerate(texts) if len(t[0])])
    for _ in range(-(-STEPS * BATCH // max(BATCH, len(usable)))):
        order = rng.permutation(usable)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            word, stem = (np.concatenate([texts[i][k] for i in batch]) for k in (0, 1))
            counts = np.array([len(texts[i][0]) for i in batch])
            x, r = responses(m, word, stem, counts)
            ends = np.cumsum(counts)
            best = np.stack([e - c + r[e - c : e].argmax(0) for c, e in zip(counts, ends, strict=True)])  # (batch, filter)
            raw = r[best, np.arange(n_filters)] + m.bias
            pooled = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(pooled @ m.out + m.out_bias)))
            d = ((p - labels[batch]) / len(batch)).astype(np.float32)
            g_out, g_pool = pooled.T @ d, np.outer(d, m.out) * (raw > 0)
            g_filters, rows, grads = np.zeros_like(m.filters), [], []
            for w_index, k in zip(of_place, place, strict=True):
                j = k - int(np.cumsum((0, *WIDTHS))[w_index])
                f = slice(w_index * FILTERS, (w_index + 1) * FILTERS)
                at = best[:, f] + j
                ok = at < ends[:, None]
                g = np.where(ok, g_pool[:, f], 0)
                at = np.minimum(at, len(x) - 1)
                block = slice(k * FILTERS, (k + 1) * FILTERS)
                g_filters[:, block] = np.einsum("bfd,bf->df", x[at], g)
                rows.append(at.ravel())
                grads.append((g[:, :, None] * m.filters[:, block].T[None]).reshape(-1, DIM))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            live = np.abs(grads).sum(1) > 0
            rows, grads = rows[live], grads[live]
            for name, ids in (("word", word), ("stem", stem)):
                unique, inverse = np.unique(ids[rows], return_inverse=True)
                total = np.zeros((len(unique), DIM), np.float32)
                np.add.at(total, inverse, grads)
                past[name][unique] += total**2
                getattr(m, name)[unique] -= RATE * total / np.sqrt(past[name][unique])
            for name, g in (("filters", g_filters), ("bias", g_pool.sum(0)), ("out", g_out)):
                past[name] += g**2
                getattr(m, name)[...] -= RATE * g / np.sqrt(past[name])
            past_b += float(d.sum()) ** 2
            m.out_bias -= RATE * float(d.sum()) / past_b**0.5
    return m


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold of highest F1, in the middle of the gap below the last score taken in; 0.5 without positives."""
    if not label.any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(len(order)) + 1 + label.sum())
    last = np.concatenate((np.diff(score[order]) < 0, [True]))  # equal scores go in together
    k = int(np.argmax(np.where(last, f1, -1)))
    following = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(min(0.95, max(0.05, (score[order[k]] + following) / 2)))


def _token_task(batches):
    """Texts -> their hashed words as bytes."""
    import pyarrow as pa

    for batch in batches:
        for row, data, offsets in text_steps(batch.column("text")):
            word, stem, counts = hashed_tokens(data, offsets)
            edges = np.concatenate(([0], np.cumsum(counts)))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            n = len(counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), batch.column("lang").slice(row, n), batch.column("toxic").slice(row, n), cut(word), cut(stem)], ["doc_id", "lang", "toxic", "word", "stem"])


def crc(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_rows: int = 30) -> Model:
    """Trains on at most sample labelled rows that are not held out, and calibrates thresholds on a tenth of them."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc("doc_id") % 5 != 0))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "text", "lang", "toxic")
    got = rows.mapInArrow(_token_task, "doc_id long, lang string, toxic int, word binary, stem binary").toPandas().sort_values("doc_id", ignore_index=True)
    label = (got["toxic"].to_numpy() > 0).astype(np.float32) if len(got) else np.zeros(0, np.float32)
    if len(got) == 0 or label.min() == label.max():
        model = blank_model()
        model.trained = False
        return model
    texts = [(np.frombuffer(w, np.uint16), np.frombuffer(s, np.uint16)) for w, s in zip(got["word"], got["stem"], strict=True)]
    aside = np.arange(len(got)) % 10 == 7
    model = train([t for t, x in zip(texts, aside, strict=True) if not x], label[~aside])
    if aside.any():
        kept = [t for t, x in zip(texts, aside, strict=True) if x]
        counts = np.array([len(t[0]) for t in kept])
        s = scores(model, np.concatenate([t[0] for t in kept]), np.concatenate([t[1] for t in kept]), counts)
        lang, y = got["lang"].fillna("").to_numpy()[aside], label[aside]
        model.thresholds[""] = best_threshold(s, y)
        for name in sorted(set(lang)):
            own = lang == name
            if name and own.sum() >= least_rows and y[own].any():
                model.thresholds[name] = best_threshold(s[own], y[own])
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs and a column __score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, data, offsets in text_steps(batch.column("text")):
                word, stem, counts = hashed_tokens(data, offsets)
                out[row : row + len(counts)] = scores(m, word, stem, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "__score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__score", DoubleType())]))


def threshold(model: Model, lang: Column) -> Column:
    default = F.lit(model.thresholds.get("", 0.5))
    named = [x for k, v in sorted(model.thresholds.items()) if k for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*named), lang), default) if named else default


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below their language's threshold, with all their columns."""
    model = fit(docs, labels)
    return with_scores(docs, model).filter(F.col("__score") < threshold(model, F.col("lang"))).drop("__score") if model.trained else docs


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs, model)
    limit = threshold(model, F.col("lang"))
    return scored.select(
        "doc_id", F.coalesce(crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("__score") >= limit).alias("rejected"),
    )
