"""Hierarchical Pitman-Yor language model over a sharded corpus.

Restaurants. Each token is a customer in the restaurant of its context, the whole token before it (texts begin in a
context of their own). All contexts share the root as parent, and the root's base is uniform over the vocabulary and one
unknown token. There are as many restaurants as there are different tokens, so what the model gathers grows with the
corpus. Longer contexts are not kept.

Sharding. Contexts are dealt to shards by hash, so that a restaurant lies in one shard with all its customers and tables,
and only the root is shared. A shard holds the training counts of (context, token) pairs, never occurrences: the most
frequent context holds at most one row for each token of the vocabulary. The root is dealt by token into buckets. Shards
send it the tables of each of their tokens, it seats them as its customers, and each shard gets back the root's state of
its own tokens only. Nothing but sums over all tokens reaches the driver.

Sampling. A Gibbs step takes all customers of one dish out of a restaurant and seats them again one by one, given the
others' tables and the parent's probability; the dishes of a shard take this step together, given the totals of the
sweep before. Rounds alternate between contexts, given the root of the round before, and the root. The last pass
runs the same seeded chain as the round that gave the root its customers, so that each sample's probabilities add up to
one exactly; scores are the log of probabilities averaged over samples.

Data flow. One scan turns texts into chunks of pairs and their occurrences, packed for each shard; one shuffle brings
them to their shard and part, a part being the chunks of about PART_BYTES of text, so that a context that a third of all
occurrences have does not fill a task. The pairs of parts are merged FAN at a time into those of their shard; log
probabilities go down the same tree to the parts, where occurrences are scored; sums for each document return by chunk.
Parts are a bucketed table, so that their occurrences are shuffled once only.

Defined cases: a null text is empty and has the end token only; null doc_ids are learned from and not held out; rows
that repeat a doc_id are scored one by one, and learned from one by one; without training tokens every token is
unknown; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PrefixHash, freed_shuffles, mix, saved, saved_in_buckets, spans, table, text_steps, visible_bytes

#: Strengths of the root and of contexts; a small one of contexts scored best on held-out texts of sf0.001.
STRENGTH = (20.0, 0.1)
BURN, SAMPLES, ROUNDS, SEED = 2, 4, 2, 11  # at least two rounds
#: Text for a chunk, for a part of the occurrences of a shard, and for a shard; parts merged at once.
CHUNK_BYTES, PART_BYTES, SHARD_BYTES, FAN = 12 << 20, 96 << 20, 32 << 20, 16
SLICE = 1 << 18  # pairs of a shard that arithmetic works on at once, so that temporaries stay small
BEGIN, END = np.uint64(0x8F1C3A5D27B6940E), np.uint64(0xE4D5B0F1A2937C61)


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


# -- packing -------------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Bytes of an array by byte plane, compressed: high planes of small numbers vanish."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(x.dtype.str.encode() + np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31)
    kind = np.dtype(raw[:3].decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=3).reshape(kind.itemsize, -1).T).view(kind).ravel()


# -- from texts to shards ------------------------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(token hashes with one end after each text, hash of the token before each, number for each text)."""
    start, end = spans(data, offsets, visible_bytes())
    counts = np.diff(np.searchsorted(start, offsets))
    word = PrefixHash(data, fold_case=True).of(start, end) if len(start) else np.zeros(0, np.uint64)
    n = counts + 1
    last = np.cumsum(n) - 1
    out = np.full(n.sum(), END)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = word
    before = np.concatenate(([BEGIN], out[:-1]))
    before[last - counts] = BEGIN
    return out, before, n


def _chunk_task(n_shards: int):
    """Texts -> for each chunk of texts a row per shard; shard 0's row also carries the documents."""

    def chunk(key, ids, parts):
        word, before, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        train = np.array([not is_held_out(i) for i in ids])
        doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        shard = (mix(before) % np.uint64(n_shards)).astype(np.int16 if n_shards < 1 << 15 else np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for s in range(n_shards):
            at = order[edges[s] : edges[s + 1]]
            if not len(at) and s:
                continue
            contexts, context = np.unique(before[at], return_inverse=True)
            words, index = np.unique(word[at], return_inverse=True)
            pairs, index = np.unique(context * np.int64(max(1, len(words))) + index, return_inverse=True)
            count = np.bincount(index[train[doc[at].astype(np.int64)]], minlength=len(pairs))
            # only sums of documents are wanted of occurrences, so within a document they are put in the order of pairs
            both = np.sort(doc[at] << np.uint64(32) | index.astype(np.uint64))
            per_doc = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(n)).astype(np.uint32)
            extra = [pack(np.array([x or 0 for x in ids], np.int64)), pack(np.array([x is None for x in ids], np.uint8)), pack(n.astype(np.uint32))] if s == 0 else [None] * 3
            yield [s, key, *_table(contexts, words, pairs, count), pack(both.astype(np.uint32)), pack(per_doc), *extra]

    names = _names(CHUNK_ROW)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        types = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
        ids, parts, size, number = [], [], 0, 0

        def rows():
            for row in chunk(TaskContext.get().partitionId() << 32 | number, ids, parts):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            column = batch.column("doc_id").to_pylist()
            for row, data, offsets in text_steps(batch.column("text")):
                parts.append(tokens(data, offsets))
                ids += column[row : row + len(offsets) - 1]
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield from rows()
                    ids, parts, size, number = [], [], 0, number + 1
        if parts:
            yield from rows()

    return run


PAIRS = "contexts binary, words binary, pair_context binary, pair_word binary, pair_count binary"
CHUNK_ROW = f"shard int, chunk long, {PAIRS}, occurrence binary, per_doc binary, doc_ids binary, doc_nulls binary, doc_tokens binary"
TABLE_ROW = f"shard int, part int, {PAIRS}"
PART_ROW = f"{TABLE_ROW}, occurrence binary, chunks binary, chunk_docs binary, per_doc binary, docs array<struct<chunk:long,ids:binary,nulls:binary,tokens:binary>>"
#: A merged table (child null), or where the pairs and words of one of the tables that it was merged from lie in it.
MERGED_ROW = f"{TABLE_ROW}, child int, pair_place binary, word_place binary"
RATED_ROW = "shard int, part int, log_p binary, word_count binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _table(contexts: np.ndarray, words: np.ndarray, pairs: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Columns of PAIRS; pairs: place of the context times the number of words, plus place of the word."""
    n = max(1, len(words))
    return [contexts.tobytes(), words.tobytes(), pack((pairs // n).astype(np.uint32)), pack((pairs % n).astype(np.uint32)), pack(count.astype(np.int64))]


def _vocabulary(hashes) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(w, np.uint64) for w in hashes]))


def _codes(contexts: np.ndarray, words: np.ndarray, row) -> np.ndarray:
    """Pairs of a row as numbers, in sorted lists of contexts and words that include the row's own."""
    c = np.searchsorted(contexts, np.frombuffer(row.contexts, np.uint64)).astype(np.int64)
    w = np.searchsorted(words, np.frombuffer(row.words, np.uint64)).astype(np.int64)
    return c[unpack(row.pair_context)] * max(1, len(words)) + w[unpack(row.pair_word)]


def _merged(frame):
    """(columns of PAIRS of all rows together, place of each row's pairs among them, words)."""
    contexts, words = _vocabulary(frame["contexts"]), _vocabulary(frame["words"])
    codes = [_codes(contexts, words, r) for r in frame.itertuples()]
    pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
    count = np.bincount(place, np.concatenate([unpack(x) for x in frame["pair_count"]]), len(pairs))
    return _table(contexts, words, pairs, count), np.split(place, np.cumsum([len(c) for c in codes])[:-1]), words


def _ascending(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0).astype(np.uint32))


def _from_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.int64)


def _part_task(key, frame):
    """A part of the chunks of a shard -> its (context, token) pairs with training counts, and its occurrences as pairs."""
    import pandas as pd

    frame = frame.sort_values("chunk", ignore_index=True)
    columns, place, _ = _merged(frame)
    per_doc = [unpack(x) for x in frame["per_doc"]]
    occurrence = [at[unpack(x)].astype(np.uint32) for at, x in zip(place, frame["occurrence"], strict=True)]
    docs = [{"chunk": r.chunk, "ids": r.doc_ids, "nulls": r.doc_nulls, "tokens": r.doc_tokens} for r in frame.itertuples() if r.doc_ids is not None]
    sizes = np.array([len(n) for n in per_doc], np.uint32)
    row = [int(key[0]), int(key[1]), *columns, pack(np.concatenate(occurrence)), pack(frame["chunk"].to_numpy()), pack(sizes), pack(np.concatenate(per_doc)), docs]
    return pd.DataFrame([row], columns=[*_names(TABLE_ROW), "occurrence", "chunks", "chunk_docs", "per_doc", "docs"])


def _merge_task(key, frame):
    """Pairs of some parts of a shard -> one table, with counts added up, and the place of each part's pairs in it."""
    import pandas as pd

    frame = frame.sort_values("child", ignore_index=True)
    columns, place, words = _merged(frame)
    own = [int(key[0]), int(key[1])]
    rows = [[*own, *columns, None, None, None]]
    for r, at in zip(frame.itertuples(), place, strict=True):
        rows.append([*own, *[None] * len(columns), r.child, _ascending(at), _ascending(np.searchsorted(words, np.frombuffer(r.words, np.uint64)))])
    return pd.DataFrame(rows, columns=_names(MERGED_ROW))


def _hand_down_task(key, above, places):
    """A rated table and the places of those it was merged from -> each of those, rated."""
    import pandas as pd

    log_p, count = (unpack(above[c].iloc[0]) for c in ("log_p", "word_count"))
    rows = [[r.shard, r.child, pack(log_p[_from_ascending(r.pair_place)]), pack(count[_from_ascending(r.word_place)])] for r in places.itertuples()]
    return pd.DataFrame(rows, columns=_names(RATED_ROW))


def merged_tables(parts: DataFrame, n_parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """One table for each shard, and for each level of the tree below the places of its tables in those above."""
    top, places = parts.select(*_names(TABLE_ROW)), []
    while n_parts > 1:
        n_parts = -(-n_parts // FAN)
        above = top.withColumn("child", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        merged = saved(above.groupBy("shard", "part").applyInPandas(_merge_task, MERGED_ROW), "tables")
        top = merged.filter("child is null").select(*_names(TABLE_ROW))
        places.append(merged.filter("child is not null").select("shard", "part", "child", "pair_place", "word_place"))
    return top, places


def handed_down(rated: DataFrame, places: list[DataFrame]) -> DataFrame:
    """Log probabilities of the shards' pairs -> those of the parts' pairs."""
    for below in reversed(places):
        rated = rated.groupBy("shard", "part").cogroup(below.groupBy("shard", "part")).applyInPandas(_hand_down_task, RATED_ROW)
    return rated


# -- the model -----------------------------------------------------------------------------------------------------


@dataclass
class Totals:
    """Sums over all tokens: sizes, strengths and discounts of root and contexts, and for each sample the root's customers and tables."""

    n_tokens: float
    n_types: float
    strength: tuple[float, float]
    discount: tuple[float, float]
    customers: np.ndarray  # (SAMPLES,)
    tables: np.ndarray  # (SAMPLES,)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Root probabilities (tokens, SAMPLES) of tokens with these customers and tables there."""
        d, s = self.discount[0], self.strength[0]
        return (customers - d * tables + (s + d * self.tables) / (self.n_types + 1)) / (s + self.customers)


def seat(customers: np.ndarray, others: np.ndarray, strength: float, discount: float, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating the customers of dishes one by one.

    others: tables of other dishes in the restaurant of each; parent: probability of the dish in the restaurant above.
    The first 64 customers of a dish are seated singly; later ones in batches of a sixteenth of those seated, with
    the chance at the batch's start.
    """
    t = np.minimum(customers, 1).astype(np.float64)
    at, seated = np.flatnonzero(customers > 1), 1
    while len(at):
        step = 1 if seated < 64 else seated // 16
        here = np.minimum(customers[at] - seated, step)
        draw_new = (strength + discount * (others[at] + t[at])) * parent[at]
        chance = draw_new / (draw_new + seated - discount * t[at])
        t[at] += rng.random(len(at)) < chance if step == 1 else rng.binomial(here.astype(np.int64), chance)
        seated += step
        at = at[customers[at] > seated]
    return t


def _summed(index: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of x by index, in slices."""
    out = np.zeros(n)
    for low in range(0, len(index), SLICE):
        out += np.bincount(index[low : low + SLICE], x[low : low + SLICE], n)
    return out


class Shard:
    """The restaurants of a shard's contexts, from a row of TABLE_ROW."""

    def __init__(self, row):
        self.number = int(row.shard)
        self.words = np.frombuffer(row.words, np.uint64)
        self.context, self.word = unpack(row.pair_context), unpack(row.pair_word)
        count = unpack(row.pair_count)
        self.count = count.astype(np.uint32) if count.max(initial=0) < 1 << 32 else count
        self.many = np.flatnonzero(self.count > 1)  # only these can have more than one table
        self.n_contexts = int(self.context.max()) + 1 if len(self.context) else 0

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return _summed(self.word, x, len(self.words))

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return _summed(self.context, x, self.n_contexts)

    def chain(self, parent: np.ndarray, strength: float, discount: float, number: int):
        """Yields the tables of each pair in each sample; parent: root probability of each word of the shard."""
        rng = np.random.default_rng((SEED, number, self.number))
        customers, context, parent = self.count[self.many].astype(np.int64), self.context[self.many], parent[self.word[self.many]]
        t = np.minimum(self.count, 1).astype(np.float32)
        for sweep in range(BURN + SAMPLES):
            others = self.by_context(t)[context] - t[self.many]
            t = t.copy()
            t[self.many] = seat(customers, others, strength, discount, parent, rng)
            if sweep >= BURN:
                yield t

    def probabilities(self, chain, strength: float, discount: float, root: np.ndarray) -> np.ndarray:
        """For each pair the predictive probability of the token after the context, averaged over samples.

        root: root probabilities (words, SAMPLES) under the tables of the very chain, in all shards.
        """
        customers = self.by_context(self.count)
        total = np.zeros(len(self.word))
        for k, t in enumerate(chain):
            tables, above = self.by_context(t), np.ascontiguousarray(root[:, k])
            for low in range(0, len(total), SLICE):
                at = slice(low, low + SLICE)
                here, p = customers[self.context[at]], above[self.word[at]]
                inner = (self.count[at] - discount * t[at] + (strength + discount * tables[self.context[at]]) * p) / np.maximum(strength + here, 1e-300)
                total[at] += np.where(here > 0, inner, p)
        total /= SAMPLES
        return total


# Shards and buckets of the root exchange arrays, not rows: a shard's words, sorted by bucket and hash, keep their order in
# all rounds, so hashes are sent once.
SENT_ROW = "shard int, bucket int, words binary, n binary, once long, twice long, customers binary"
ROOT_ROW = "shard int, bucket int, place binary, n binary, customers binary, tables binary, sums array<double>"
SUMS = 4 + 2 * SAMPLES  # of tokens, types, words after one context and after two, and of customers and tables by sample


def _by_bucket(words: np.ndarray, n_buckets: int):
    """(order of words by bucket, edges of the buckets in it)."""
    bucket = (words % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _samples(blobs) -> np.ndarray:
    """(words, SAMPLES) of packed arrays one after another."""
    return np.concatenate([np.zeros((0, SAMPLES)), *[unpack(x).reshape(SAMPLES, -1).T for x in blobs]])


def _count_task(n_buckets: int):
    """Shards -> for each bucket their words, with customers and one table for each context; and pairs met once and twice."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples():
                s = Shard(row)
                order, edges = _by_bucket(s.words, n_buckets)
                n, tables = np.rint(s.by_word(s.count))[order].astype(np.int64), s.by_word(s.count > 0)[order].astype(np.uint32)
                met = {"once": int((s.count == 1).sum()), "twice": int((s.count == 2).sum())}
                rows = []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    at = slice(edges[b], edges[b + 1])
                    rows.append([s.number, b, s.words[order[at]].tobytes(), pack(n[at]), *(0 if rows else x for x in met.values()), pack(tables[at])])
                yield pd.DataFrame(rows, columns=_names(SENT_ROW))

    return run


def _root_rows(frame, place, customers: np.ndarray, tables: np.ndarray, n: np.ndarray | None = None):
    """The state of a bucket for the shards of frame, each with the words at its place; sums in the first row."""
    import pandas as pd

    sums = [0.0] * 4 if n is None else [float(n.sum()), float((n > 0).sum()), float((customers[:, 0] == 1).sum()), float((customers[:, 0] == 2).sum())]
    sums += [*customers.sum(0).tolist(), *tables.sum(0).tolist()]
    packed = lambda x, at: pack(np.ascontiguousarray(x[at].T).astype(np.uint32).ravel())
    rows = []
    for row, at in zip(frame.itertuples(), place, strict=True):
        first = [None, None] if n is None else [_ascending(at), pack(n[at])]
        rows.append([row.shard, row.bucket, *first, packed(customers, at), packed(tables, at), None if rows else sums])
    return pd.DataFrame(rows, columns=_names(ROOT_ROW))


def _first_root_task(frame):
    """What shards first send to a bucket -> its state with one table for each word."""
    frame = frame.sort_values("shard", ignore_index=True)
    words = _vocabulary(frame["words"])
    place = [np.searchsorted(words, np.frombuffer(x, np.uint64)) for x in frame["words"]]
    every = np.concatenate(place)
    n = np.bincount(every, np.concatenate([unpack(x) for x in frame["n"]]), len(words)).astype(np.int64)
    customers = np.bincount(every, np.concatenate([unpack(x) for x in frame["customers"]]), len(words))
    customers = np.repeat(customers[:, None], SAMPLES, axis=1)
    return _root_rows(frame, place, customers, np.minimum(customers, 1), n)


def _root_task(totals: Totals, number: int):
    """The customers that shards send to a bucket, and the bucket's first state -> its state in this round."""

    def run(key, sent, first):
        sent, first = (x.sort_values("shard", ignore_index=True) for x in (sent, first))
        place = [_from_ascending(x) for x in first["place"]]
        every, values = np.concatenate(place), _samples(sent["customers"])
        rng = np.random.default_rng((SEED, 1 << 20, number, int(key[0])))
        customers = np.stack([np.bincount(every, values[:, k]) for k in range(SAMPLES)], 1)
        others, parent = totals.tables.mean() - 1, np.full(len(customers), 1 / (totals.n_types + 1))
        seated = [seat(c, np.full(len(c), others), totals.strength[0], totals.discount[0], parent, rng) for c in customers.T]
        return _root_rows(first, place, customers, np.stack(seated, 1))

    return run


def _root_of(s: Shard, root, n_buckets: int):
    """(customers, tables) at the root, (words, SAMPLES) each, for the words of a shard."""
    order, _ = _by_bucket(s.words, n_buckets)
    root = root.sort_values("bucket")
    out = []
    for column in ("customers", "tables"):
        x = np.empty((len(order), SAMPLES))
        x[order] = _samples(root[column])
        out.append(x)
    return out


def _sweep_task(totals: Totals, number: int, n_buckets: int):
    """A shard and the root's state of its words -> the tables of each word, summed over the shard's contexts."""

    def run(key, pairs, root):
        import pandas as pd

        s = Shard(next(pairs.itertuples()))
        parent = totals.root(*_root_of(s, root, n_buckets)).mean(1)
        order, edges = _by_bucket(s.words, n_buckets)
        sent = np.stack([s.by_word(t) for t in s.chain(parent, totals.strength[1], totals.discount[1], number)])[:, order].astype(np.uint32)
        rows = [[s.number, b, pack(np.ascontiguousarray(sent[:, edges[b] : edges[b + 1]]).ravel())] for b in np.flatnonzero(np.diff(edges)).tolist()]
        return pd.DataFrame(rows, columns=["shard", "bucket", "customers"])

    return run


def _rate_task(before: Totals, totals: Totals, number: int, n_buckets: int):
    """A shard and the root's states of its words -> the log probability of each pair, the count of each token.

    States are the first one, which has the counts, and those of the rounds before the last and of the last.
    """

    def run(key, pairs, root):
        import pandas as pd

        row = next(pairs.itertuples())
        s = Shard(row)
        parent = before.root(*_root_of(s, root[root["round"] == number - 1], n_buckets)).mean(1)
        own = totals.root(*_root_of(s, root[root["round"] == number], n_buckets))
        n = np.empty(len(s.words), np.int64)
        n[_by_bucket(s.words, n_buckets)[0]] = np.concatenate([np.zeros(0, np.int64), *map(unpack, root[root["round"] == 0].sort_values("bucket")["n"])])
        local = totals.strength[1], totals.discount[1]
        p = s.probabilities(s.chain(parent, *local, number), *local, own)
        log_p = np.log10(p, out=p).astype(np.float32)
        return pd.DataFrame([[row.shard, row.part, pack(log_p), pack(n)]], columns=_names(RATED_ROW))

    return run


def _score_task(totals: Totals):
    """Rated parts -> for each chunk the sums of its documents' scores, base scores and known tokens."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                log_p, c = unpack(row["log_p"]).astype(np.float64), unpack(row["word_count"])
                log_base, known = np.log10((c + 1) / (totals.n_tokens + totals.n_types + 1)), (c > 0).astype(np.float64)
                word = unpack(row["pair_word"])
                occurrence, per_doc = unpack(row["occurrence"]), unpack(row["per_doc"])
                doc = np.repeat(np.arange(len(per_doc)), per_doc)
                sums = [np.bincount(doc, x[occurrence], len(per_doc)) for x in (log_p, log_base[word], known[word])]
                edges = np.concatenate(([0], np.cumsum(unpack(row["chunk_docs"]), dtype=np.int64)))
                docs = {d["chunk"]: d for d in row["docs"] or []}
                for k, chunk in enumerate(unpack(row["chunks"]).tolist()):
                    part = [x[edges[k] : edges[k + 1]] for x in sums]
                    d = docs.get(chunk, {})
                    cols = [[chunk], [pack(part[0])], [pack(part[1])], [pack(part[2].astype(np.uint32))], [d.get("ids")], [d.get("nulls")], [d.get("tokens")]]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(x, pa.binary()) for x in cols[1:]]], ["chunk", "score", "base", "known", "ids", "nulls", "tokens"])

    return run


def _document_task(n_tokens: float):
    def run(frame):
        import pandas as pd

        own = frame[frame["ids"].notna()].iloc[0]
        ids, nulls = unpack(own["ids"]), unpack(own["nulls"]).astype(bool)
        score, base, known = (sum(unpack(x).astype(np.float64) for x in frame[k]) for k in ("score", "base", "known"))
        return pd.DataFrame({
            "doc_id": pd.array([None if x else int(i) for i, x in zip(ids, nulls, strict=True)], dtype="Int64"),
            "held_out": [not x and is_held_out(int(i)) for i, x in zip(ids, nulls, strict=True)],
            "n_tokens": unpack(own["tokens"]).astype(np.int64), "n_known": np.rint(known).astype(np.int64),
            "train_tokens": int(n_tokens), "base_score": base, "score": score,
        })

    return run


def _sums(root: DataFrame) -> list[float]:
    return [x or 0.0 for x in root.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(SUMS)]).first()]


def score_documents(docs: DataFrame, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each document."""
    with freed_shuffles(docs.sparkSession):
        parts, rated, places, totals = _fitted(docs, strength)
    occurrences = parts.select("shard", "part", "pair_word", "occurrence", "chunks", "chunk_docs", "per_doc", "docs")
    # the occurrences lie in buckets; only log probabilities are shuffled to them
    scored = occurrences.join(handed_down(rated, places).hint("shuffle_hash"), ["shard", "part"])
    sums = scored.mapInArrow(_score_task(totals), "chunk long, score binary, base binary, known binary, ids binary, nulls binary, tokens binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = sums.groupBy("chunk").applyInPandas(_document_task(totals.n_tokens), schema)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _fitted(docs: DataFrame, strength: tuple[float, float]) -> tuple[DataFrame, DataFrame, list[DataFrame], Totals]:
    """Parts with their occurrences, rated tables of shards, places of the levels between, and sums: all in saved tables."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards, n_parts = max(12, -(-size // SHARD_BYTES)), max(1, -(-size // PART_BYTES))
    chunks = source.mapInArrow(_chunk_task(n_shards), CHUNK_ROW).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(n_parts)).cast("int"))
    parts = saved_in_buckets(chunks.groupBy("shard", "part").applyInPandas(_part_task, PART_ROW), "parts", "shard", "part")
    pairs, places = merged_tables(parts, n_parts)
    sent = saved(pairs.mapInPandas(_count_task(n_shards), SENT_ROW), "sent")
    once, twice = (x or 0 for x in sent.agg(F.sum("once"), F.sum("twice")).first())
    rounds = [saved(sent.groupBy("bucket").applyInPandas(_first_root_task, ROOT_ROW), "root")]
    n_tokens, n_types, root_once, root_twice, *sums = _sums(rounds[0])
    discount = tuple(max(0.1, min(0.95, n1 / max(1.0, n1 + 2 * n2))) for n1, n2 in ((root_once, root_twice), (once, twice)))
    totals = [Totals(n_tokens, n_types, strength, discount, np.array(sums[:SAMPLES]), np.array(sums[SAMPLES:]))]
    index = rounds[0].select("shard", "bucket", "place")
    for number in range(1, ROUNDS + 1):
        swept = pairs.groupBy("shard").cogroup(rounds[-1].select("shard", "bucket", "customers", "tables").groupBy("shard")).applyInPandas(_sweep_task(totals[-1], number, n_shards), "shard int, bucket int, customers binary")
        rounds.append(saved(swept.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_root_task(totals[-1], number), ROOT_ROW), "root"))
        sums = _sums(rounds[-1])[4:]
        totals.append(Totals(n_tokens, n_types, strength, discount, np.array(sums[:SAMPLES]), np.array(sums[SAMPLES:])))
    state = rounds[0].select("shard", "bucket", F.lit(0).alias("round"), "n", F.lit(None).cast("binary").alias("customers"), F.lit(None).cast("binary").alias("tables"))
    for number in (ROUNDS - 1, ROUNDS):
        state = state.unionByName(rounds[number].select("shard", "bucket", F.lit(number).alias("round"), F.lit(None).cast("binary").alias("n"), "customers", "tables"))
    rated = pairs.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(_rate_task(totals[-2], totals[-1], ROUNDS, n_shards), RATED_ROW)
    return parts, saved(rated, "rated"), places, totals[-1]


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
