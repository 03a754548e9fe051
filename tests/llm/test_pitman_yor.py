import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
from fixtures import ROWS, documents, empty

from cladewright.llm import common
from cladewright.llm import pitman_yor as py

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def test_base_scores_and_counts(spark):
    got = py.score_documents(documents(spark)).collect()
    docs = [(d, [*TOKEN.findall((x or "").encode().translate(FOLD)), None]) for d, x, *_ in ROWS]
    c = Counter(w for d, ws in docs if not py.is_held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, py.is_held_out(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in docs), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert any(r.held_out for r in got) and all(r.score < 0 for r in got)


def table(word, context, shard=0):
    """A shard's row with every pair of these contexts and words, seen or not; word 40 is never seen: the unknown."""
    every = np.array([(c, w) for c in np.unique(context) for w in range(41)])
    counts = np.zeros((int(context.max()) + 1, 41), np.int64)
    np.add.at(counts, (context, word), 1)
    columns = py._table(np.unique(context).astype(np.uint64), np.arange(41, dtype=np.uint64), np.searchsorted(np.unique(context), every[:, 0]) * 41 + every[:, 1], counts[every[:, 0], every[:, 1]])
    return SimpleNamespace(shard=shard, **dict(zip(py._names(py.PAIRS), columns, strict=True)))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    word, context = rng.integers(0, 40, 3000), rng.integers(0, 9, 3000)
    shards = [py.Shard(table(word[context % 2 == k], context[context % 2 == k], k)) for k in range(2)]
    weight = np.full(41, 1 / 41)
    chains = [list(s.chain(weight, 2.0, 0.6, 1)) for s in shards]
    customers = sum(np.stack([s.by_word(t) for t in chain], 1) for s, chain in zip(shards, chains, strict=True))
    tables = np.minimum(customers, 1)
    totals = py.Totals(3000, 40, (20.0, 2.0), (0.5, 0.6), customers.sum(0), tables.sum(0))
    root = totals.root(customers, tables)
    assert np.allclose(root.sum(0), 1)
    for s, chain in zip(shards, chains, strict=True):
        assert np.allclose(s.by_context(s.probabilities(chain, 2.0, 0.6, root)), 1)


def test_seats_between_one_table_and_one_for_each_customer():
    rng = np.random.default_rng(1)
    customers = np.array([0, 1, 2, 50, 5000] * 40)
    t = py.seat(customers, np.full(200, 300.0), 2.0, 0.7, np.full(200, 0.01), rng)
    assert ((t >= np.minimum(customers, 1)) & (t <= customers)).all()
    sure = py.seat(customers, np.full(200, 300.0), 2.0, 0.7, np.full(200, 1e-12), rng)
    assert (sure == np.minimum(customers, 1)).all()


def kneser_ney(docs):
    """Sum of log10 probabilities of held-out texts under an interpolated Kneser-Ney bigram with one discount a level."""
    texts = [(py.is_held_out(d), [b"", *TOKEN.findall((x or "").encode().translate(FOLD)), None]) for d, x in docs]
    pairs = Counter(p for held, ws in texts if not held for p in zip(ws, ws[1:], strict=False))
    customers, types, follows = Counter(), Counter(), Counter()
    for (u, w), c in pairs.items():
        customers[u] += c
        types[u] += 1
        follows[w] += 1
    discount = lambda c: (n := Counter(c.values()))[1] / (n[1] + 2 * n[2])
    d0, d1 = discount(follows), discount(pairs)
    base = d0 * len(follows) / len(pairs) / (len(follows) + 1)
    total = 0.0
    for held, ws in texts:
        for u, w in zip(ws, ws[1:], strict=False) if held else ():
            p = max(follows[w] - d0, 0) / len(pairs) + base
            total += math.log10((max(pairs[u, w] - d1, 0) + d1 * types[u] * p) / customers[u] if customers[u] else p)
    return total


def test_held_out_text_is_no_worse_than_by_kneser_ney(spark):
    sf = "/root/testdata/sf0.01"  # not the table by which the strengths were chosen
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = py.op3_pitman_yor(spark, sf).filter("held_out").agg({"score": "sum"}).first()[0]
    assert got >= kneser_ney(docs)


def test_held_out_text_is_better_than_base(spark):
    r = py.op3_pitman_yor(spark, "/root/testdata/sf0.001").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_empty(spark):
    assert py.score_documents(empty(spark)).count() == 0


def test_parts_and_their_tree_change_no_score(spark, monkeypatch):
    docs = documents(spark).select("doc_id", "text").repartition(7)
    rows = lambda: sorted(((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in py.score_documents(docs).collect()))
    want = rows()
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(py, "PART_BYTES", max(1, size // 5))
    monkeypatch.setattr(py, "FAN", 2)
    assert rows() == want


def test_cleanup_drops_the_bucketed_table_and_the_switch_is_as_before(spark):
    before = spark.conf.get(common.FREE_SHUFFLES, None)
    got = py.score_documents(documents(spark))
    n = got.count()
    assert got.count() == n == len(ROWS)  # results can be read again
    assert spark.conf.get(common.FREE_SHUFFLES, None) == before
    mine = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("cladewright_parts")]
    assert mine()
    common.cleanup(spark)
    assert not mine()


def test_occurrences_are_not_shuffled_again(spark):
    """The side of the last join that has the occurrences is a bucketed scan without an exchange."""
    lines = py.score_documents(documents(spark))._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(k for k, x in enumerate(lines) if "ShuffledHashJoin" in x)
    scan = next(k for k, x in enumerate(lines) if "FileScan" in x and "occurrence" in x)
    assert "Bucketed: true" in lines[scan]
    assert join < scan and not any("Exchange" in x for x in lines[join:scan])  # the join's first child comes first
    assert any("Exchange" in x for x in lines[scan:])
