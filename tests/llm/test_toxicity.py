import numpy as np
from fixtures import ROWS, documents, empty, text

from cladewright.llm import toxicity as tx

DOCS = [(i, text(i, 60) + (" vile" if i % 4 == 0 else "") + text(i + 900, 30), "en", "a") for i in range(400)]


def labels(spark, rows=None):
    return spark.createDataFrame(rows if rows is not None else [(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")


def test_learns_and_scores_held_out(spark):
    docs = documents(spark, DOCS)
    model = tx.fit(docs, labels(spark))
    got = tx.with_scores(docs, model).select("doc_id", "__score", (tx.crc("doc_id") % 5 == 0).alias("out")).collect()
    held = [(r["__score"] >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.out]
    assert np.mean(held) > 0.9
    kept = tx.without_toxic(docs, labels(spark))
    assert kept.columns == docs.columns
    assert sum(r.doc_id % 4 == 0 for r in kept.collect()) < 15


def test_odd_rows_and_labels(spark):
    docs = documents(spark)
    model = tx.fit(documents(spark, DOCS), labels(spark))
    got = tx.with_scores(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["__score"] <= 1 for r in got)
    none = tx.fit(docs, labels(spark, []))
    assert not none.trained and {r["__score"] for r in tx.with_scores(docs, none).collect()} == {0.0}
    assert tx.without_toxic(docs, labels(spark, [(1, 1, None)])).count() == len(ROWS)


def test_gradients_of_responses():
    m = tx.blank_model()
    word, stem = np.array([1, 2, 3, 4], np.uint16), np.array([5, 6, 7, 8], np.uint16)
    x, r = tx.responses(m, word, stem, np.array([3, 1]))
    f = tx.FILTERS
    assert np.allclose(r[0, f : 2 * f], x[0] @ m.filters[:, f : 2 * f] + x[1] @ m.filters[:, 2 * f : 3 * f], atol=1e-5)
    assert np.allclose(r[2, f : 2 * f], x[2] @ m.filters[:, f : 2 * f], atol=1e-5)  # past the text's end there are zeros


def test_empty(spark):
    assert tx.without_toxic(empty(spark), labels(spark)).count() == 0
