"""Licence scan, mixing, additive quantisation, and the whole pipeline."""

import numpy as np
import pytest
from fixtures import ROWS, documents, empty
from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from cladewright.llm import additive_ann, license_scan, mixing, queries
from cladewright.llm.license_texts import KNOWN

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_licences_are_known_by_any_spelling(spark):
    mit = KNOWN["MIT"].replace("<year> <copyright holders>", "1999 Someone, Inc.").upper().replace("\n\n", "\n\n\n  ").replace("LICENSE", "LICENCE")
    rows = [(1, mit, "en", "a"), (2, KNOWN["MIT"] + " and more", "en", "a"), (3, None, "en", "a"), (4, KNOWN["Apache-2.0-notice"].replace(",", ""), "en", "a"), (5, "Copyright 2020 me", "en", "a")]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, rows)).collect()}
    assert [got[i].license for i in range(1, 6)] == ["MIT", None, None, "Apache-2.0-notice", None]
    assert got[3].canonical_sha256 == got[5].canonical_sha256
    assert license_scan.scan(empty(spark)).count() == 0


def test_long_licences_and_whole_words(spark):
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(KNOWN)
    reflowed = KNOWN["GPL-3.0"].upper().replace("LICENSE", "LICENCE").replace("\n", "\n\n   ").replace("2007 FREE", "1999 Some Free")
    twice = KNOWN["MPL-2.0"].replace("acknowledgment", "acknowledgement")
    texts = [reflowed, KNOWN["Apache-2.0"], twice, "the super center", "the supercenter", "sub license sub license", "sublicense sublicense", None, KNOWN["Apache-2.0"]]
    rows = [(None if i == 8 else i, t, "en", "a") for i, t in enumerate(texts)]
    got = license_scan.scan(documents(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].license for i in (0, 1, 2)] == ["GPL-3.0", "Apache-2.0", "MPL-2.0"]
    assert by_id[3].canonical_sha256 != by_id[4].canonical_sha256 and by_id[5].canonical_sha256 == by_id[6].canonical_sha256
    assert by_id[None].license == "Apache-2.0" and by_id[7].license is None
    # several known texts of one canonical form: the first name stands for them
    assert license_scan.scan(documents(spark, [(1, "One, two", "en", "a")] * 2), {"b": "one two", "a": "ONE two"}).select("license").distinct().collect()[0][0] == "a"


def targets(sizes):
    """By hand: fill all sources alike by weight, cap, and share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        full = {s for s in open_ if out[s] + share[s] >= 3 * sizes[s]}
        if not full:
            for s in open_:
                out[s] += share[s]
            break
        # only the sources that fill up are settled in this round; the rest is shared anew
        for s in full:
            left -= 3 * sizes[s] - out[s]
            out[s] = 3.0 * sizes[s]
        open_ -= full
    return out


def test_mixing_meets_targets(spark):
    docs = documents(spark).select("*")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, x, _, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((x or "").split())
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r["size"] for r in own) + 1e-6
        assert all(r.taken <= 3 * r["size"] for r in own)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mixing_is_unbiased_and_balanced_at_size(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 50


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0] * 3), (None, [1.0] * 16), (0, x[5].tolist()), (3004, [1.0] * 15 + [None])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("codes", F.lit(1))
    got = additive_ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    ids, all_x = np.append(np.arange(1500), 0), np.vstack([x, x[5]])
    hits = n = 0
    for q in range(0, 1500, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert len(mine) == 20 and [r.score for r in mine] == sorted((r.score for r in mine), reverse=True) and all(r.vec_id != q for r in mine)
        if q:
            s = np.where(ids == q, -np.inf, all_x @ x[q])
            hits += len({r.vec_id for r in mine} & set(ids[np.argsort(-s)[:20]].tolist()))
            n += 20
            assert all(abs(r.score - (x[r.vec_id] @ x[q])) < 1e-9 or r.vec_id == 0 for r in mine)
    assert hits / n >= 0.9
    few = additive_ann.nearest_neighbours(df.limit(4), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 3
    assert additive_ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_runs_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, last, SF)
        assert out.columns == docs.columns, name
        last = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < last.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, last, SF).count() == last.count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    """run() on nulls, empty texts, repeated rows and clashing columns, and on an empty table."""
    from cladewright.llm import common

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    passage = " ".join(ROWS[0][1].split()[3:16])
    for folder in (tmp_path, tmp_path / "none"):
        spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert 0 not in ids  # it holds the passage; what its copies kept are lines of their own
    assert {None, 3, 6, 7, 12} <= set(ids) and ids.count(10) == 1
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    common.cleanup(spark)
