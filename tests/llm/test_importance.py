"""Importance resampling against a version that hashes and sorts one feature at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from fixtures import ROWS, documents, empty, text
from pyspark.sql import functions as F

from cladewright.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(t):
    words = WORD.findall((t or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, features(r[1])[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for doc_id, x, *_ in rows:
        words, found = features(x)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    key = lambda r: tuple(-1 if v is None else v for v in r)
    return sorted(((*r[:4], rank.get(id(r))) for r in out if r[0] is not None), key=key), [(*r[:4], rank.get(id(r))) for r in out if r[0] is None]


def test_crcs_of_words_of_any_length():
    rng = random.Random(1)
    texts = ["", "One two three", "x" * 1000 + " " + "y" * 63 + " " + "z" * 64 + " " + "w" * 65 + " q", "Ünï çödé ab,cd", "a" * 100_000 + " b"]
    texts += [" ".join("".join(rng.choice("abcXYZ09é,.") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    found, counts = importance.feature_buckets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        words = features(t)[0]
        assert len(words) == n
        for i in range(n):
            want = [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 if i + k <= n else -1 for k in (1, 2, 3)]
            assert [f[at + i] for f in found] == want
        at += n


def test_equals_brute_force(spark):
    rows = ROWS + [(100 + i, text(50 + i, 10 + 3 * i), "en", "a") for i in range(80)] + [(300, text(9, 15_000), "en", "a"), (301, "w" * 70_000 + " short", "en", "b")]
    target = [text(51, 30), None, "", text(60, 50) + " benchmark words"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = importance.resample(documents(spark, rows), bench).select("doc_id", "n_features", "weight", "score", "rank").collect()
    some, none = brute(rows, target)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r) for r in got if r.doc_id is not None), key=key) == some
    assert sum(r["rank"] is not None for r in got) == 5 * sum(len(features(r[1])[0]) >= 20 for r in rows) // 100 > 0
    assert [tuple(r) for r in got if r.doc_id is None] == none
    picked = importance.drawn(documents(spark, [r for r in rows if r[0] not in (9, 10)]), bench)
    assert "n_chars" in picked.columns and picked.count() > 0


def test_odd_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert importance.resample(empty(spark), bench).count() == 0
    tied = documents(spark, [(i // 2, "same words " * 12, "en", "a") for i in range(200)])
    got = importance.resample(tied, bench.limit(0)).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11))
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)
    again = importance.resample(tied.repartition(7), bench.limit(0)).filter("rank is not null")
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 1000).alias("score")).repartition(13)
    placed, n = importance.ranked(rows, F.col("score") % 2 == 0, [F.col("score").desc(), F.col("id")])
    got = placed.filter("__place is not null").orderBy("__place").collect()
    assert n == len(got) == 2500
    assert [r["__place"] for r in got] == list(range(1, 2501))
    assert [(-r.score, r.id) for r in got] == sorted((-r.score, r.id) for r in got)
