"""The filter audit against a version that applies the filters to one document at a time."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import ROWS, documents, empty, text

from cladewright.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    out = []
    for doc_id, t, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        smaller = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == t for r in rows)
        tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), smaller]
        out.append("".join(f for f, x in zip("ABCDE", tests, strict=True) if x))
    return out


def brute(rows, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    out, removed_by = {}, Counter()
    docs = [(r[3] or "", f, r[0] in good, r[0] in toxic) for r, f in zip(rows, failing(rows), strict=True)]
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                fails = [d for d in mine if f in d[1]]
                gone = [d for d in fails if set(d[1]) & set(order[:s])]
                here = [d for d in fails if not set(d[1]) & set(order[:s])]
                kept = sum(not set(d[1]) & set(order[: s + 1]) for d in mine)
                out[part, order, s + 1] = [kept, len(here), len(gone), sum(d[1] == f for d in fails), sum(d[2] for d in here), sum(d[3] for d in here)]
                removed_by[part, f] += len(here)
    return sorted((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_equals_brute_force(spark):
    rows = ROWS + [
        (20, text(30, 60) + " # " + text(31, 20), "en", "a"), (21, text(1, 300), "en", "a"), (22, "Word WORD word " * 30, "en", ""), (23, None, "en", "b"),
        (24, "É" * 70 + "AAA " * 60, "fr", "zz"), (25, text(40, 20_000), "en", "b"), (26, "y" * 90_000 + " y", "en", "b"),
    ]
    labels = [(0, 1, 0), (1, None, 1), (20, 0, 1), (20, 1, 0), (9, 1, 1), (None, 1, 1), (999, 1, 1), (22, 0, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, rows).withColumnRenamed("member", "part"), known)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)
    assert filter_audit.audit(empty(spark), known).count() == 0


def test_words_that_share_a_hash_are_told_apart():
    t = ["ab cd ab ef", "", "gh gh ij", "longer-word-of-many-bytes longer-word-of-many-bytez longer-word-of-many-bytes"]
    data, offsets = np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0] + [len(x) for x in t])
    assert list(filter_audit.distinct_words(data, offsets)) == [3, 0, 2, 2]
    assert list(filter_audit.distinct_words(data, offsets, np.zeros(10, np.uint64))) == [3, 0, 2, 2]


@pytest.mark.parametrize("n", [1, 3])
def test_other_numbers_of_filters(n):
    orders, kept, removed, redundant = filter_audit.order_effects(n)
    fails = np.array([[[m >> f & 1 for m in range(1 << n)] for f in o] for o in orders])
    assert (removed + redundant == fails).all()
    assert (kept[:, -1].sum(1) == 1).all()
