import hashlib
from collections import Counter

import numpy as np
from fixtures import ROWS, documents, empty

from cladewright.llm import suffix_dedup as sd


def brute(rows, n, keep_first=False):
    raws = [(d, (x or "").encode()) for d, x, *_ in rows]
    seen, out = Counter(r[i : i + n] for _, r in raws for i in range(len(r) - n + 1)), []
    first = set()
    for d, r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - n + 1):
            s = r[i : i + n]
            if (s in first) if keep_first else seen[s] > 1:
                hit[i : i + n] = b"\1" * n
            first.add(s)
        rest = bytes(b for b, h in zip(r, hit, strict=True) if not h)
        out.append((d, len(r), sum(hit), sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_all_copies_go(spark):
    assert rows_of(sd.suffix_dedup(documents(spark), keep_first=False)) == brute(ROWS, 200)


def test_first_copies_stay(spark):
    rows = [(i, x, "en", "a") for i, (_, x, *_) in enumerate(ROWS)]
    assert rows_of(sd.suffix_dedup(documents(spark, rows), keep_first=True)) == brute(rows, 200, keep_first=True)


def test_suffix_array_and_lpf():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    ends = np.repeat([120, 300], [120, 180])
    starts = np.arange(300)
    order, lcp = sd.suffix_array(data, ends, starts, 40)
    cut = lambda i: bytes(data[i : min(ends[i], i + 40)])
    assert order.tolist() == sorted(range(300), key=lambda i: (cut(i), i))
    lpf = sd.longest_previous_factor(order, lcp, 1)

    def common(a, b):
        x, y = cut(a), cut(b)
        return next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))

    want = [max((common(i, j) for j in range(i)), default=0) for i in order.tolist()]
    assert [x if x >= 1 else 0 for x in want] == lpf.tolist()


def test_empty(spark):
    assert sd.suffix_dedup(empty(spark)).count() == 0
