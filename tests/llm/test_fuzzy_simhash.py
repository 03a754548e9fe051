"""Fuzzy hashing against all pairs of fingerprints, and fingerprints against one hash at a time."""

import itertools
import random
import re

import numpy as np
import xxhash
from fixtures import ROWS, documents, edited, empty, text

from cladewright.llm import fuzzy_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(t):
    words = WORD.findall((t or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(bits):
    """The least index that each fingerprint reaches over links."""
    root = list(range(len(bits)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(bits)), 2):
        if (bits[i] ^ bits[j]).bit_count() <= 4:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(bits))]


def test_code_is_perfect_and_keys_lose_no_link():
    nearest, others = fuzzy_simhash.error_tables()
    assert sorted(np.bitwise_count(nearest)) == [0] + [1] * 23 + [2] * 253 + [3] * 1771
    assert ((others > 0).sum(1) == np.where(np.bitwise_count(nearest) == 3, 5, 0)).all()
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**63), 2**63 - 1, 20_000)
    b = a.view(np.uint64).copy()
    for _ in range(4):  # bits may be met twice, so distances are 4, 2 and 0; three flips give the odd ones
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    c = b ^ (np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64))
    for other in (b, c[np.bitwise_count(a.view(np.uint64) ^ c) <= 4]):
        mine = a if other is b else a[np.bitwise_count(a.view(np.uint64) ^ c) <= 4]
        for x, y in zip(fuzzy_simhash.segment_keys(mine), fuzzy_simhash.segment_keys(other.view(np.int64)), strict=True):
            assert set(x[x >= 0]) & set(y[y >= 0])
    # every way to spread four differences over the segments
    for places in itertools.combinations(range(0, 64, 3), 4):
        x = 0x0123456789ABCDEF
        keys = fuzzy_simhash.segment_keys(np.array([x, x ^ sum(1 << p for p in places)], np.uint64).view(np.int64))
        assert set(keys[0][keys[0] >= 0]) & set(keys[1][keys[1] >= 0])


def test_documents_equal_brute_force(spark):
    near = [(200 + i, edited(text(77, 900), 150 + i), "en", "b") for i in range(30)]
    rows = ROWS + near + [(400, text(8, 30), "en", "a"), (401, " \t", "en", "a"), (402, text(11, 9_000), "en", "c"), (403, "a b c", "en", "c")]
    bits = [fingerprint(r[1]) for r in rows]
    roots, least = grouped(bits), {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    want = sorted((str(r[0]), f"{b:016x}", str(least.get(root))) for r, b, root in zip(rows, bits, roots, strict=True))
    found = fuzzy_simhash.classes(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), f"{r.bits % 2**64:016x}", str(r.component_id)) for r in found) == want
    assert len({w[2] for w in want}) < len(rows) - 10  # some are alike
    assert fuzzy_simhash.classes(empty(spark)).count() == 0
    kept = fuzzy_simhash.first_of_each_class(documents(spark, near))
    assert {r.doc_id for r in kept.collect()} == {int(w[2]) for w in want if 200 <= int(w[0] if w[0] != "None" else -1) < 230}


def test_large_keys_in_chunks_and_by_near_words(spark):
    rng = random.Random(4)
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centres = [rng.getrandbits(64) for _ in range(6)]
    bits = sorted({flipped(rng.choice(centres), rng.randint(0, 5)) for _ in range(500)})
    table = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in bits], "bits long")
    want = grouped(bits)
    for options in ({}, {"chunk": 16, "sample": 1}, {"chunk": 16, "sample": 4}, {"chunk": 16, "most": 40, "sample": 1}, {"chunk": 1, "most": 2, "sample": 1}):
        edges = [(r.a % 2**64, r.b % 2**64) for r in fuzzy_simhash.links(table, **options).collect()]
        at = {b: i for i, b in enumerate(bits)}
        assert len(edges) < 40 * len(bits)
        root = list(range(len(bits)))
        for _ in bits:
            before = list(root)
            for a, b in edges:
                root[at[a]] = root[at[b]] = min(root[at[a]], root[at[b]])
            if before == root:
                break
        assert root == want
