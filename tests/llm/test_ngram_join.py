import re

from fixtures import ROWS, documents, edited, empty, text

from cladewright.llm import ngram_join as nj

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NEAR = [(100 + i, edited(text(50 + i % 6, 150), 60 + 11 * (i % 7)), "en", "n") for i in range(60)]


def brute(rows):
    sets = []
    for _, x, *_ in rows:
        w = WORD.findall((x or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sets, links, [find(i) for i in range(len(rows))]


def test_links_and_classes_equal_brute_force(spark):
    rows = ROWS + NEAR
    sets, links, classes = brute(rows)
    got = sorted(((r.doc_id, r.n_links, r.n_shingles) for r in nj.jaccard_classes(documents(spark, rows)).collect()), key=str)
    assert got == sorted(((r[0], n, len(s)) for r, n, s in zip(rows, links, sets, strict=True)), key=str)
    kept = nj.first_of_each_class(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    alone = sum(1 for s in sets if not s)
    assert kept.count() == len({c for c, s in zip(classes, sets, strict=True) if s}) + alone


def test_prefixes_are_shortened_to_the_target():
    k = nj.prefix_length(0.8, 16, 6, 0.999)
    assert 1 - (1 - 0.8**k) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 16


def test_hot_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 4)
    rows = NEAR
    _, links, _ = brute(rows)
    assert sorted((r.doc_id, r.n_links) for r in nj.jaccard_classes(documents(spark, rows)).collect()) == sorted((r[0], n) for r, n in zip(rows, links, strict=True))


def test_empty(spark):
    assert nj.jaccard_classes(empty(spark)).count() == 0
    assert nj.first_of_each_class(empty(spark)).count() == 0
