import re

from fixtures import BASE, ROWS, documents, empty

from cladewright.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, " ".join(BASE.split()[20:45])), (2, "nothing of this occurs anywhere in any of the documents at all"), (3, "One"), (4, None), (5, "..."), (None, "abc abc"), (1, "ünï çödé"), (10, " ".join(BASE.split()[20:45]))]


def words(x):
    return WORD.findall((x or "").translate(FOLD))


def brute(rows, items):
    windows = {}
    for item, x in items:
        w = words(x)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, x, *_ in rows:
        w, hit, found = words(x), set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def test_hits_equal_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.benchmark_hits(documents(spark), items).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(ROWS, ITEMS)


def test_stage_drops_hit_documents_only(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    docs = documents(spark)
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    want = [d for d, _, hit, _ in brute(ROWS, ITEMS[:1]) if not hit]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.benchmark_hits(empty(spark), items).count() == 0
    assert decontamination.benchmark_hits(documents(spark), items.limit(0)).filter("n_hit > 0").count() == 0
