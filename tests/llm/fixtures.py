"""Small documents with nulls, empty and long texts, ties and repeated rows, and brute-force versions of the operators."""

import random

WORDS = ["w" + "".join("abcdefghij"[int(c)] for c in str(i)) + "ord" for i in range(400)]


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out, line = [], []
    for _ in range(n):
        line.append(rng.choice(WORDS))
        if rng.random() < 0.06:
            out.append(" ".join(line))
            line = []
    return "\n".join([*out, " ".join(line)])


def edited(x: str, every: int) -> str:
    w = x.split(" ")
    return " ".join("changed" if i % every == every - 1 else v for i, v in enumerate(w))


BASE = text(1, 300)
ROWS = [
    (0, BASE, "en", "a"), (1, BASE, "en", "b"), (2, edited(BASE, 90), "en", "b"), (3, text(2, 40), "de", "c"), (4, None, None, None), (5, "", "en", "a"),
    (6, "one", "en", "a"), (7, text(3, 12_000), "fr", "d"), (8, text(4, 60) + "\n" + BASE[:700], "en", "a"), (9, " \n\t ", "en", "c"),
    (9, text(5, 50), "en", "c"), (10, text(6, 200), "en", None), (10, text(6, 200), "en", None), (None, text(7, 80), "es", "e"), (11, "Ünï çödé " * 40, "fr", "e"),
    (12, "x" * 900, "en", "a"), (13, text(8, 30).upper() + " 123 45", "en", "a"), (14, edited(text(8, 30), 400), "en", "a"), (15, "abc " * 300, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ROWS):
    """With further columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("n_chars", "size", "member", "words", "line", "block", "score", "text_key", "w", "d", "t", "key")})


def empty(spark):
    return documents(spark).limit(0)
