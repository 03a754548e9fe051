"""Runs SQL over the supplied tables with DuckDB and compares its rows with a Spark result."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(*rows_of(sql, sf_dir))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
