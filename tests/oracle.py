"""Runs a query and its SQL on the same folder and compares rows regardless of order."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.9g}")
        return v

    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str):
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    want = normal(*sql_rows(sql, sf_dir))
    assert mine[0] == want[0]
    assert len(mine[1]) == len(want[1])
    assert mine[1] == want[1]
