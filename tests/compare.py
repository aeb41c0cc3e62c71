"""Runs a query and its SQL on the same tables and compares rows without regard to order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float):
            return repr(float(v))
        return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=repr)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(path):  # a folder of a test may hold some tables only
            continue
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = db.execute(sql)
    want = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description], dtype=object)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns), name
    assert _norm(got, columns) == _norm(want, columns), name
