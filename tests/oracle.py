"""Comparing a Spark result with DuckDB SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        try:
            return repr(float(v) + 0.0) if not isinstance(v, bool) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)


def check(spark_frame, sql, folder):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want, got = db.execute(sql).df(), spark_frame.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
