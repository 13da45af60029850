"""Compares a query with its SQL on the driver's tables."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    def plain(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(plain(v) for v in row)) for row in frame[columns].itertuples(index=False))


def same(spark, query, sql):
    tables = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        tables.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = query(spark, DATA).toPandas()
    assert rows_of(got) == rows_of(tables.sql(sql).df())
    return len(got)
