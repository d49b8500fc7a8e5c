"""A query against its SQL, as rows in any order."""

import glob
import os

import duckdb


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = connection(sf_dir).sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    wanted = sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
    assert found == wanted
