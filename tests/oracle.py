"""Compare a DataFrame with DuckDB SQL over the same tables: columns by name, rows as a multiset."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df, con, sql):
    got = rows_of(df.columns, df.collect())
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = rows_of(names, out.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want))
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, different[:3]
    kinds = {d[0]: str(d[1]) for d in out.description}
    for name, kind in df.dtypes:
        expect = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(kind)
        assert expect is None or kinds[name] in (expect, "NUMBER", "STRING", "bool"), (name, kind, kinds[name])
