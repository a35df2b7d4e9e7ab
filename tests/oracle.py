"""A query's rows and its SQL's rows, in comparable form."""

import datetime
import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path if os.path.isfile(path) else glob.escape(path) + "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return None if math.isnan(v) else round(float(v), 6)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql):
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    return got, want
