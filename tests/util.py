import glob
import math
import os

import duckdb


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    return str(v)


def rows(df):
    """Rows of a Spark DataFrame with columns by name, sorted."""
    names = sorted(df.columns)
    return sorted([cell(r[n]) for n in names] for r in df.collect())


def oracle(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted([cell(r[i]) for i in order] for r in got.fetchall())
