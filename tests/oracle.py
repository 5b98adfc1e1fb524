"""Run a query and its SQL side by side."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def both(df, con, sql):
    """What Spark and DuckDB give, with columns by name and rows in order."""
    rel = con.sql(sql)
    return normal(df.columns, [tuple(r) for r in df.collect()]), normal(list(rel.columns), rel.fetchall())
