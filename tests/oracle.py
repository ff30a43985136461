"""Comparison of a Spark result with SQL run by DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, records, columns):
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in records), key=repr)


def same(df, con, sql):
    """The rows that differ, two of each side."""
    got, want = df.collect(), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    a, b = rows(df.columns, got, columns), rows(want.columns, want.fetchall(), columns)
    assert len(a) == len(b)
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y][:2]
