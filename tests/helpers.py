"""Rows in a form that two engines agree on."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) or hasattr(value, "quantize"):
        return f"{float(value):.9g}"
    return str(value)


def canonical(rows):
    return sorted(tuple(map(plain, r)) for r in rows)


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same_as_sql(df, con, sql):
    columns = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == columns
    assert canonical(df.select(*columns).collect()) == canonical(con.sql(f"select {','.join(columns)} from ({sql})").fetchall())
