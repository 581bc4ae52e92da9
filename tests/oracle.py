"""Hold a query against its SQL: columns by name, rows in any order."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, sf_dir, f, sql):
    """None if equal, else what differs."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} and {sorted(rel.columns)}"
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    if got != want:
        lost = [x for x in want if x not in set(got)][:2]
        extra = [x for x in got if x not in set(want)][:2]
        return f"{len(got)} rows, SQL {len(want)}; only in SQL {lost}, only in Spark {extra}"
    return None if got else "no rows"
