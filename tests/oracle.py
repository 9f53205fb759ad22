"""Rows of a query and of its SQL, as multisets."""

from collections import Counter
from pathlib import Path

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return Counter(tuple(fix(r[i]) for i in order) for r in rows)


def both(spark, sf, query, sql):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    df = query(spark, sf)
    found = db.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    return rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
