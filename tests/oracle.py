"""Compare a query with DuckDB SQL over the same tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = Path("/root/testdata/sf0.001")


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    return repr(value)


def connection(folder=FOLDER):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def compare(spark, query, sql, folder=FOLDER):
    df = query(spark, str(folder))
    columns = sorted(df.columns)
    own = sorted(str([normal(r[c]) for c in columns]) for r in df.collect())
    cursor = connection(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert own == sorted(str([normal(r[i]) for i in places]) for r in cursor.fetchall())
    assert own
