"""Compare a query with its DuckDB SQL over the same tables."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return repr(v)


def same_rows(df, relation):
    """Sorted rows of both, columns by name."""
    names, theirs = sorted(df.columns), relation.columns
    assert names == sorted(theirs)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [theirs.index(c) for c in names]
    return mine, sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
