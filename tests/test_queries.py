"""Every query with SQL against DuckDB on the smallest table."""

import duckdb
import pytest

from kindred import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return float(v) if hasattr(v, "dtype") and v.dtype.kind == "f" else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in cur.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted(rows, key=key)
