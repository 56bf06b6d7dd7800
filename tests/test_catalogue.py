"""Every query against its SQL at the smallest scale."""

import duckdb
import pytest

from reelgrid.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype == bool:
        return bool(x)
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted(repr(tuple(plain(v) for v in r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    b = sorted(repr(tuple(plain(v) for v in r)) for r in want.fetchall())
    if a != b:  # whole numbers may be of either kind
        number = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
        a = sorted(repr(tuple(number(plain(v)) for v in r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
        b = sorted(repr(tuple(number(plain(v)) for v in r)) for r in duck.execute(catalogue.SQL[name]).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
