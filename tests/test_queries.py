"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from sparkloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows):
    """Rows in order; numbers that aren't whole are rounded, whole ones are kept to the last digit."""
    fix = lambda v: ("nan" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


def kinds(rows):
    """The Python types in each column, null aside: an integer isn't a double, a truth isn't an integer."""
    return [{type(v).__name__ for v in column if v is not None} for column in zip(*rows, strict=True)]


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rel = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    have = [tuple(r[c] for c in cols) for r in got.collect()]
    assert kinds(have) == kinds(want)
    assert canonical(have) == canonical(want)
