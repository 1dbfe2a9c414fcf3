"""Every registered query with SQL gives the same rows as DuckDB on the same tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from accordwell import registry, suite  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    """Comparable and with its type, so that 1, 1.0 and True differ; nested values as tuples."""
    if isinstance(x, dict):
        x = tuple(x.values())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (bytes, bytearray)):
        return "bytes", bytes(x)
    return type(x).__name__, "nan" if isinstance(x, float) and math.isnan(x) else x


def rows(columns: list[str], records) -> Counter:
    """How often each row occurs, columns by name. Not by way of pandas: it makes floats of whole numbers beside nulls."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, db, name):
    mine, theirs = registry.QUERIES[name](spark, DATA), db.execute(registry.ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, mine.collect()) == rows(names, theirs.fetchall())
