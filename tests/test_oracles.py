"""Every registered query against its SQL check on the smallest tables."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from fleetaudit.queries import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# The corpus queries have their own tests.


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_check(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_check(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["app_id", "score", "rating"] and df.count() > 0


def test_every_check_has_a_query():
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(queries) and set(QUERIES) <= set(queries) and set(ORACLES) <= set(checks)
