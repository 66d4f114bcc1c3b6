"""Every ledger query against its DuckDB oracle on the smallest driver tables."""

import collections
import datetime
import math
import os

import duckdb
import pytest

from tallyspark import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None or isinstance(value, str | datetime.date):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 6)


def _bag(rows, columns):
    order = sorted(columns)
    return collections.Counter(tuple(_norm(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_oracle(spark, duck, name):
    frame = catalog.queries()[name](spark, SF_DIR)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _bag([tuple(r) for r in frame.collect()], frame.columns) == _bag(cursor.fetchall(), columns)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_gap_runs_no_python_and_shuffles_pairs_once(spark):
    plan = catalog.queries()["c01_gap"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert plan.count("hashpartitioning(item") == 1
