"""Every query with SQL against DuckDB on the smallest tables, where they are present."""

import math
import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
if not os.path.isdir(FOLDER):
    pytest.skip("no tables", allow_module_level=True)

from groundswell.plans import queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    made = duck.sql(Q.oracle_sql()[name])
    assert sorted(made.columns) == names
    order = [made.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in order) for r in made.fetchall()), key=repr)
    assert got == want


def test_entry_has_a_query_for_each_statement(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["row", "col", "dtm", "chm", "mrm", "vdi"]
