"""Every registered query against its SQL at the smallest scale; those without SQL return rows."""

import math
import os

import duckdb
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return None if x is None else round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    assert rows
    if sql := registry.oracle_sql().get(name):
        cur = con.execute(sql)
        found = [c[0] for c in cur.description]
        assert sorted(found) == names
        assert rows == sorted(str([plain(r[found.index(n)]) for n in names]) for r in cur.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200


def test_every_oracle_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_other_queries_stay_where_the_pipeline_cannot_be_imported(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "quire.llm", None)
    assert __spark_entry__.queries().keys() == registry.queries().keys()
    assert __spark_entry__.oracle_sql().keys() == registry.oracle_sql().keys()
