"""Every registered query with SQL gives what the SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallylog.plans import catalogue

SF = os.environ.get("TALLYLOG_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, data):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(show(r[i]) for i in order) for r in data], key=repr)


def same(spark, duck, f, sql):
    df = f(spark, SF)
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query(spark, duck, name):
    same(spark, duck, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_mined_findings_lose_nothing(spark):
    got = catalogue.mined_findings(spark, SF)
    assert got.select("finding_key").distinct().count() == got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
