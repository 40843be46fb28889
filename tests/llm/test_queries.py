"""Registered queries on the small tables against SQL, or against plain Python where SQL cannot say it."""

import hashlib
import os

import duckdb
import pytest

from tallylog.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(q.ORACLE))
def test_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = duck.execute(q.ORACLE[name])
    names = sorted(d[0] for d in got.description)
    assert sorted(df.columns) == names
    want = sorted(got.df()[names].itertuples(index=False, name=None), key=repr)
    assert sorted(df.select(*names).toPandas().itertuples(index=False, name=None), key=repr) == want


def test_suffix_query(spark, duck):
    from test_op6_suffix import brute

    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = {d: hashlib.sha256(k).hexdigest() for (d, _), k in zip(rows, brute([t for _, t in rows], 400), strict=True)}
    assert {r["doc_id"]: r["kept_sha256"] for r in q.QUERIES["op6_suffix"](spark, SF).collect()} == want


def test_simhash_query(spark, duck):
    from test_op5_simhash import fingerprint, labels

    rows = sorted(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    prints = [fingerprint(t) for _, t in rows]
    want = {d: (f"{p:016x}", rows[w][0]) for (d, _), p, w in zip(rows, prints, labels(prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.QUERIES["op5_simhash"](spark, SF).collect()} == want


def test_pii_query(spark, duck):
    from test_op3_pii import brute

    from tallylog.llm.op3_pii import listed

    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = {d: hashlib.sha256(listed(brute(t)).encode()).hexdigest() for d, t in rows}
    assert {r["doc_id"]: r["base_sha256"] for r in q.QUERIES["op3_pii"](spark, SF).collect()} == want


def test_quality_query(spark, duck):
    rows = {r["doc_id"]: r for r in q.QUERIES["op1_quality"](spark, SF).collect()}
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    held = [(rows[d]["predicted"], y) for d, y in labels if d in rows and rows[d]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
