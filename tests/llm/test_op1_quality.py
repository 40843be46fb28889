import numpy as np
import pytest

from tallylog.llm import op1_quality as m


def made(n, seed=0):
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 9)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(r.integers(20, 80))]
        good = i % 3 > 0
        rows.append((i, " ".join(ws if good else [w.upper() + "!!" for w in ws]), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = m.score(docs, m.learn(docs, labels)).withColumn("h", m.held_out(docs.doc_id)).collect()
    held = [r for r in got if r["h"]]
    assert len(got) == 300 and 60 < len(held) < 140
    assert np.mean([(r["_score"] >= 0.5) == bool(rows[r["doc_id"]][2]) for r in held]) > 0.95


def test_column_equals_numpy():
    x = np.random.default_rng(1).random((200, len(m.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] < 0.7)).astype(float)
    model = m.fit(x, y)
    assert 0 < len(model.rules) < 200 and ((model.predict(x) >= 0.5) == y).mean() > 0.95


def test_compiled_rules_score_alike(spark, docs_of):
    rows = made(120, 3)
    x = np.array([m.statistics_of(r[1]) for r in rows])
    model = m.fit(x, np.array([r[2] for r in rows], float))
    got = {r["doc_id"]: r["_score"] for r in m.score(docs_of([r[:2] for r in rows], False), model).collect()}
    assert np.allclose([got[r[0]] for r in rows], model.predict(x))


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = made(200, 5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    held = m.held_out(labels.doc_id)
    assert m.learn(docs, labels) == m.learn(docs, labels.where(~held))


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(None, 1), (3, None), (1, 0), (1, 1)]])
def test_few_or_odd_labels(spark, docs_of, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = docs_of([(1, "a b"), (2, None), (None, ""), (2, "x" * 200_000), (2, None)])
    kept = m.keep_good(docs, table)
    assert kept.columns == docs.columns and 0 <= kept.count() <= 5
    scores = [r["_score"] for r in m.score(docs.select("doc_id", "text"), m.learn(docs, table)).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)


def test_empty_table(spark, docs_of):
    table = spark.createDataFrame([], "doc_id long, quality int")
    assert m.keep_good(docs_of([]), table).count() == 0


def test_rows_of_one_id_are_one_text_in_any_order(spark):
    """A labelled id repeated with other texts: one of them is fitted, and the order of the rows decides nothing."""
    rows = made(150, 6)
    texts = [r[:2] for r in rows] + [(r[0], f"{r[1]} {k}") for r in rows[:30] for k in range(40)]
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    once, back = (m.learn(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (texts, texts[::-1]))
    assert once == back == m.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), labels)
