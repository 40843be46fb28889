import random
import re

import pytest

from tallylog.llm import op2_decontaminate as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda x: x[0].lower(), t or "")


def brute(docs, items, size):
    wins = []
    for name, t in items:
        ws = WORD.findall(lower(t))
        if ws:
            wins += [(name, ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]
    out = []
    for d, t in docs:
        ws, hit, names = WORD.findall(lower(t)), set(), set()
        for name, w in wins:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(name)
        out.append((d, len(ws), len(hit), tuple(sorted(str(n) for n in names if n is not None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "terms", "few"), [(10, 200_000, 1_000_000), (3, 0, 0), (10, 200_000, 0)])
def test_against_brute_force(spark, docs_of, size, terms, few):
    r = random.Random(size)
    w = lambda n: " ".join(r.choice(["the", "The", "cat", "sat", "ön", "mat", "x1", "of"]) for _ in range(n))
    items = [(1, w(12)), (10, w(14)), (2, w(2)), (3, ""), (4, None), (1, w(11)), (None, w(3)), (5, "zebra quagga"), (6, "a a a a a a a a a a a a")]
    docs = [(i, f"{w(20)}, {r.choice(items)[1] or ''}! {w(9)}") for i in range(40)] + [(None, items[0][1]), (7, None), (7, ""), (50, items[0][1]), (50, items[0][1]), (51, "a " * 30), (52, w(4000) + " " + items[1][1])]
    got = m.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), size, terms, few).collect()
    assert sorted([(x["doc_id"], x["n_words"], x["n_hit"], tuple(x["item_ids"])) for x in got], key=repr) == brute(docs, items, size)


def test_clean_keeps_the_rest_whole(spark, docs_of):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = docs_of([(1, "zero ONE two, three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine"), (None, None), (2, "")])
    kept = m.clean(docs, items)
    assert kept.columns == docs.columns and sorted([r["text"] for r in kept.collect()], key=repr) == sorted(["one two three four five six seven eight nine", None, ""], key=repr)
    assert m.clean(docs, items.limit(0)).count() == 4 and m.clean(docs.limit(0), items).count() == 0
    assert m.contamination(docs.limit(0), items).count() == 0


def test_proximity(spark, docs_of):
    docs = docs_of([(1, "a b c d e a"), (2, "a x x x x x e"), (3, None)])
    pairs = spark.createDataFrame([("a", "e"), ("a", "a")], "a string, b string")
    got = {tuple(r) for r in m.proximity_matches(docs, pairs, 4).collect()}
    assert got == {(1, "a", "e", 0, 4), (1, "a", "e", 5, 4)}


def test_no_python_in_the_plan(spark, docs_of):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    plan = m.contamination(docs_of([(1, "one two three")]), items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_windows_of_few_terms_are_not_broadcast(spark, docs_of):
    """Four terms, but more words in windows than may be sent: the tables of windows are joined by shuffle."""
    items = spark.createDataFrame([(i, " ".join("abcd"[i >> 2 * k & 3] for k in range(6))) for i in range(400)], "item_id long, text string")
    docs = docs_of([(1, "a b c d a b c"), (2, "d d d d d d d")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, n in ((1_000_000, True), (100, False)):
            keyed = m.with_row_key(docs.select("doc_id", "text"), "doc_id", "text")
            plan = m.phrase_matches(keyed, m.cut_words(keyed), items, 6, 200_000, few)[0]._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
