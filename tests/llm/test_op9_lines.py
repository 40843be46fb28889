from collections import defaultdict

from tallylog.llm import op9_lines as m

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least, chars):
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or len(docs[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = [(i, f"own {i}\n Footer Line\t\n\nÉ shared\n\x0bfooter line") for i in range(6)] + [(0, "again\nfooter LINE"), (None, "FOOTER line"), (None, None), (7, ""), (8, "\n\n"), (9, "é shared\n" * 2000)]


def test_against_brute_force(spark, docs_of):
    for least, chars in ((3, 1), (6, 1), (2, 0), (3, 12)):
        got = m.counted_lines(docs_of(ROWS), least, chars).collect()
        assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got], key=repr) == brute(ROWS, least, chars)


def test_columns_stay(spark, docs_of):
    docs = docs_of(ROWS)
    out = m.dedup_lines(docs, 3)
    assert out.columns == docs.columns and out.count() == len(ROWS) and out.select("gone").distinct().first()[0] == "gone"
    assert m.dedup_lines(docs.limit(0)).count() == 0


def test_null_ids_in_bulk(spark):
    """100,000 rows of one (null) id are one document, but each is cut by itself; nothing gathers them in a task."""
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("Shared\nown "), F.col("id").cast("string")).alias("text"))
    rows = rows.unionByName(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("shared ").alias("text")))
    got = m.counted_lines(rows, 10).agg(F.sum("n_dropped").alias("d"), F.sum("n_lines").alias("n"), F.countDistinct("text").alias("t")).first()
    assert tuple(got) == (100_009, 200_009, 100_001)
    assert m.counted_lines(rows, 11).agg(F.sum("n_dropped")).first()[0] == 0


def test_a_text_of_very_many_lines(spark, docs_of):
    rows = [(i, "\n".join(f"line {j}" for j in range(60_000))) for i in range(2)] + [(2, "line 7\nown")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in m.counted_lines(docs_of(rows, extra=False), 3).collect()}
    assert got[2] == (2, 1, "own") and got[0][:2] == (60_000, 1) and got[0] == got[1]
