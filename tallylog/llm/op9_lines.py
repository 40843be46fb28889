"""Line dedup: drop the lines that many documents share.

Lines are exploded as hashes of their keys, the documents of each hash are counted (a partial
aggregate, so a line of every document costs one row a task), and the hashes over the threshold go back
to the lines that have them. The positions that go are collected by row (no more than a text has lines), and each text is put together again
from the positions that stay.

Defined results: a null or empty text is one empty line, and stays so (null becomes empty). A key of fewer than
``min_chars`` code points is never dropped. Rows of one doc_id count as one document; rows with a null id
count as one, too. Each row is cut by itself, whatever its id. A text whose lines all go becomes empty. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import digest128, lower_ascii, packed, unpacked, with_row_key, written

MIN_DOCS = 10
MIN_CHARS = 1
#: Both-ended white space: U+0020 and U+0009 to U+000D.
_BLANK = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(_BLANK)))


def _digest(key: Column) -> Column:
    h1, h2 = digest128(key)
    return F.struct(h1.alias("h1"), h2.alias("h2"))


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2): the hashes of the lines that are in at least ``min_docs`` documents."""
    keys = F.filter(F.transform(_lines(), _key), lambda k: F.char_length(k) >= min_chars)
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, _digest))).alias("h")).select("doc_id", "h.h1", "h.h2")
    counts = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_docs).select("h1", "h2")


def counted_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text (cut), n_lines, n_dropped and ``_row``, a struct of the other columns of ``docs``."""
    keyed = with_row_key(packed(docs), "doc_id", "text")
    # Written, so that the join reads two plain tables: a small one is broadcast, and a hot line can be split.
    common = written(common_lines(docs, min_docs, min_chars))
    each = keyed.select("_k1", "_k2", F.posexplode(F.transform(_lines(), _key)).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    each = each.select("_k1", "_k2", "pos", _digest(F.col("key")).alias("h")).select("_k1", "_k2", "pos", "h.h1", "h.h2")
    gone = each.join(common, ["h1", "h2"]).groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("gone"))
    n = F.size(_lines())
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    out = keyed.join(gone, ["_k1", "_k2"], "left").select("doc_id", "_row", _lines().alias("lines"), n.cast("long").alias("n_lines"), left.alias("left"))
    text = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    return out.select("doc_id", text.alias("text"), "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), "_row")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows and columns of ``docs`` with ``text`` cut."""
    return unpacked(counted_lines(docs, min_docs, min_chars), docs.columns)


def op9_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return counted_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -1)) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
