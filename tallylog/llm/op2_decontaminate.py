"""Benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

The index holds a posting (token, document, position) for each occurrence of a benchmark term that
anchors a query. A query is a window of consecutive benchmark words; its anchors are its two
rarest terms by the training corpus. The rarest term's list, moved by the term's offset in the item, gives the
starts where the item would lie; the second list, moved likewise, is intersected with it; only
what survives is compared word by word with the document. The same lists give proximity matches:
documents where the two terms lie within a given distance.
Texts are cut into words once, in a written table that serves the counts, the index and the numbers of words.

Defined results: a null or empty text has no words and no hits. An item without words has no window. Repeated rows and
null ids keep their rows, and each gets its own counts. A repeated item_id is one item with all its rows' windows.
A null item_id takes part in hits but has no name to list. Extra columns are ignored by :func:`contamination`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallylog.llm.common import discard, lower_ascii, packed, unpacked, with_row_key, written

WINDOW = 10
#: Different benchmark terms, and words of all different windows together, up to which those tables are broadcast; beyond it they are joined by shuffle.
BROADCAST_TERMS, BROADCAST_WORDS = 200_000, 1_000_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def term_counts(cut: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """(token, n): how often each of ``terms`` occurs in the whole of ``cut`` (array ``ws``); absent terms are left out."""
    tokens = cut.select(F.explode("ws").alias("token"))
    return tokens.join(F.broadcast(terms) if small else terms, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def postings(cut: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """The index's lists for ``terms``: (token, _k1, _k2, pos) for each occurrence in ``cut``."""
    tokens = cut.select("_k1", "_k2", F.posexplode("ws").alias("pos", "token"))
    return tokens.join(F.broadcast(terms) if small else terms, "token")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(w, item_id, off, ws): each window's words with its offset; an item shorter than ``size`` is one window."""
    w = items.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0).dropDuplicates()
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - size, F.lit(0)))
    w = w.select("item_id", "all", F.explode(starts).alias("off"))
    w = w.select("item_id", F.slice("all", F.col("off") + 1, F.lit(size)).alias("ws"))
    return w.withColumn("w", F.sha2(F.to_json("ws"), 256))


def _anchored(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Each different window with its rarest two places; windows with a term that the corpus lacks cannot occur."""
    distinct = wins.select("w", "ws").dropDuplicates(["w"])
    terms = distinct.select("w", F.posexplode("ws").alias("off", "token")).join(counts, "token", "left")
    missing = F.max(F.col("n").isNull())
    rank = terms.groupBy("w").agg(missing.alias("missing"), F.sort_array(F.collect_list(F.struct("n", "token", "off"))).alias("by")).where("not missing")
    return rank.select("w", F.col("by")[0].alias("first"), F.coalesce(F.get("by", F.lit(1)), F.col("by")[0]).alias("second")).join(distinct, "w")


def cut_words(keyed: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2, the words ``ws`` and their number ``n_words``, written."""
    return written(keyed.select("doc_id", "_k1", "_k2", words(F.col("text")).alias("ws")).withColumn("n_words", F.size("ws").cast("long")))


def phrase_matches(docs: DataFrame, cut: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_terms: int = BROADCAST_TERMS, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Exact phrases: (_k1, _k2, start, w, len) over ``docs`` with row keys and their words ``cut``, and the windows (w, item_id)."""
    wins = written(windows(items, size))
    vocabulary = written(wins.select(F.explode("ws").alias("token")).distinct())
    small = vocabulary.count() <= broadcast_terms
    # Windows carry their words, so not their number but that of their words bounds what is sent.
    few = wins.agg(F.coalesce(F.sum(F.size("ws")), F.lit(0))).first()[0] <= broadcast_words
    counts = written(term_counts(cut, vocabulary, small))
    anchors = written(_anchored(wins, counts))
    first = anchors.select("w", F.col("first.token").alias("token"), F.col("first.off").alias("o1"), F.col("second.token").alias("t2"), F.col("second.off").alias("o2"), "ws")
    needed = anchors.select(F.explode(F.array("first.token", "second.token")).alias("token")).distinct()
    index = written(postings(cut, needed, small))
    # The rarest list, moved by its offset: where each window would start.
    starts = index.join(F.broadcast(first) if few else first, "token").select("_k1", "_k2", (F.col("pos") - F.col("o1")).alias("start"), "w", "t2", "o2").where("start >= 0")
    # Intersected with the second list, moved by its own.
    second = index.join(anchors.select(F.col("second.token").alias("token")).distinct(), "token", "left_semi").select("_k1", "_k2", F.col("token").alias("t2"), F.col("pos").alias("p2"))
    both = starts.withColumn("p2", F.col("start") + F.col("o2")).join(second, ["_k1", "_k2", "t2", "p2"], "left_semi").select("_k1", "_k2", "start", "w").distinct()
    # Compared word by word, once a document.
    phrases = anchors.select("w", "ws")
    found = both.join(F.broadcast(phrases) if few else phrases, "w").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "w", "ws")).alias("c"))
    checked = docs.join(found, ["_k1", "_k2"]).select("_k1", "_k2", words(F.col("text")).alias("all"), "c")
    same = F.filter("c", lambda c: F.slice(F.col("all"), c.start + 1, F.size(c.ws)) == c.ws)
    hits = checked.select("_k1", "_k2", F.explode(F.transform(same, lambda c: F.struct(c.start.alias("start"), c.w.alias("w"), F.size(c.ws).alias("len")))).alias("h"))
    return hits.select("_k1", "_k2", "h.start", "h.w", "h.len").distinct(), wins


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(doc_id, a, b, p, q) wherever terms ``a`` and ``b`` of ``pairs`` lie at most ``within`` words apart.

    Positions meet by buckets of ``within`` words, so no list is paired with the whole of another.
    """
    keyed = with_row_key(docs.select("doc_id", "text"), "doc_id", "text")
    terms = pairs.select(F.explode(F.array("a", "b")).alias("token")).distinct()
    cut = keyed.select("_k1", "_k2", words(F.col("text")).alias("ws"))
    index = postings(cut, terms, terms.count() <= broadcast_terms)
    width = max(within, 1)
    left = index.join(pairs.distinct(), F.col("token") == F.col("a")).select("_k1", "_k2", "a", "b", F.col("pos").alias("p"), F.explode(F.array(*[(F.floor(F.col("pos") / width) + i) for i in (-1, 0, 1)])).alias("bucket"))
    right = index.select("_k1", "_k2", F.col("token").alias("b"), F.col("pos").alias("q"), F.floor(F.col("pos") / width).alias("bucket"))
    near = left.join(right, ["_k1", "_k2", "b", "bucket"]).where((F.abs(F.col("p") - F.col("q")) <= within) & ((F.col("a") != F.col("b")) | (F.col("p") < F.col("q"))))
    ids = keyed.select("_k1", "_k2", "doc_id").distinct()
    return near.join(ids, ["_k1", "_k2"]).select("doc_id", "a", "b", "p", "q").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_terms: int = BROADCAST_TERMS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, row key, n_words, n_hit, item_ids (sorted as strings) for each row of ``docs``."""
    keyed = with_row_key(docs.select("doc_id", "text"), "doc_id", "text")
    cut = cut_words(keyed)
    hits, wins = phrase_matches(keyed, cut, items, size, broadcast_terms, broadcast_words)
    hits = written(hits)
    # Runs of hit words by document: a word counts once however many windows cover it.
    w = Window.partitionBy("_k1", "_k2").orderBy("start")
    spans = hits.groupBy("_k1", "_k2", "start").agg(F.max("len").alias("len"))
    reach = F.coalesce(F.max(F.col("start") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = spans.select("_k1", "_k2", F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", reach)).alias("n"))
    n_hit = fresh.groupBy("_k1", "_k2").agg(F.sum("n").cast("long").alias("n_hit"))
    names = hits.join(wins.select("w", F.col("item_id").cast("string").alias("item_id")).distinct(), "w").select("_k1", "_k2", "item_id").distinct()
    names = names.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    found = n_hit.join(names, ["_k1", "_k2"], "left")
    out = cut.select("doc_id", "_k1", "_k2", "n_words").join(found, ["_k1", "_k2"], "left")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit."""
    keyed = with_row_key(packed(docs), "doc_id", "text")
    cut = cut_words(keyed)
    hits, _ = phrase_matches(keyed.select("_k1", "_k2", "text"), cut, items, size)
    hit = written(hits.select("_k1", "_k2").distinct())
    discard(cut)
    return unpacked(keyed.join(hit, ["_k1", "_k2"], "left_anti"), docs.columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
       FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS t(i) WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i AS start, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM d, ns, unnest(range(1, len(ws) - n + 2)) AS t(i)),
hit AS (SELECT DISTINCT r, start, dw.n, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(start, start + n)) AS t(p) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
