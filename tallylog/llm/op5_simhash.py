"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at most
``max_bits`` bits leave at least ``blocks - max_bits`` parts untouched, so they meet in one of the
tables keyed by that many parts together. Keys of several parts keep chance meetings rare, where single
parts would meet with the square of the input; the number of parts grows with that of the different fingerprints (``blocks_for``), so
that a key has fewer of them than one by chance at every size.

A key that many different fingerprints share (a large family of near copies) is not joined with
itself. Fingerprints within 4 bits of each other have a common midpoint within 2 bits of
both, and a common midpoint within 2 bits of both proves a distance of at most 4; so there each fingerprint is tied
to its midpoints, which is exact and grows in proportion to the family.

Defined results: a null text has no words and fingerprint zero, as has an empty one. Fingerprint zero links like any
other. Repeated rows and null ids keep their rows; ``component_id`` is the smallest doc_id that is not null
(null if there is none). Extra columns are ignored by :func:`components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import connected_components, packed, small_batches, union, unpacked, with_row_key, written

BITS = 64
#: Differing bits up to which two fingerprints link.
MAX_BITS = 4
#: Parts of a fingerprint, at least. 7 parts make 35 tables of keys with 27 or 28 bits.
BLOCKS = 7
#: Different fingerprints under one key from which midpoints take the place of pairs.
HOT_KEY = 256
#: Shingle hashes that are unpacked to bits at a time.
_UNPACK = 1 << 17


def _hashes(text: str | None, size: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=True)]


def _of_hashes(h: np.ndarray) -> np.uint64:
    """The fingerprint of a text's shingle hashes, as uint64."""
    if not len(h):
        return np.uint64(0)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), _UNPACK):
        part = h[at : at + _UNPACK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]


def simhash(texts: list[str | None], size: int = 4) -> np.ndarray:
    """The fingerprint of each text, as int64."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        out[i] = _of_hashes(np.array(_hashes(text, size), dtype=np.uint64))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, size: int = 4, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``fingerprint`` (long). Every row keeps its place."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(simhash(t.tolist(), size))

    return docs.withColumn("fingerprint", of(F.col(text)))


def _parts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each part."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The least number of parts whose keys tell ``n`` random fingerprints apart: 7 up to 67 million, 8 up to 2 billion."""
    blocks = BLOCKS
    while 2 ** (sum(sorted(width for _, width in _parts(blocks))[: blocks - max_bits]) - 1) < n and blocks < 3 * max_bits:
        blocks += 1
    return blocks


def _mask(parts: tuple[tuple[int, int], ...]) -> int:
    bits = sum(((1 << width) - 1) << shift for shift, width in parts)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def keys(f: Column, blocks: int, max_bits: int) -> Column:
    """One (table, masked fingerprint) for each choice of parts that might be untouched."""
    choices = [_mask(c) for c in combinations(_parts(blocks), blocks - max_bits)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), f.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(choices)]))


def _first_table(diff: Column, blocks: int, max_bits: int) -> Column:
    """The first table in which two fingerprints with this difference meet: pairs are taken there alone."""
    out = F.lit(-1)
    for i, c in reversed(list(enumerate(combinations(_parts(blocks), blocks - max_bits)))):
        out = F.when(diff.bitwiseAND(F.lit(_mask(c))) == 0, i).otherwise(out)
    return out


def _midpoints(f: Column, radius: int) -> Column:
    flips = [0]
    for r in range(1, radius + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(BITS), r)]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in flips]
    return F.explode(F.transform(F.array(*[F.lit(x) for x in signed]), lambda x: f.bitwiseXOR(x)))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b) edges over ``distinct`` fingerprints whose components are those of "at most max_bits apart".

    Under keys with up to ``hot_key`` fingerprints the edges are the close pairs themselves. In larger families they
    run by midpoints, so a family of m gives edges in proportion to m.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even: midpoints lie half way")
    keyed = distinct.select(F.col("fingerprint").alias("f"), keys(F.col("fingerprint"), blocks, max_bits).alias("k")).select("f", "k.t", "k.key")
    # Written, so that the join below reads two plain tables and a hot key can be split.
    shared = written(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = written(keyed.join(shared, ["t", "key"]))
    few = met.where(F.col("n") <= hot_key)
    a, b = few.select("t", "key", F.col("f").alias("a")), few.select("t", "key", F.col("f").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(diff) <= max_bits) & (_first_table(diff, blocks, max_bits) == a.t)
    pairs = a.join(b, (a.t == b.t) & (a.key == b.key) & close).select("a", "b")
    hot = met.where(F.col("n") > hot_key).select("f").distinct()
    ball = hot.select("f", _midpoints(F.col("f"), max_bits // 2).alias("m"))
    low = written(ball.groupBy("m").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("m", "a"))
    far = ball.join(low, "m").where("f <> a").select("a", F.col("f").alias("b")).distinct()
    return union([pairs, far])


def _labelled(docs: DataFrame, size: int, max_bits: int, blocks: int | None, hot_key: int) -> DataFrame:
    """doc_id, row key, fingerprint, component label ``c`` and component_id for each row."""
    prints = written(fingerprints(with_row_key(docs.select("doc_id", "text"), "doc_id", "text"), size).drop("text"))
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    cc = connected_components(links(distinct.select("fingerprint"), max_bits, blocks or blocks_for(distinct.count(), max_bits), hot_key))
    named = distinct.join(cc, F.col("node") == F.col("fingerprint"), "left").select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("c"))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "c").select(F.col("fingerprint").alias("f"), "c", "component_id")
    return prints.join(named, F.col("f") == F.col("fingerprint")).drop("f")


def components(docs: DataFrame, size: int = 4, max_bits: int = MAX_BITS, blocks: int | None = None, hot_key: int = HOT_KEY) -> DataFrame:
    """doc_id, fingerprint (long) and component_id for each row of ``docs``."""
    return _labelled(docs, size, max_bits, blocks, hot_key).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, size: int = 4, max_bits: int = MAX_BITS, blocks: int | None = None, hot_key: int = HOT_KEY) -> DataFrame:
    """The rows of ``docs`` with one left of each component: that of the smallest doc_id, null ids last.

    Rows that repeat an id inside a component are told apart by a hash of their text.
    """
    rows = _labelled(docs, size, max_bits, blocks, hot_key)
    best = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("best")).select("best._k1", "best._k2")
    return unpacked(with_row_key(packed(docs), "doc_id", "text").join(best, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]), docs.columns)


def set_links(prints: DataFrame, max_bits: int = MAX_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b) with a < b: sets (``set_id``) that the links between their fingerprints tie together.

    Sets with one fingerprint are tied to the smallest of them, which also stands for the fingerprint in its links to others.
    """
    marks = written(prints.select("set_id", "fingerprint").distinct())
    low = written(marks.groupBy("fingerprint").agg(F.min("set_id").alias("low")))
    blocks = blocks_for(low.count(), max_bits)
    close = links(low.select("fingerprint"), max_bits, blocks, hot_key)
    one, other = low.select(F.col("fingerprint").alias("a"), F.col("low").alias("x")), low.select(F.col("fingerprint").alias("b"), F.col("low").alias("y"))
    apart = close.join(one, "a").join(other, "b").select("x", "y")
    same = marks.join(low, "fingerprint").select(F.col("low").alias("x"), F.col("set_id").alias("y"))
    return union([apart, same]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def one_of_near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """The same for texts whose sets of ``size``-word shingles have a similarity of 0.8 or more.

    Fingerprints, blocks and links are those above; the sets decide on each link. At 0.8, fingerprints differ in about 10 of 64 bits,
    with a spread of 3, and no choice of parts is selective at 16 bits or more. So the links that lie beyond ``MAX_BITS``
    are added by the shingles' minima, between texts that the fingerprints leave in different components (:mod:`tallylog.llm.similar`).
    """
    from tallylog.llm.similar import one_of_similar

    return one_of_similar(docs, size)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
