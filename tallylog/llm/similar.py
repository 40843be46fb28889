"""Near copies by the similarity of their shingle sets: SimHash links first, MinHash bands for what lies beyond, the sets themselves decide.

Two texts link if the Jaccard similarity of their sets of word shingles is at least 4/5, computed on the sets (64-bit hashes of the
shingles). Candidates are, first, what op5's operator links: fingerprints by blocks, within 4 bits (:func:`op5_simhash.set_links`).
At a similarity of 0.8 fingerprints of 64 bits differ in about 10 bits, with a spread of 3, so further candidates, between components of
the first, share one of ``BANDS`` keys of ``ROWS`` minima each; a pair of similarity s shares none with probability
(1 - s^ROWS)^BANDS, at most 7e-10 at 0.8.

Within a key all members are first compared with its smallest. Pairs that this leaves in different components are then
compared one by one under keys of up to ``HOT_KEY`` members. A larger family's pairs would grow with its square, most of them far from
similar; there only those pairs are compared that three exact bounds leave (:func:`_family_pairs`), and no similar pair is left out.

Defined results: a null or empty text has the empty set, which is similar to the empty set alone. A text of up to ``size`` words
is one shingle. Repeated rows and null ids keep their rows until one of each component is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import connected_components, packed, small_batches, union, unpacked, with_row_key, written, written_alone
from tallylog.llm.op5_simhash import _hashes, _of_hashes, set_links

#: Words of a shingle.
SIZE = 5
BANDS, ROWS = 40, 4
#: Members of a key up to which all its pairs are compared.
HOT_KEY = 32
#: Longs of a set's parity bits.
PARITY = 8
#: Buckets in which a family's shingles are counted (4 MB of counts), and parts of that table.
BUCKETS, PARTS = 1 << 20, 1 << 8
#: Shingles that are hashed at a time.
_CHUNK = 1 << 11
_rng = np.random.default_rng(5)
_MUL = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The different shingle hashes of a text, sorted, as uint64."""
    return np.unique(np.array(_hashes(text, size), dtype=np.uint64))


def band_keys(h: np.ndarray) -> list[int]:
    """One key (as a signed long) for each band; none of the empty set."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), _CHUNK):
        np.minimum(low, (h[None, at : at + _CHUNK] * _MUL + _ADD).min(axis=1), out=low)
    keys = [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with set_id (a hash of the shingle set), n (its size), the fingerprint and bands in place of text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("set_id long, n int, fingerprint long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                every = np.array(_hashes(t, size), dtype=np.uint64)
                h = np.unique(every)
                out.append((np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64), len(h), _of_hashes(every).astype(np.int64), band_keys(h)))
            yield pd.DataFrame(out, columns=["set_id", "n", "fingerprint", "bands"])

    return docs.withColumn("_x", of("text")).select(*[c for c in docs.columns if c != "text"], "_x.*")


def parity(h: np.ndarray) -> np.ndarray:
    """Bits that each tell whether an odd number of the set's hashes falls on them. Two sets that differ in d hashes differ in at most d bits."""
    on = np.bincount((h >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) % 2
    return np.packbits(on.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """set_id, the shingle set and its parity bits for each row of set_id and text."""

    @F.pandas_udf("s array<long>, p array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, size) for t in texts]
            yield pd.DataFrame({"s": pd.Series([h.view(np.int64) for h in sets], dtype=object), "p": pd.Series([parity(h) for h in sets], dtype=object)})

    return rows.select("set_id", of("text").alias("_x")).select("set_id", "_x.*")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a similarity of at least 4/5."""
    one, other = sets.select(F.col("set_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("set_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(other, "b").where(both * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")


def _fits(x: Column, y: Column) -> Column:
    return F.greatest(x, y) * 4 <= F.least(x, y) * 5


def _named(rows: DataFrame, near: DataFrame) -> DataFrame:
    """``rows`` of set_id with c, the component that the edges ``near`` give it."""
    cc = connected_components(near)
    return rows.join(cc, F.col("set_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "set_id")).drop("node", "component")


def _rarity(have: DataFrame) -> np.ndarray:
    """How many shingles of the sets ``s`` fall into each of ``BUCKETS`` buckets.

    Each task counts what it reads and passes on parts of its table, so what is moved is bounded by tasks and buckets.
    """
    buckets, parts = BUCKETS, PARTS
    width = buckets // parts

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(buckets, dtype=np.int64)
        for df in batches:
            if len(df):
                n += np.bincount(np.concatenate(df["s"].to_numpy()) & (buckets - 1), minlength=buckets)
        for part, here in enumerate(n.reshape(parts, width)):
            if len(at := np.flatnonzero(here)):
                yield pd.DataFrame({"part": [part], "at": [at], "n": [here[at]]})

    def add(df: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(np.concatenate(df["at"].to_numpy()), np.concatenate(df["n"].to_numpy()), width)
        return pd.DataFrame({"part": df["part"].head(1), "n": [n.astype(np.uint32).tobytes()]})

    counted = have.select("s").mapInPandas(of, "part int, at array<long>, n array<long>").groupBy("part").applyInPandas(add, "part int, n binary")
    out = np.zeros((parts, width), dtype=np.uint32)
    for row in counted.collect():
        out[row["part"]] = np.frombuffer(row["n"], dtype=np.uint32)
    return out.reshape(-1)


def _first_fifth(rarity: np.ndarray):
    """A column function: the first fifth of a set's shingles, and one more, in the order of ``rarity`` and then of their values.

    Buckets that shingles share by chance change the order, not what it is good for: any order that is one for all sets is exact.
    """

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in batches:
            yield pd.Series([h[np.lexsort((h, rarity[h & (len(rarity) - 1)]))[: len(h) // 5 + 1]] for h in sets], dtype=object)

    return of


def _family_pairs(members: DataFrame, sets: DataFrame, near: DataFrame) -> list[DataFrame]:
    """Edges that complete ``near`` among ``members`` (set_id and n), and the candidates (a, b) that are left to verify.

    The shingles of a set stand in one order for all, the rarest first. Similar sets x and y share 4/9 (|x| + |y|) shingles or more,
    so the first that they share has no more than |x| - 4/9 (|x| + |y|) others of x before it, and likewise in y: ``reach`` is
    the largest |y| that this leaves. The smaller set of a pair reaches at least its own size. So of a set's shingles a fifth and one become rows.
    Similar sets differ in at most (|x| + |y|) / 9 shingles, and so in as many parity bits. A family whose members have much of their own meets nowhere.

    Of each shingle the member that stands nearest to the others (the fewest before it) is compared with all first, which ties the dense middle of a
    family together, so that the pairs compared one by one afterwards are those between different components.
    """
    have = written(members.join(sets, "set_id"))
    met = have.select("set_id", "n", "p", _first_fifth(_rarity(have))("s").alias("toks")).select("set_id", "n", "p", F.posexplode("toks").alias("at", "tok"))
    # reach: 9/4 (n - before) - n, times 4 to stay whole.
    met = written(met.select("set_id", "n", "p", "tok", (F.col("n") * 5 - F.col("at") * 9).alias("reach4")))
    differ = sum(F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY))
    side = lambda df, x, *more: df.select("tok", F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"), F.col("reach4").alias(f"r{x}"), *[F.col(m).alias(f"{m}{x}") for m in more])
    might = (F.col("nb") * 4 <= F.col("ra")) & (F.col("na") * 4 <= F.col("rb")) & (differ * 9 <= F.col("na") + F.col("nb"))
    middle = met.groupBy("tok").agg(F.max_by(F.struct("set_id", "n", "p", "reach4"), F.struct(F.col("reach4") / F.col("n"), "set_id")).alias("m")).select("tok", "m.*")
    star = side(middle, "a").join(side(met, "b"), "tok").where((F.col("a") != F.col("b")) & might)
    star = written(star.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().toDF("a", "b"))
    star = written(_verified(star, sets))
    met = written(_named(met, near.unionByName(star)))
    open_ = met.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("tok")
    met = written(met.join(open_, "tok", "left_semi"))
    smaller = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    left = side(met.where("reach4 >= n * 4"), "a", "c").join(side(met, "b", "c"), "tok").where(smaller & (F.col("ca") != F.col("cb")) & might)
    return [star, written(left.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().toDF("a", "b"))]


def links(prints: DataFrame, docs: DataFrame, size: int = SIZE, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b) edges over set ids whose components are those of "similarity at least 4/5". ``docs`` and ``prints`` have row keys."""
    base = written_alone(lambda: set_links(prints))
    distinct = prints.groupBy("set_id").agg(F.min("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("_k1", "_k2")).alias("row"))
    distinct = written(distinct)
    keyed = distinct.select("set_id", "n", F.explode("bands").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    met = written(keyed.join(shared, "key"))
    some = union([met.select("set_id"), base.select(F.col("a").alias("set_id")), base.select(F.col("b").alias("set_id"))]).distinct()
    need = distinct.join(some, "set_id", "left_semi").select("set_id", "row._k1", "row._k2")
    sets = written(_sets(docs.select("_k1", "_k2", "text").join(need, ["_k1", "_k2"]).dropDuplicates(["set_id"]), size))
    base = written(_verified(base, sets))
    met = written(_named(met, base))
    low = written(met.groupBy("key").agg(F.min(F.struct("set_id", "n", "c")).alias("low")))
    apart = (F.col("c") != F.col("low.c")) & _fits(F.col("n"), F.col("low.n"))
    first = written(met.join(low, "key").where(apart).select(F.col("low.set_id").alias("a"), F.col("set_id").alias("b")).distinct())
    near = written(base.unionByName(_verified(first, sets)))
    named = _named(met.select("key", "set_id", "n", "members"), near)
    open_keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    named = written(named.join(open_keys, "key", "left_semi"))
    few = named.where(F.col("members") <= hot_key)
    x = few.select("key", F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    y = few.select("key", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    rest = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _fits(F.col("na"), F.col("nb"))).select("a", "b")
    star, left = _family_pairs(named.where(F.col("members") > hot_key).select("set_id", "n").distinct(), sets, near)
    rest = written(union([rest, left]).distinct().join(first, ["a", "b"], "left_anti"))
    return union([near, star, _verified(rest, sets)])


def one_of_similar(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` with one left of each component: that of the smallest doc_id, null ids last.

    Rows that repeat an id inside a component are told apart by a hash of their text.
    """
    rows = with_row_key(docs.select("doc_id", "text"), "doc_id", "text")
    prints = written(_signed(rows, size))
    cc = connected_components(links(prints, rows, size))
    named = prints.select("doc_id", "_k1", "_k2", "set_id").join(cc, F.col("node") == F.col("set_id"), "left").withColumn("c", F.coalesce("component", "set_id"))
    best = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("best")).select("best._k1", "best._k2")
    return unpacked(with_row_key(packed(docs), "doc_id", "text").join(best, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]), docs.columns)
