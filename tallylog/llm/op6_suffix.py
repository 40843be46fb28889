"""Removal of long repeated byte strings by hash-compared suffix sorting.

A string of ``length`` bytes that starts in two places has the same smallest k-gram in both, at the same place in it. So each start is
filed under its window's smallest k-gram (its anchor), and equal strings meet in the group of one anchor, wherever they are.

1. Each text gives one row for each run of starts with one anchor: the anchor's hash and a 128-bit digest of the run's
   bytes. No text moves. Anchors that occur once are dropped.
2. Runs with the same digest are repeated as a whole: counted by partial aggregates, however many copies there are.
3. Only where one anchor has different runs are their bytes fetched, one of each, and their suffixes sorted: a bottom-up
   mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes.
   Neighbours that share ``length`` bytes are repeats; the bytes are compared, so a hash collision is noticed, and another base
   is taken. Groups are dealt by anchor. An anchor with more than ``hot_anchor`` different runs is not sorted in one
   task. Its runs are cut into short ones of ``STEP`` starts, which all share a core of ``length`` - STEP + 1 bytes; short runs are
   dealt and counted by the core's digest, and only where one core has different edges single windows are counted.

Beside the removal, which goes by bytes alone, the same steps over words (maximal runs without white space) find passages of
``passage`` words that also stand in another document, whatever their length in bytes and the white space in them. They are reported and not
removed. Where runs of words differ their windows are counted, hot anchor or not.

Defined results: texts are UTF-8 bytes; a null text is empty. Texts shorter than ``length`` lose nothing. Repeated rows are copies of each
other; null ids keep their rows. Strings are judged on the input, overlaps count, and matches never cross texts. For passages rows
that agree in doc_id and text are one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import discard, settle, small_batches, union, with_row_key, written

LENGTH = 400
#: Bytes of a k-gram (a power of two, at most ``length``).
GRAM = 32
#: Words of a passage, and of its anchors: "over 50 words".
PASSAGE, PASSAGE_GRAM = 51, 8
#: Different runs of one anchor from which windows are counted instead of sorted.
HOT_ANCHOR = 512
#: Starts of a short run, into which the runs of such an anchor are cut.
STEP = 16
#: Units that are taken in hand at a time; longer texts are cut into pieces that overlap by ``length`` - 1.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 23) - 1)
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Kinds of units, and the bytes that stand for one in a run: a byte itself, or a word's hash.
_BYTE, _WORD = 0, 1
_WIDTH = (1, 8)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _words(raw: bytes) -> np.ndarray:
    """The 64-bit hash of each word. Long texts go word by word, so that no list of all words is held."""
    found = raw.split() if len(raw) <= PIECE else (m.group() for m in re.finditer(rb"\S+", raw))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64)


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def runs(h: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, anchor, hash) of each maximal run of starts with one anchor.

    ``h`` holds a hash of each unit of texts side by side; ``first`` and ``last`` are the first and last start of each.
    """
    width = 1
    while width < gram:
        h = h[:-width] * _power(_BASES[0], width) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(_BASES[1])
    h ^= h >> np.uint64(32)
    # Hash above, place below: the minimum is the leftmost smallest k-gram, which is a matter of the window's bytes alone.
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    need, width = length - gram + 1, 1
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if need > width:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    anchor = (low & _PLACE).astype(np.int64)
    ok = np.zeros(len(anchor) + 1, dtype=np.int8)
    np.add.at(ok, first, 1)
    np.add.at(ok, last + 1, -1)
    ok = ok[:-1].cumsum() > 0
    fresh = np.empty(len(anchor), dtype=bool)
    fresh[0] = True
    fresh[1:] = anchor[1:] != anchor[:-1]
    fresh[first] = True
    lo = np.flatnonzero(fresh & ok)
    stop = np.append(np.flatnonzero(fresh), len(anchor))
    hi = stop[np.searchsorted(stop, lo, side="right")] - 1
    hi = np.minimum(hi, last[np.searchsorted(first, lo, side="right") - 1])
    at = anchor[lo]
    return lo, hi, at, h[at].view(np.int64)


def _pieces(texts: list[bytes] | list[np.ndarray], length: int) -> Iterator[list[tuple[int, int, bytes | np.ndarray]]]:
    """Batches of (row, offset, units) of about PIECE units."""
    batch, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if size and size + len(part) > PIECE + length:
                yield batch
                batch, size = [], 0
            batch.append((i, at, part))
            size += len(part)
    if batch:
        yield batch


_RUN = "_k1 long, _k2 long, unit byte, key long, c1 long, c2 long, lo int, w int, off int"


def anchored(docs: DataFrame, lengths: tuple[int, int], grams: tuple[int, int]) -> DataFrame:
    """The runs of every text, in bytes and in words. ``docs`` has the row key and text; units [lo, lo + w - 1 + length) are the run's."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = [_bytes(t) for t in b["text"]]
            keys = b["_k1"].to_numpy(np.int64), b["_k2"].to_numpy(np.int64)
            yield from found(_BYTE, raws, *keys)
            yield from found(_WORD, [_words(r) for r in raws], *keys)

    def found(unit: int, texts: list, k1: np.ndarray, k2: np.ndarray) -> Iterator[pd.DataFrame]:
        length, width, digest = lengths[unit], _WIDTH[unit], xxhash.xxh3_128_digest
        for batch in _pieces(texts, length):
            parts = [p for _, _, p in batch]
            joined = b"".join(parts) if unit == _BYTE else np.concatenate(parts).tobytes()
            h = _TABLE[np.frombuffer(joined, dtype=np.uint8)] if unit == _BYTE else np.frombuffer(joined, dtype=np.uint64)
            sizes = np.array([len(p) for p in parts])
            first = np.concatenate([[0], sizes.cumsum()[:-1]])
            lo, hi, at, key = runs(h, first, first + sizes - length, length, grams[unit])
            # Words are reported, not cut, and 64 bits beside the anchor's 64 do for them.
            both = np.frombuffer(b"".join(digest(joined[s * width : (e + length) * width], o) for s, e, o in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
            which = np.searchsorted(first, lo, side="right") - 1
            move = np.array([o for _, o, _ in batch])[which] - first[which]
            row = np.array([i for i, _, _ in batch])[which]
            yield pd.DataFrame({"_k1": k1[row], "_k2": k2[row], "unit": np.full(len(lo), unit, dtype=np.int8), "key": key ^ unit, "c1": both[:, 0], "c2": both[:, 1] if unit == _BYTE else np.zeros(len(lo), dtype=np.int64), "lo": (lo + move).astype(np.int32), "w": (hi - lo + 1).astype(np.int32), "off": (at - lo).astype(np.int32)})

    return docs.select("_k1", "_k2", "text").mapInPandas(of, _RUN)


class Suffixes:
    """Prefix polynomial hashes over bytes, and the comparison of suffixes by them."""

    def __init__(self, data: bytes, base: int) -> None:
        self.data = np.frombuffer(data, dtype=np.uint8)
        n = len(self.data)
        power = np.full(n + 1, base, dtype=np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[self.data] * self.power[:-1], dtype=np.uint64, out=self.prefix[1:])

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """The length of the common extension of the suffixes at a and b, up to ``most``: binary search over equal hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), most, dtype=np.int64)
        pa, pb = self.prefix[a], self.prefix[b]
        ra, rb = self.power[b], self.power[a]  # brings both hashes to the same power
        while True:
            todo = low < high
            if not todo.any():
                return low
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa) * ra == (self.prefix[b + mid] - pb) * rb
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)

    def less(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        n = self.common(a, b, most)
        inside = n < most
        return inside & (self.data[a + np.where(inside, n, 0)] < self.data[b + np.where(inside, n, 0)])


def sort_suffixes(s: Suffixes, starts: np.ndarray, classes: np.ndarray, most: int) -> np.ndarray:
    """The order of ``starts`` by the ``most`` bytes at each, inside each class (equal values lie together).

    Bottom-up mergesort of all classes at once: each element finds its rank in its sibling run by binary search, and moves
    to its rank in both.
    """
    order = np.arange(len(starts))
    if not len(starts):
        return order
    edge = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    size = np.diff(np.append(edge, len(starts)))
    begin, end = np.repeat(edge, size), np.repeat(edge + size, size)
    inside = np.arange(len(starts)) - begin
    width, largest = 1, int(size.max())
    while width < largest:
        block = begin + inside // (2 * width) * (2 * width)
        right = (inside // width) % 2 == 1
        low = np.where(right, block, np.minimum(block + width, end))
        high = np.where(right, block + width, np.minimum(block + 2 * width, end))
        other = low.copy()
        mine = starts[order]
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) >> 1
            theirs = mine[mid]
            # From the left run equal ones come first, so the sort is stable.
            before = np.where(right[live], ~s.less(mine[live], theirs, most), s.less(theirs, mine[live], most))
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
        own = inside % width
        moved = np.empty_like(order)
        moved[block + own + (low - other)] = order
        order = moved
        width *= 2
    return order


def repeated(data: bytes, starts: np.ndarray, classes: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each start also stands at another start of its class."""
    for base in _BASES:
        s = Suffixes(data, base)
        order = sort_suffixes(s, starts, classes, length)
        a, b = order[:-1], order[1:]
        same = (classes[a] == classes[b]) & (s.common(starts[a], starts[b], length) >= length)
        if _verified(data, starts[a[same]], starts[b[same]], length):
            out = np.zeros(len(starts), dtype=bool)
            out[a[same]] = out[b[same]] = True
            return out
    raise ArithmeticError("every base met a hash collision")


def _verified(data: bytes, a: np.ndarray, b: np.ndarray, length: int) -> bool:
    """Compare the bytes behind equal hashes; pairs that run in step are compared once."""
    by = np.lexsort((a, b - a))
    a, b = a[by], b[by]
    if not len(a):
        return True
    cut = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.append(cut, len(a)) - 1
    return all(data[s : e + length] == data[t : t + e - s + length] for s, e, t in zip(a[lo].tolist(), a[hi].tolist(), b[lo].tolist(), strict=True))


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [s, s + length) over sorted ``starts``, as starts and ends."""
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.concatenate([[0], cut])], starts[np.append(cut, len(starts)) - 1] + length


def merged(spans: np.ndarray) -> list[list[int]]:
    """The union of spans [s, e), rows of an array in any order, as maximal spans."""
    if not len(spans):
        return []
    s, e = spans[np.argsort(spans[:, 0], kind="stable")].T
    reach = np.maximum.accumulate(e)
    cut = np.flatnonzero(s[1:] > reach[:-1]) + 1
    return np.stack([s[np.concatenate([[0], cut])], reach[np.append(cut, len(s)) - 1]], axis=1).tolist()


_FETCHED = "_k1 long, _k2 long, unit byte, key long, n long, lo long, w long, off long, part binary"


def _fetch(docs: DataFrame, wanted: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """The units of the run of each row of ``wanted``."""
    one = F.array(*[F.col(c).cast("long") for c in ("unit", "key", "n", "lo", "w", "off")])
    lists = wanted.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list(one)).alias("runs"))
    rows = docs.select("_k1", "_k2", "text").join(lists, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [np.asarray(r, dtype=np.int64).reshape(-1, 6) for r in b["runs"]]
            raws = [_bytes(t) for t in b["text"]]
            words = [_words(raw) if x[:, 0].any() else None for raw, x in zip(raws, each, strict=True)]
            which = np.repeat(np.arange(len(each)), list(map(len, each)))
            k1, k2 = b["_k1"].to_numpy()[which], b["_k2"].to_numpy()[which]
            all_ = np.concatenate(each) if each else np.zeros((0, 6), dtype=np.int64)
            for at in range(0, len(all_), 4096):
                to = at + 4096
                x = all_[at:to]
                part = [raws[i][lo : lo + w - 1 + lengths[_BYTE]] if unit == _BYTE else words[i][lo : lo + w - 1 + lengths[_WORD]].tobytes() for i, (unit, lo, w) in zip(which[at:to].tolist(), x[:, [0, 3, 4]].tolist(), strict=True)]
                yield pd.DataFrame({"_k1": k1[at:to], "_k2": k2[at:to], "unit": x[:, 0].astype(np.int8), "key": x[:, 1], "n": x[:, 2], "lo": x[:, 3], "w": x[:, 4], "off": x[:, 5], "part": part})

    return rows.mapInPandas(cut, _FETCHED)


_SPAN = "_k1 long, _k2 long, s long, e long"


def _sorted_spans(fetched: DataFrame, length: int) -> DataFrame:
    """The repeated spans among runs that share an anchor, found by suffix sorting. Groups stay whole in a task."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += int(b["part"].map(len).sum())
            if size < PIECE:
                continue
            rows = pd.concat(held)
            last = rows["key"] == rows["key"].iloc[-1]
            if not last.all():
                yield from solve(rows[~last])
                rows = rows[last]
            held, size = [rows], int(rows["part"].map(len).sum())
        if held:
            yield from solve(pd.concat(held))

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        parts = rows["part"].tolist()
        data = b"".join(parts)
        place = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        lo, count, off = (rows[c].to_numpy(np.int64) for c in ("lo", "w", "off"))
        which = np.repeat(np.arange(len(rows)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        starts = place[which] + step
        # Equal strings have their anchor at the same place, so only starts as far from one anchor are compared.
        group = np.unique(rows["key"].to_numpy(np.int64), return_inverse=True)[1]
        ahead = off[which] - step
        classes = group[which].astype(np.int64) * (length + 1) + ahead
        # Starts that stand alone in their class by the hash of all but the last bytes need no sorting.
        s = Suffixes(data, _BASES[0])
        near = max(1, length - STEP)
        head = (s.prefix[starts + near] - s.prefix[starts]) * s.power[len(data) - starts]
        classes = (head * np.uint64(_BASES[1])).view(np.int64) ^ classes
        by = np.argsort(classes, kind="stable")
        found = np.zeros(len(which), dtype=bool)
        edge = np.concatenate([[True], np.diff(classes[by]) != 0])
        alone = edge & np.append(edge[1:], True)
        kept = by[~alone]
        k1, k2, n = rows["_k1"].to_numpy(), rows["_k2"].to_numpy(), rows["n"].to_numpy()
        found[kept] = repeated(data, starts[kept], classes[kept], length)
        out = {"_k1": [], "_k2": [], "s": [], "e": []}
        ends = np.cumsum(count)
        for i in np.flatnonzero((n == 1) & (np.add.reduceat(found, ends - count) > 0)):
            own = lo[i] + np.flatnonzero(found[ends[i] - count[i] : ends[i]])
            s, e = _spans(own, length)
            out["_k1"] += [k1[i]] * len(s)
            out["_k2"] += [k2[i]] * len(s)
            out["s"] += s.tolist()
            out["e"] += e.tolist()
        if out["s"]:
            yield pd.DataFrame(out)

    return fetched.repartition("key").sortWithinPartitions("key").mapInPandas(of, _SPAN)


def _windows(fetched: DataFrame, length: int, width: int) -> DataFrame:
    """The digest of every window of ``length`` units in the runs of ``fetched``, with its start."""
    digest = xxhash.xxh3_128_digest

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = b["part"].tolist()
            count = np.array([len(p) // width - length + 1 for p in parts], dtype=np.int64)
            w = np.frombuffer(b"".join(digest(p[i * width : (i + length) * width]) for p, c in zip(parts, count.tolist(), strict=True) for i in range(c)), dtype=np.int64).reshape(-1, 2)
            step = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
            yield pd.DataFrame({"w1": w[:, 0], "w2": w[:, 1]} | {c: np.repeat(b[c].to_numpy(), count) for c in ("_k1", "_k2", "n")} | {"s": np.repeat(b["lo"].to_numpy(), count) + step})

    return fetched.select("_k1", "_k2", "n", "lo", "part").mapInPandas(of, "w1 long, w2 long, _k1 long, _k2 long, n long, s long")


def _counted_spans(fetched: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different runs, counted over all tasks."""
    digest = xxhash.xxh3_128_digest

    def short_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, hashes = [], []
            for k1, k2, n, lo, w, off, part in zip(b["_k1"], b["_k2"], b["n"], b["lo"], b["w"], b["off"], b["part"], strict=True):
                # Starts by their distance from the anchor: those of one step share all but their edges.
                for j in range((off - w + 1) // STEP, off // STEP + 1):
                    s, e = max(0, off - j * STEP - STEP + 1), min(w - 1, off - j * STEP)
                    core = off - j * STEP
                    own = part[s : e + length]
                    hashes += [digest(part[core : core + length - STEP + 1], j), digest(own, core - s)]
                    rows.append((k1, k2, n, lo + s, e - s + 1, own))
            if rows:
                c = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 4)
                yield pd.DataFrame(rows, columns=["_k1", "_k2", "n", "lo", "w", "part"]).assign(c1=c[:, 0], c2=c[:, 1], d1=c[:, 2], d2=c[:, 3])

    short = written(fetched.select("_k1", "_k2", "n", "lo", "w", "off", "part").mapInPandas(short_runs, "_k1 long, _k2 long, n long, lo long, w long, part binary, c1 long, c2 long, d1 long, d2 long"))
    kinds = written(short.groupBy("c1", "c2", "d1", "d2").agg(F.sum("n").alias("m")))
    whole = short.where("n = 1").drop("part").join(kinds.where("m > 1"), ["c1", "c2", "d1", "d2"]).select("_k1", "_k2", F.col("lo").alias("s"), (F.col("lo") + F.col("w") + (length - 1)).alias("e"))
    mixed = written(kinds.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("c1", "c2"))
    w = written(_windows(short.join(mixed, ["c1", "c2"]), length, 1))
    many = written(w.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("w1", "w2"))
    return whole.unionByName(w.where("n = 1").join(many, ["w1", "w2"]).select("_k1", "_k2", "s", (F.col("s") + length).alias("e")))


def _counted_passages(fetched: DataFrame, length: int) -> DataFrame:
    """The windows of words that stand in more than one document; ``n`` is 2 where the whole run does already."""
    w = written(_windows(fetched, length, _WIDTH[_WORD]))
    many = written(w.groupBy("w1", "w2").agg(F.max("n").alias("n"), _several().alias("several")).where("several OR n > 1").select("w1", "w2"))
    settle(w.sparkSession)
    out = written(w.where("n = 1").join(many, ["w1", "w2"]).select("_k1", "_k2", "s", (F.col("s") + length).alias("e")))
    discard(w, many)
    return out


def _several() -> Column:
    """Whether rows of more than one row key meet."""
    return (F.min("_k1") != F.max("_k1")) | (F.min("_k2") != F.max("_k2"))


def repeated_spans(keyed: DataFrame, lengths: tuple[int, int] = (LENGTH, PASSAGE), grams: tuple[int, int] = (GRAM, PASSAGE_GRAM), hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(_k1, _k2, spans): for each row with any what repeated strings cover, in bytes and in words: unit, s, e, one after another. They may overlap."""
    byte, word = F.col("unit") == _BYTE, F.col("unit") == _WORD
    every = written(anchored(keyed, lengths, grams))
    # Aggregates are written before they are joined, so that joins read two plain tables and a hot anchor can be split.
    often = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("unit").alias("unit"), _several().alias("several")).where((byte & (F.col("m") > 1)) | F.col("several")).select("key"))
    shared = written(every.join(often, "key"))
    discard(every, often)
    kinds = shared.groupBy("unit", "key", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), _several().alias("several"), F.min(F.struct("_k1", "_k2", "lo", "w", "off")).alias("one"))
    kinds = written(kinds.withColumn("copied", F.when(byte, F.col("n") > 1).otherwise(F.col("several"))))
    copied = kinds.where("copied").select("key", "c1", "c2")
    end = F.col("lo").cast("long") + F.col("w") - 1 + F.when(byte, lengths[_BYTE]).otherwise(lengths[_WORD])
    whole = shared.join(copied, ["key", "c1", "c2"]).select("_k1", "_k2", "unit", F.col("lo").cast("long").alias("s"), end.alias("e"))
    mixed = written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    met = kinds.join(mixed.select("key"), "key")
    # One run of each kind stands for it. Only a kind of passage that one document repeats is fetched wherever it stands.
    inner = word & ~F.col("copied") & (F.col("n") > 1)
    wanted = met.where(~inner).select("unit", "key", F.when(byte, F.col("n")).when(F.col("copied"), 2).otherwise(1).alias("n"), "one.*")
    again = shared.join(met.where(inner).select("key", "c1", "c2"), ["key", "c1", "c2"]).select("unit", "key", F.lit(1).cast("long").alias("n"), "_k1", "_k2", "lo", "w", "off")
    fetched = written(_fetch(keyed, wanted.unionByName(again), lengths).join(mixed.where(F.col("kinds") > hot_anchor).withColumnRenamed("kinds", "hot"), "key", "left"))
    discard(mixed)
    hot, rest = fetched.where("hot IS NOT NULL").drop("hot"), fetched.where("hot IS NULL").drop("hot")
    named = lambda df, unit: df.select("_k1", "_k2", F.lit(unit).cast("byte").alias("unit"), "s", "e")
    found = [
        named(_sorted_spans(rest.where(byte), lengths[_BYTE]), _BYTE),
        named(_counted_spans(hot.where(byte), lengths[_BYTE]), _BYTE),
        named(_counted_passages(fetched.where(word), lengths[_WORD]), _WORD),
    ]
    # By row, and written, so that what leads here can go before the texts are joined to it.
    one = F.array(F.col("unit").cast("long"), F.col("s"), F.col("e"))
    spans = written(union([whole, *found]).groupBy("_k1", "_k2").agg(F.flatten(F.collect_set(one)).alias("spans")))
    discard(shared, kinds, fetched)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_anchor: int = HOT_ANCHOR, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, kept (binary), removed (array of [s, e) byte spans, maximal), n_bytes and passages (array of [s, e) spans of words) for each row of ``docs``."""
    small_batches(docs.sparkSession)
    keyed = with_row_key(docs.select("doc_id", "text"), "doc_id", "text")
    spans = repeated_spans(keyed, (length, passage), (gram, passage_gram), hot_anchor)
    rows = keyed.join(spans, ["_k1", "_k2"], "left").select("doc_id", "text", "spans")

    @F.pandas_udf("kept binary, removed array<struct<s: long, e: long>>, n_bytes long, passages array<struct<s: long, e: long>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out: dict[str, list] = {"kept": [], "removed": [], "n_bytes": [], "passages": []}
            for text, own in zip(texts, lists, strict=True):
                raw = _bytes(text)
                each = np.asarray(own if own is not None else [], dtype=np.int64).reshape(-1, 3)
                gone, words = (merged(each[each[:, 0] == u, 1:]) for u in (_BYTE, _WORD))
                edges = [0, *[x for span in gone for x in span], len(raw)]
                out["kept"].append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                out["removed"].append([{"s": s, "e": e} for s, e in gone])
                out["n_bytes"].append(len(raw))
                out["passages"].append([{"s": s, "e": e} for s, e in words])
            yield pd.DataFrame(out)

    return rows.select("doc_id", cut("text", "spans").alias("x")).select("doc_id", "x.*")


def op6_suffix(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: the words inside passages of over 50 words that also stand in another document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, r: n + r.e - r.s)
    return out.select("doc_id", "n_bytes", total("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("passages").alias("n_passage_words"))
