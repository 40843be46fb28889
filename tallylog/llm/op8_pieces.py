"""SentencePiece encoding and decoding on a relational lattice.

A text becomes units between which no piece can reach (before white space marks, and between letters and other signs; the
vocabulary itself is asked whether that holds). For each different unit its substrings of bounded length are exploded and equi-joined to
the piece table; the matches are the lattice's edges, grouped by unit and folded by a Spark higher-order aggregate.

Two folds: ``viterbi`` takes the path with the best sum of scores (unigram vocabularies). Vocabularies of the BPE
kind do not ask for the best sum but for merges in the order of the scores, which a Viterbi fold gets wrong; for them
``merge`` folds the same edges from best to worst over the set of boundaries that are left (a bit mask): an edge is taken
if its ends are boundaries and just one lies inside. That gives the library's own ids.

Units that are frequent in the corpus (as many as ``dictionary``, a fixed bound; all documents are counted) are encoded once by
the relational lattice and broadcast. The rest, mostly words of one document, go through the same lattice and fold where the
document is read (:func:`fold_unit`), in batches: sending them or the texts through exchanges takes more disk than the texts have.

Defined results: null and empty texts have no pieces. A mark that stands in a text (U+2581) is read as a space, as the library
does. Characters without a piece become byte pieces. Units of over 62 characters, which a mask of 64 bits does not hold, and units
with a run of marks where the vocabulary has pieces of one score, are merged by the same rule over a heap in Python. Repeated rows and null ids keep their rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.common import small_batches, written

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units that are encoded once and broadcast, at most.
DICTIONARY = 400_000
#: Other units that a worker remembers at a time.
REMEMBERED = 100_000
#: Characters of a unit that the fold's bit mask holds.
LONGEST = 62
_LETTERS = MARK + r"*(?:\p{L}+|[^" + MARK + r"\p{L}]+)|" + MARK + "+"
_SPACES = MARK + "*[^" + MARK + "]+|" + MARK + "+"


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    matched: tuple[bool, ...]  # found in text: neither control, unknown nor byte pieces
    bytes_at: int  # the id of byte piece 0; the other 255 follow

    @property
    def unit(self) -> str:
        """The pattern of units between which no piece reaches."""
        inner = [p for p, m in zip(self.pieces, self.matched, strict=True) if m]
        if any(MARK in p.lstrip(MARK) for p in inner):
            return r"(?s).+"
        crosses = any(a.isalpha() != b.isalpha() and a != MARK for p in inner for a, b in zip(p, p[1:], strict=False))
        return _SPACES if crosses else _LETTERS

    @property
    def tied(self) -> bool:
        """Whether different pieces share a score, which runs of the mark do in some vocabularies."""
        scores = [x for x, m in zip(self.scores, self.matched, strict=True) if m]
        return len(set(scores)) < len(scores)

    def folded(self, unit: Column) -> Column:
        """Whether the lattice takes a unit. The order of merges among tied pieces follows from the merges before, which a fold over sorted edges does not see."""
        short = F.char_length(unit) <= LONGEST
        return short & ~F.contains(unit, F.lit(MARK * 2)) if self.tied else short

    @property
    def merges(self) -> bool:
        """Whether scores are ranks of merges: whole numbers, as BPE vocabularies have, not logarithms of probabilities."""
        return all(x == int(x) for x, m in zip(self.scores, self.matched, strict=True) if m)

    @property
    def longest(self) -> int:
        return max(len(p) for p, m in zip(self.pieces, self.matched, strict=True) if m)


def vocabulary(model: str = MODEL) -> Vocabulary:
    """Read on the driver; the size of the vocabulary bounds all that is broadcast of it."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = range(len(p))
    matched = tuple(not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in n)
    first = [i for i in n if p.is_byte(i)][:1]
    return Vocabulary(tuple(p.id_to_piece(i) for i in n), tuple(p.get_score(i) for i in n), matched, first[0] if first else p.unk_id())


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    rows = pd.DataFrame({"piece": v.pieces, "id": np.arange(len(v.pieces), dtype=np.int32), "score": v.scores})[list(v.matched)]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def units(text: Column, v: Vocabulary) -> Column:
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.char_length(text) > 0, F.regexp_extract_all(marked, F.lit(v.unit), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _bit(mask: Column, at: Column) -> Column:
    return F.call_function("shiftright", mask, at).bitwiseAND(F.lit(1).cast("long")) == 1


def _inside(mask: Column, e: Column) -> Column:
    one = F.lit(1).cast("long")
    return mask.bitwiseAND(F.call_function("shiftleft", one, e.end) - F.call_function("shiftleft", one, e.start + 1))


def _merged(edges: Column, unit: Column) -> Column:
    """The boundaries that are left, as a mask, after merges from the best score to the worst, leftmost first."""
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.char_length(unit) + 1) - 1

    def take(mask: Column, e: Column) -> Column:
        inner = _inside(mask, e)
        fits = (F.bit_count(inner) == 1) & _bit(mask, e.start) & _bit(mask, e.end)
        return F.when(fits, mask - inner).otherwise(mask)

    return F.aggregate(edges, whole, take)


def _viterbi(edges: Column, unit: Column) -> Column:
    """The mask of the boundaries on the path with the best sum of scores. Characters without a piece cost much."""
    n = F.char_length(unit)
    best = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i.cast("double") * -1e6).alias("score"), (F.call_function("shiftleft", F.lit(1).cast("long"), i + 1) - 1).alias("mask")))
    by_end = F.array_sort(F.transform(edges, lambda e: F.struct(e.end.alias("end"), e.start.alias("start"), e.rank.alias("rank"))))

    def take(state: Column, e: Column) -> Column:
        # An edge lengthens the best path to its start; a lone character may follow any place, at its cost.
        before = F.element_at(state, e.start + 1)
        score = before.score - e.rank
        mask = before.mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e.end))
        better = F.transform(state, lambda x, i: F.when((i == e.end) & (score > x.score), F.struct(score.alias("score"), mask.alias("mask"))).otherwise(x))
        return F.transform(better, lambda x, i: F.when((i == e.end + 1) & (F.element_at(better, e.end + 1).score - 1e6 > x.score), F.struct((F.element_at(better, e.end + 1).score - 1e6).alias("score"), F.element_at(better, e.end + 1).mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e.end + 1)).alias("mask"))).otherwise(x))

    return F.element_at(F.aggregate(by_end, best, take), n + 1).mask


def lattice(words: DataFrame, keys: list[str], v: Vocabulary, fold: str = "merge") -> DataFrame:
    """``keys``, unit and ids (array<int>) for each row of ``words`` (keys and unit) that has any piece in it."""
    pieces = F.broadcast(piece_table(words.sparkSession, v))
    n = F.char_length("unit")
    starts = words.where(v.folded(F.col("unit"))).select(*keys, "unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select(*keys, "unit", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + v.longest, n))).alias("end"))
    cut = spans.select(*keys, "unit", "start", "end", F.substring("unit", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    edges = cut.join(pieces, "piece").groupBy(*keys, "unit").agg(F.collect_list(F.struct((-F.col("score")).alias("rank"), "start", "end", "id")).alias("edges"))
    edges = edges.withColumn("edges", F.array_sort("edges"))
    mask = (_viterbi if fold == "viterbi" else _merged)(F.col("edges"), F.col("unit"))
    edges = edges.withColumn("mask", mask)
    m = F.col("mask")
    path = F.filter("edges", lambda e: _bit(m, e.start) & _bit(m, e.end) & (_inside(m, e) == 0))
    path = F.transform(path, lambda e: F.struct(e.start.alias("start"), e.end.alias("end"), F.array(e.id).alias("ids")))
    edges = edges.withColumn("path", path)
    # Characters that no piece covers become the pieces of their bytes.
    covered = F.aggregate("path", F.lit(0), lambda a, p: a + p.end - p.start)
    bare = F.filter(F.sequence(F.lit(0), F.char_length("unit") - 1), lambda i: ~F.exists("path", lambda p: (p.start <= i) & (i < p.end)))
    code = lambda i: F.hex(F.encode(F.substring(F.col("unit"), i + 1, F.lit(1)), "UTF-8"))
    of_bytes = lambda i: F.transform(F.sequence(F.lit(0), (F.length(code(i)) / 2).cast("int") - 1), lambda j: F.conv(F.substring(code(i), j * 2 + 1, F.lit(2)), 16, 10).cast("int") + v.bytes_at)
    lone = F.transform(bare, lambda i: F.struct(i.alias("start"), (i + 1).alias("end"), of_bytes(i).alias("ids")))
    path = F.array_sort(F.when(covered == F.char_length("unit"), F.col("path")).otherwise(F.concat("path", lone)))
    return edges.select(*keys, "unit", F.flatten(F.transform(path, lambda p: p.ids)).alias("ids"))


def fold_unit(unit: str, ids: dict[str, int], scores: tuple[float, ...], bytes_at: int, longest: int) -> list[int]:
    """One unit through the lattice: its bounded substrings, those that are pieces as edges, and the merge fold over them."""
    n = len(unit)
    edges = []
    for i in range(n):
        for j in range(i + 1, min(i + longest, n) + 1):
            p = ids.get(unit[i:j])
            if p is not None:
                edges.append((-scores[p], i, j, p))
    edges.sort()
    mask = (1 << n + 1) - 1
    for _, i, j, _ in edges:
        inner = mask & ((1 << j) - (1 << i + 1))
        if inner and not inner & (inner - 1) and mask >> i & 1 and mask >> j & 1:
            mask ^= inner
    at = {i: (j, p) for _, i, j, p in edges if mask >> i & 1 and mask >> j & 1 and not mask & ((1 << j) - (1 << i + 1))}
    out: list[int] = []
    i = 0
    while i < n:
        if i in at:
            i, p = at[i]
            out.append(p)
        else:
            out += [bytes_at + c for c in unit[i].encode("utf-8", "replace")]
            i += 1
    return out


def merge_long(unit: str, ids: dict[str, int], scores: tuple[float, ...], bytes_at: int) -> list[int]:
    """The same merges over a heap, for units of any length."""
    parts: list[str | None] = list(unit)
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (i := ids.get(parts[a] + parts[b])) is not None:
            heapq.heappush(heap, (-scores[i], a, b, parts[a] + parts[b]))

    for a in range(len(parts) - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, both = heapq.heappop(heap)
        if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
            continue
        parts[a], parts[b] = both, None
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        offer(left[a], a)
        offer(a, right[a])
    out: list[int] = []
    for p in parts:
        if p is not None:
            out += [ids[p]] if p in ids else [bytes_at + c for c in p.encode("utf-8", "replace")]
    return out


def decoder(v: Vocabulary):
    """A function from ids to the text. White space marks become spaces, the one put before the text goes, bytes are joined."""
    table = [p.replace(MARK, " ").encode() if m else b"" for p, m in zip(v.pieces, v.matched, strict=True)]
    for i in range(256):
        if v.pieces[v.bytes_at + i : v.bytes_at + i + 1] == (f"<0x{i:02X}>",):
            table[v.bytes_at + i] = bytes([i])

    def decode(ids: list[int]) -> str:
        return b"".join(map(table.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")

    return decode


def decoded(rows: DataFrame, v: Vocabulary, ids: str = "ids") -> DataFrame:
    """``rows`` with ``text``, decoded from their ids."""
    small_batches(rows.sparkSession)
    decode = decoder(v)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([decode([] if x is None else list(x)) for x in b], dtype=object)

    return rows.withColumn("text", of(ids))


def frequent(docs: DataFrame, v: Vocabulary, most: int) -> DataFrame:
    """(unit): the most frequent units of the whole of ``docs``, at most ``most`` of them."""
    u = docs.select(F.explode(units(F.col("text"), v)).alias("unit"))
    counts = u.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & v.folded(F.col("unit")))
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    # At most 8 * 63 steps: the lowest from which all units still fit.
    held, least = 0, 1 << 30
    for step, n in sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        held += n
        if held > most:
            break
        least = step
    return counts.where(F.col("step") >= least).select("unit")


def encode(docs: DataFrame, v: Vocabulary | None = None, dictionary: int = DICTIONARY, digest: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) for each row of ``docs``; with ``digest`` n_ids, ids_sha256 and round_trip in place of ids.

    ids_sha256 is that of the ids as 32-bit little-endian integers; round_trip says whether they decode to the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    v = v or vocabulary()
    if not v.merges:
        raise ValueError("the vocabulary is no BPE one: encode() folds by merges; lattice(..., fold='viterbi') serves unigram vocabularies")
    top = written(frequent(docs, v, dictionary))
    known = lattice(top, [], v).toArrow()
    at, flat = known["ids"].combine_chunks().offsets.to_numpy(), known["ids"].combine_chunks().flatten().to_numpy().astype("<i4").tobytes()
    book = spark.sparkContext.broadcast({u: flat[4 * a : 4 * b] for u, a, b in zip(known["unit"].to_pylist(), at, at[1:], strict=False)})
    longest, tied = v.longest, v.tied

    @F.pandas_udf("n_ids long, ids_sha256 string, round_trip boolean" if digest else "ids array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find, common = regex.compile(v.unit).findall, book.value
        ids_of = {p: i for i, (p, m) in enumerate(zip(v.pieces, v.matched, strict=True)) if m}
        decode = decoder(v)
        rare: dict[str, bytes] = {}
        for texts in batches:
            out = []
            for text in texts:
                parts = []
                for u in find(MARK + text.replace(" ", MARK)) if text else ():
                    got = common.get(u) or rare.get(u)
                    if got is None:
                        whole = len(u) > LONGEST or (tied and MARK * 2 in u)
                        found = merge_long(u, ids_of, v.scores, v.bytes_at) if whole else fold_unit(u, ids_of, v.scores, v.bytes_at, longest)
                        if len(rare) >= REMEMBERED:
                            rare.clear()
                        got = rare[u] = np.array(found, dtype="<i4").tobytes()
                    parts.append(got)
                packed = b"".join(parts)
                ids = np.frombuffer(packed, dtype="<i4")
                out.append((len(ids), hashlib.sha256(packed).hexdigest(), decode(ids.tolist()) == (text or "")) if digest else ids)
            yield pd.DataFrame(out, columns=["n_ids", "ids_sha256", "round_trip"]) if digest else pd.DataFrame({"ids": out})

    return docs.select("doc_id", of("text").alias("x")).select("doc_id", "x.*")


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
