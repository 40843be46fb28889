"""Exact top-k inner-product search as a Voronoi kNN join.

Vectors become integers, floor(scale * x). Pivots are vectors of the table (smallest hash of the id), as many as an eighth of the
root of its rows, but at least ``pivots`` and at most ``MOST_PIVOTS``; every vector, data or query, belongs to the cell of its nearest pivot.
From each cell comes a summary: its row count and its largest distance from the pivot. For a query q and a cell with pivot p
and radius r every inner product lies within q.p -+ |q| r. The cells' lower bounds, with their counts, give a value
that the k-th best score of q cannot be under; q goes only to cells whose upper bound reaches it. A cell is cut into chunks of a
bounded number of rows, so a vector that makes up a third of the table fills many chunks and no task. The queries are laid out by
cell, cells that lie near each other side by side, and cut into blocks of a bounded number, so that the queries of a block need the same
cells. A chunk is copied to those blocks alone that hold a query for its cell. Each such pair is solved by one matrix product, and the
top k of all pairs are merged.

Only the most frequent vector lengths (``LENGTHS``) have pivots, which bounds what the driver holds. Vectors of any other length
make one cell, whose chunks meet all queries of that length.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, as queries or as
candidates. An empty vector has score 0 with other empty ones. Vectors meet only vectors of their own length. A query is an id: rows that
repeat a vec_id are candidates of their own, but as a query the id answers once, by its smallest vector, and no row of the id is
its candidate, as its rank could not be told apart. Null ids are candidates, come last among ties, and are never queries. Scores beyond
64 bits are clipped. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallylog.llm.common import written

SCALE, TOP, EVERY = 1024, 10, 100
PIVOTS, MOST_PIVOTS = 64, 1024
#: Rows of one chunk of candidates, and of one block of queries.
CHUNK, BLOCK = 4096, 4096
#: Vector lengths that get pivots.
LENGTHS = 8
_EXACT = float(1 << 53)
_NO_ID = np.iinfo(np.int64).max


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, v, dim): vec_id and floor(scale * x) as array<double> of whole numbers, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    # A number stands for a null id, as pandas would turn a column with nulls to floats.
    out = vectors.where(sound).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(_NO_ID))).alias("id"), F.transform(v, lambda x: x * float(scale)).alias("x"))
    return out.select("id", F.transform("x", lambda x: F.when(F.abs(x) < 9.0e15, F.floor(x).cast("double")).otherwise(x)).alias("v")).withColumn("dim", F.size("v"))


def _matrix(vs: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vs]) if len(vs) else np.zeros((0, 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products. Floats hold them while every partial sum stays below 2**53; else Python's integers do."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(c, low), high) for c in r] for r in big(q).dot(big(x).T)], dtype=np.int64)


def _ranks(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the places of its k highest scores, ties to the smaller id."""
    out = []
    for s in scores:
        if len(s) > 4 * k:
            # All that reach the k-th score, so that ties are settled by id alone.
            at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        else:
            at = np.arange(len(s))
        out.append(at[np.lexsort((ids[at], -s[at]))[:k]])
    return out


def _laid_out(queries: dict[int, int], pivots: np.ndarray, block: int) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks) for the number of ``queries`` in each cell: cells in the order of their pivots along the
    direction in which these spread most, small ones together in a block, large ones in several of their own.
    """
    middle = pivots - pivots.mean(axis=0)
    along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
    out, at, full = [], 0, 0
    for cell in sorted(queries, key=lambda c: along[c]):
        n = queries[cell]
        if full and full + n > block:
            at, full = at + 1, 0
        out.append((cell, at, -(-n // block)))
        at, full = (at + -(-n // block), 0) if n > block else (at, full + n)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, pivots: int = PIVOTS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    data, asked = integers(vectors, scale), integers(queries, scale).where(F.col("id") != int(_NO_ID))
    lengths = data.where("dim > 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    by_dim: dict[int, np.ndarray] = {}
    for d, n in lengths:
        most = max(pivots, min(MOST_PIVOTS, math.isqrt(n) // 8))
        picked = data.where(F.col("dim") == d).orderBy(F.xxhash64("id", "v")).limit(most).select("v").collect()
        by_dim[d] = np.unique(np.array([r["v"] for r in picked], dtype=np.float64).reshape(-1, d), axis=0)

    def pivots_of(d: int) -> np.ndarray:
        return by_dim[d] if d in by_dim else np.zeros((1, d))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, far = np.zeros(len(b), dtype=np.int32), np.zeros(len(b))
            dims = b["dim"].to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                p, x = pivots_of(int(d)), _matrix(b["v"].iloc[rows])
                if d:
                    gap = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0)
                    cell[rows] = gap.argmin(1)
                    far[rows] = np.sqrt(((x - p[cell[rows]]) ** 2).sum(1))
            yield b.assign(cell=cell, far=far)

    cells = written(data.mapInPandas(nearest, "id long, v array<double>, dim int, cell int, far double"))
    summary = written(cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")))
    pruned = F.col("dim").isin(list(by_dim))
    facts = {d: g.reset_index(drop=True) for d, g in summary.where(pruned).toPandas().groupby("dim")}
    # Rows of a cell are dealt to its chunks at random.
    spread = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    dealt = written(cells.join(summary.select("dim", "cell", "parts"), ["dim", "cell"]).select("id", "v", "dim", "cell", spread.alias("part")))
    own = cells.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).join(own, "id", "left")
    asked = asked.select("id", "v", "dim", F.coalesce("own", F.lit(0).cast("long")).alias("own"))
    asked = written(asked.mapInPandas(nearest, "id long, v array<double>, dim int, own long, cell int, far double").withColumnRenamed("cell", "home"))
    homes = written(asked.groupBy("dim", "home").agg(F.count(F.lit(1)).alias("n")))
    laid = [(int(d), *r) for d, g in homes.where(pruned).toPandas().groupby("dim") for r in _laid_out(dict(zip(g["home"].tolist(), g["n"].tolist(), strict=True)), by_dim[d], block)]
    blocks = spark.createDataFrame(laid, "dim int, home int, base int, blocks int")
    blocks = blocks.unionByName(homes.where(~pruned).select("dim", "home", F.lit(0).alias("base"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    asked = asked.join(blocks, ["dim", "home"]).select("id", "v", "dim", "own", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"))

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for every cell that may hold one of its k best."""
        for b in batches:
            for d, own in b.groupby("dim"):
                f, q = facts[d], _matrix(own["v"])
                size = np.sqrt((q * q).sum(1))[:, None]
                mid = q @ pivots_of(d)[f["cell"].to_numpy()].T
                far = np.sqrt((pivots_of(d)[f["cell"].to_numpy()] ** 2).sum(1))
                slack = size * f["r"].to_numpy()[None] * (1 + 1e-9) + size * far[None] * 1e-12 + 1  # and what floats round off
                low, high = mid - slack, mid + slack
                order = np.argsort(-low, axis=1, kind="stable")
                held = np.cumsum(f["n"].to_numpy()[order], axis=1)
                # The query's own rows may be among them.
                enough = held >= k + own["own"].to_numpy()[:, None]
                reached = enough.argmax(axis=1)
                least = np.where(enough[:, -1], np.take_along_axis(low, order, 1)[np.arange(len(q)), reached], -np.inf)
                at, to = np.nonzero(high >= least[:, None])
                for lo in range(0, len(at), 4096):
                    i, j = at[lo : lo + 4096], to[lo : lo + 4096]
                    yield pd.DataFrame({"dim": np.full(len(i), d, dtype=np.int32), "cell": f["cell"].to_numpy()[j], "parts": f["parts"].to_numpy()[j]} | {c: own[c].to_numpy()[i] for c in ("block", "id")} | {"v": [own["v"].iloc[x] for x in i]})

    sent = asked.where(pruned).mapInPandas(needed, "dim int, cell int, parts int, block int, id long, v array<double>")
    other = asked.where(~pruned).join(summary.select("dim", "cell", "parts"), "dim").select("dim", "cell", "parts", "block", "id", "v")
    sent = written(sent.unionByName(other))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    met = written(sent.select("dim", "cell", "parts", "block").distinct()).select("dim", "cell", "block", parts)
    dealt = dealt.join(met, ["dim", "cell", "part"])
    sent = sent.select("dim", "cell", "block", "id", "v", parts)

    def solve(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        ids = x["id"].to_numpy(np.int64)
        m = _matrix(x["v"])
        for lo in range(0, len(q) if len(x) else 0, 256):
            part = q.iloc[lo : lo + 256]
            own = part["id"].to_numpy(np.int64)
            s = _products(_matrix(part["v"]), m)
            for i, row in enumerate(s):
                at = np.flatnonzero(ids != own[i])
                best = at[_ranks(row[None, at], ids[at], k)[0]]
                out["query_id"] += [own[i]] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += row[best].tolist()
        return pd.DataFrame(out).astype("int64")

    keys = ["dim", "cell", "part", "block"]
    local = sent.select(*keys, "id", "v").groupBy(*keys).cogroup(dealt.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != int(_NO_ID), F.col("vec_id")).alias("vec_id"), "score")


def op4_knn(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP4_SQL = """
WITH e AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, e.v)]) AS BIGINT) AS score
      FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
