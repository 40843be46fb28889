"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.sources.shared import remove, shared_folder

#: Rows and bytes of one Arrow batch. Texts can be long, so a batch of Spark's default 10,000 rows may not fit a worker.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    Survives the loss of any executor. The tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallylog/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables of :func:`written` once all that is computed from them has been written itself."""
    for df in frames:
        entry = (df.sparkSession, df.__dict__["_written_at"])
        remove(*entry)
        _written.remove(entry)
    settle(frames[0].sparkSession)


def written_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``make``; the tables that ``make`` wrote on the way are removed."""
    at = len(_written)
    out = written(make())
    for entry in _written[at:-1]:
        remove(*entry)
    del _written[at:-1]
    settle(out.sparkSession)
    return out


def settle(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done go with the plans that refer to them: have Spark's cleaner look for those now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone; the cluster's own cleaning takes over
            return


def digest128(*parts: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: equal for equal parts, and 128 bits against chance."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *parts)]


def with_row_key(df: DataFrame, *names: str) -> DataFrame:
    """Add ``_k1`` and ``_k2``, which identify a row by the named columns (nulls included).

    Rows that agree in all the named columns share a key and so get the same result,
    which is why repeated rows and null ids need no care further on.
    """
    # The null flags keep (null, x) and (x, null) apart: the hash function skips nulls.
    parts = [x for n in names for x in (F.col(n).isNull(), F.col(n))]
    k1, k2 = digest128(*parts)
    return df.withColumns({"_k1": k1, "_k2": k2})


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``_row``, a struct of all other columns, so that no name of theirs can clash with one of ours."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of what was :func:`packed`, in their order."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in columns])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node reachable.

    Alternates large-star and small-star steps: each a partial aggregate, which is written, and one join of two plain
    tables, which adaptive execution splits when a centre is hot. Every round is written to the shared folder, and the
    rounds end when the edges no longer change. Nothing but two counters comes to the driver.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _fingerprint(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
        # Large star: every neighbour above the centre is tied to the smallest node around it.
        large = written(both.join(low, both.u == low.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        discard(e, low)
        # Small star: the neighbours below and the centre itself are tied to the smallest of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        star = large.join(low.withColumnRenamed("u", "c"), large.u == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(star.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(large, low)
        before, state = state, _fingerprint(e)
        if before == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return got["n"], got["x"]
