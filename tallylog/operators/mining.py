"""Template mining over a DataFrame of messages.

Messages of different token counts never meet in the miner's tree, so each token count is a group of its own; and where the
first tokens of a group hold no digit and are few enough to have a child each, no message can reach another
first token's leaf, so the group is dealt by (token count, first token), with the same result. Inside a group the feed is in
code-point order. Workers stream: assignments leave as they are made and templates when a cluster is evicted or its group
ends, so a worker holds its live clusters and nothing that grows with the messages.

A group of more different messages than a miner keeps clusters (``max_clusters``) is hot: one miner would evict there, and one task would
hold the stage. It is dealt to parts of that size by the messages' digests, which are mined apart; as each part sees all families
of messages, their templates agree or nearly so, and a second pass mines the parts' templates into common ones. Where even these are more than
a miner keeps, they stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.functions.expressions import tokens
from tallylog.operators.miner import MinerConfig, TemplateMiner

_OUT = "group string, cluster long, digest string, template string"
_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """``df`` kept for reuse by several readers of one plan, until :func:`release`. It can be computed again from its input."""
    _held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _held[-1]


def release() -> None:
    """Let go of what earlier calls kept."""
    while _held:
        _held.pop().unpersist()


def distinct_messages(logs: DataFrame) -> DataFrame:
    """(digest, norm) of each different normalized text in ``logs``."""
    return logs.groupBy("digest").agg(F.first("norm").alias("norm"))


def _fed(messages: DataFrame, config: MinerConfig) -> DataFrame:
    """``messages`` with ``base`` (their group) and ``group`` (their part of it, where it is hot)."""
    counted = messages.select("digest", "norm", tokens(F.col("norm")).alias("t")).select("digest", "norm", F.size("t").alias("n"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))
    # One row a token count; a text of so many characters has no more tokens.
    open_ = counted.groupBy("n").agg(F.max(F.col("first").rlike(r"\p{Nd}|\p{No}")).alias("numeric"), F.count_distinct("first").alias("firsts"))
    split = (~F.col("numeric")) & (F.col("firsts") < config.max_children - 1) & F.lit(config.routed == 1)
    counted = counted.join(F.broadcast(open_.select("n", split.alias("split"))), "n")
    base = F.when(F.col("split"), F.concat(F.col("n"), F.lit(" "), F.col("first"))).otherwise(F.col("n").cast("string"))
    counted = counted.select(base.alias("base"), "digest", "norm")
    # One row for each max_clusters messages at most.
    hot = counted.groupBy("base").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > config.max_clusters)
    hot = hot.select("base", F.ceil(F.col("size") / config.max_clusters).cast("int").alias("parts"))
    # A base begins with a number, so the mark tells parts from whole groups.
    part = F.concat(F.lit("#"), F.pmod(F.xxhash64("digest"), F.col("parts")), F.lit(" "), "base")
    return counted.join(F.broadcast(hot), "base", "left").select("base", F.coalesce(part, F.col("base")).alias("group"), "digest", "norm")


def _run(fed: DataFrame, config: MinerConfig) -> DataFrame:
    """(group, digest, template) of a feed (group, digest, norm) that is dealt and sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner, now, rows = TemplateMiner(config), None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            rows.clear()
            return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["group", "cluster", "digest", "template"])

        for b in batches:
            for group, digest, norm in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if group != now:
                    rows += [(now, c, None, t) for c, t in miner.templates()]
                    miner.reset()
                    now = group
                cluster, gone = miner.add(norm)
                rows.append((group, cluster, digest, None))
                rows += [(group, c, None, t) for c, t in gone]
                if len(rows) >= 8192:
                    yield out()
        rows += [(now, c, None, t) for c, t in miner.templates()]
        if rows:
            yield out()

    # Both sides of the join read it, and mining is the dear part.
    mined = held(fed.select("group", "digest", "norm").mapInArrow(run, _OUT))
    at = mined.where("digest IS NOT NULL").select("group", "cluster", "digest")
    last = mined.where("digest IS NULL").select("group", "cluster", "template")
    return at.join(last, ["group", "cluster"]).select("group", "digest", "template")


def _dealt(fed: DataFrame) -> DataFrame:
    return fed.repartition("group").sortWithinPartitions("group", "norm")


def mine(messages: DataFrame, config: MinerConfig | None = None, parallel: bool = True) -> DataFrame:
    """(digest, template) for distinct ``messages`` (digest, norm). ``parallel=False`` feeds one miner in one global order."""
    config = config or MinerConfig()
    if not parallel:
        return _run(messages.select(F.lit("").alias("group"), "digest", "norm").coalesce(1).sortWithinPartitions("norm"), config).select("digest", "template")
    found = _run(_dealt(_fed(messages, config).select("group", "digest", "norm")), config).withColumn("base", F.regexp_replace("group", "^#[0-9]+ ", ""))
    # Templates of the parts of hot groups, if one miner keeps them all.
    hot = F.col("group").startswith("#")
    parts = found.where(hot).select("base", "template").distinct()
    few = parts.groupBy("base").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= config.max_clusters).select("base")
    common = _run(_dealt(parts.join(few, "base").select(F.col("base").alias("group"), F.col("template").alias("digest"), F.col("template").alias("norm"))), config)
    common = common.select(F.col("group").alias("base"), F.col("digest").alias("template"), F.col("template").alias("common"))
    return found.join(common, ["base", "template"], "left").select("digest", F.coalesce("common", "template").alias("template"))
