"""Joins, running sums and choices that need no more than keys and an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallylog.operators.mining import held


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that come first among those of their ``key``, by a semi-join on an ``order`` that tells rows apart."""
    first = rows.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return rows.join(first, order, "left_semi")


def running_sum(rows: DataFrame, order: str, size: str, ranges: int = 32) -> DataFrame:
    """``rows`` with ``running``, the sum of ``size`` up to each row by ``order``: sums inside ranges, moved by the totals before."""
    ranged = held(rows.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    # One row a range, so this window without a partition is as small as their number.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_total")).select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    own = F.sum(size).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(F.broadcast(totals), "_range").withColumn("running", F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def chunked(rows: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """:func:`running_sum` with ``chunk``, the number of the stretch of ``most`` units that a row begins in."""
    return running_sum(rows, order, size).withColumn("chunk", F.expr(f"(running - `{size}`) div {most}"))


def latest_templates(changes: DataFrame) -> DataFrame:
    """cluster_id, template_id, template: the last template (by ``change``) of each cluster, and the smallest cluster that has the same text."""
    last = changes.groupBy("cluster_id").agg(F.max_by("template", "change").alias("template"))
    return last.join(last.groupBy("template").agg(F.min("cluster_id").alias("template_id")), "template").select("cluster_id", "template_id", "template")
