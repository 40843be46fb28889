"""Status and log-type counts, metrics and replay adjustments as DataFrames.

These run where the counts are; :mod:`tallylog.operators.metrics` does the same over a collected analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallylog.functions import expressions as X
from tallylog.schema import OUTCOMES, STATUSES, UNALERTED


def by_status_and_type(classified: DataFrame) -> DataFrame:
    """The one aggregate over the events from which all other counts are rolled up."""
    return classified.groupBy("observed_status", "log_type").agg(F.count(F.lit(1)).alias("event_count"))


def status_counts(counts: DataFrame) -> DataFrame:
    """status, event_count, percentage: every status, empty ones too, in order."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "status string, place int")
    seen = counts.groupBy("observed_status").agg(F.sum("event_count").alias("n"))
    total = counts.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("total"))
    rows = every.join(seen, every.status == seen.observed_status, "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.orderBy(F.desc(n), "place").select("status", n.alias("event_count"), X.percentage(n, F.col("total")).alias("percentage"))


def log_type_counts(counts: DataFrame) -> DataFrame:
    """status, log_type, event_count and its shares of the archive and of its status. ``counts`` has one row a pair."""
    total = counts.agg(F.sum("event_count").alias("total"))
    each = counts.groupBy(F.col("observed_status").alias("s")).agg(F.sum("event_count").alias("of_status"))
    rows = counts.join(F.broadcast(total)).join(F.broadcast(each), F.col("s") == F.col("observed_status"))
    return rows.select(F.col("observed_status").alias("status"), "log_type", "event_count", X.percentage(F.col("event_count"), F.col("total")).alias("percentage"), X.percentage(F.col("event_count"), F.col("of_status")).alias("status_percentage")).orderBy(F.desc("event_count"), "status", "log_type")


def effective_counts(counts: DataFrame, found: DataFrame, verifications: DataFrame) -> DataFrame:
    """(state, log_type, event_count) after each verified finding's events moved to the state that its replay gave.

    ``verifications`` has finding_key, effective_state and decoder, one row a finding.
    """
    moved = found.join(verifications, "finding_key").select("observed_status", "log_type", "event_count", "effective_state", "decoder")
    to = F.when(F.col("effective_state") == "unverified", F.col("log_type")).otherwise(F.coalesce(F.nullif("decoder", F.lit("")), F.col("log_type")))
    rows = counts.select(F.col("observed_status").alias("state"), "log_type", "event_count")
    rows = rows.unionByName(moved.select(F.col("observed_status").alias("state"), "log_type", (-F.col("event_count")).alias("event_count")))
    rows = rows.unionByName(moved.select(F.col("effective_state").alias("state"), to.alias("log_type"), "event_count"))
    return rows.groupBy("state", "log_type").agg(F.sum("event_count").alias("event_count")).where("event_count <> 0")


def outcome_rollup(effective: DataFrame) -> DataFrame:
    """outcome, event_count: all five, empty ones too."""
    every = effective.sparkSession.createDataFrame([(o, i) for i, o in enumerate(OUTCOMES)], "outcome string, place int")
    seen = effective.groupBy(X.outcome(F.col("state")).alias("o")).agg(F.sum("event_count").alias("n"))
    return every.join(seen, F.col("o") == F.col("outcome"), "left").orderBy("place").select("outcome", F.coalesce("n", F.lit(0).cast("long")).alias("event_count"))


def outcome_by_log_type(effective: DataFrame) -> DataFrame:
    """log_type, one column an outcome, and event_count; log types without events are left out."""
    rows = effective.withColumn("o", X.outcome(F.col("state"))).groupBy("log_type").pivot("o", list(OUTCOMES)).agg(F.sum("event_count"))
    named = {o: o.lower().replace(",", "").replace(" ", "_") for o in OUTCOMES}
    cols = [F.coalesce(F.col(f"`{o}`"), F.lit(0).cast("long")).alias(n) for o, n in named.items()]
    total = sum((F.coalesce(F.col(f"`{o}`"), F.lit(0).cast("long")) for o in OUTCOMES), F.lit(0).cast("long"))
    return rows.select("log_type", *cols, total.alias("event_count")).where("event_count <> 0")


def effective_coverage(found: DataFrame, verifications: DataFrame) -> DataFrame:
    """effective_state, findings, event_count and the share of replayed events, for the states that occur."""
    rows = found.join(verifications.select("finding_key", "effective_state"), "finding_key").groupBy("effective_state").agg(F.count(F.lit(1)).alias("findings"), F.sum("event_count").alias("event_count"))
    total = rows.agg(F.sum("event_count").alias("total"))
    return rows.join(F.broadcast(total)).select("effective_state", "findings", "event_count", X.percentage(F.col("event_count"), F.col("total")).alias("percentage"))


def _sum_of(*states: str):
    return F.coalesce(F.sum(F.when(F.col("state").isin(*states), F.col("event_count"))), F.lit(0).cast("long"))


def primary_metrics(effective: DataFrame, malformed: DataFrame, complete: bool) -> DataFrame:
    """metric, count, denominator, ratio, available. ``malformed`` has one row with ``malformed``."""
    t = effective.agg(F.coalesce(F.sum("event_count"), F.lit(0).cast("long")).alias("n"), _sum_of("no_decoder").alias("nd"), _sum_of("uncovered").alias("u"), _sum_of(*UNALERTED).alias("bt"), _sum_of("no_alerting_rule", "unverified").alias("un")).join(malformed)
    none = F.lit(None).cast("long")
    rows = [
        ("malformed", F.col("malformed"), F.col("n") + F.col("malformed"), True),
        ("decoder_failure", F.col("nd"), F.col("n"), True),
        ("uncovered", F.col("u") if complete else none, F.col("n") - F.col("nd") if complete else none, complete),
        ("below_threshold", F.col("bt"), F.col("n"), True),
        ("uncertainty", F.col("un"), F.col("n"), True),
    ]
    made = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("long").alias("count"), d.cast("long").alias("denominator"), X.ratio(c, d).alias("ratio"), F.lit(a).alias("available")) for m, c, d, a in rows])
    return t.select(F.explode(made).alias("m")).select("m.*")


def log_type_metrics(effective: DataFrame, complete: bool) -> DataFrame:
    """Local rates and contributions of each log type, those with events alone."""
    rows = effective.groupBy("log_type").agg(F.sum("event_count").alias("event_count"), _sum_of("no_decoder").alias("nd"), _sum_of("uncovered").alias("u"), _sum_of(*UNALERTED).alias("bt"))
    totals = rows.agg(*[F.sum(c).alias(f"all_{c}") for c in ("nd", "u", "bt")])
    rows = rows.where("event_count <> 0").join(F.broadcast(totals))
    none = F.lit(None).cast("double")
    return rows.select(
        "log_type",
        "event_count",
        F.col("nd").alias("decoder_failures"),
        X.ratio(F.col("nd"), F.col("event_count")).alias("decoder_failure_rate"),
        X.ratio(F.col("nd"), F.col("all_nd")).alias("decoder_failure_contribution"),
        (X.ratio(F.col("u"), F.col("event_count") - F.col("nd")) if complete else none).alias("uncovered_rate"),
        (X.ratio(F.col("u"), F.col("all_u")) if complete else none).alias("uncovered_contribution"),
        F.col("bt").alias("below_threshold_events"),
        X.ratio(F.col("bt"), F.col("event_count")).alias("below_threshold_rate"),
        X.ratio(F.col("bt"), F.col("all_bt")).alias("below_threshold_contribution"),
    ).orderBy(F.desc("event_count"), F.coalesce("log_type", F.lit("")))


def top_contributors(per_type: DataFrame, k: int = 3) -> DataFrame:
    """metric, place, log_type, count, ratio, contribution: the ``k`` largest of each metric."""
    parts = [("decoder_failure", "decoder_failures", "decoder_failure_rate", "decoder_failure_contribution"), ("below_threshold", "below_threshold_events", "below_threshold_rate", "below_threshold_contribution")]
    made = F.array(*[F.struct(F.lit(m).alias("metric"), "log_type", F.col(c).alias("count"), F.col(r).alias("ratio"), F.col(s).alias("contribution")) for m, c, r, s in parts])
    rows = per_type.select(F.explode(made).alias("m")).select("m.*").where("count <> 0 AND contribution IS NOT NULL")
    w = Window.partitionBy("metric").orderBy(F.desc("contribution"), F.desc("count"), F.coalesce("log_type", F.lit("")))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_log_types(effective: DataFrame, k: int = 20) -> DataFrame:
    """log_type and event_count of the ``k`` largest log types."""
    rows = effective.groupBy("log_type").agg(F.sum("event_count").alias("event_count")).where("event_count <> 0")
    return rows.orderBy(F.desc("event_count"), F.coalesce("log_type", F.lit(""))).limit(k)


def numbered(found: DataFrame) -> DataFrame:
    """Findings with their place in their outcome's list."""
    w = Window.partitionBy("outcome").orderBy(F.desc("event_count"), "finding_key")
    return found.withColumn("outcome", X.outcome(F.col("observed_status"))).withColumn("place", F.row_number().over(w))
