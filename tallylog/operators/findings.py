"""Classified events and the findings that group the unresolved ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions import expressions as X
from tallylog.operators.miner import MinerConfig
from tallylog.operators.mining import distinct_messages, held, mine

#: What makes a finding. Templates go by their digest, so that their text crosses no exchange with the events.
_KEYS = ["observed_status", "finding_log_type", "template_id", "eventchannel_pattern", "orphan", "rule_key"]


def classify(events: DataFrame, threshold: int) -> DataFrame:
    """Events that are well formed, with observed_status and log_type."""
    return events.where(~F.col("is_malformed")).drop("is_malformed").withColumns({"observed_status": X.status(threshold), "log_type": X.log_type()})


def unresolved(classified: DataFrame) -> DataFrame:
    """The events that make findings, with the pattern of EventChannel records."""
    rows = classified.where((F.col("observed_status") != "at_or_above_threshold") & (F.nullif("full_log", F.lit("")).isNotNull()))
    pattern = X.eventchannel_pattern(X.eventchannel_fields(F.col("decoder_name"), F.col("full_log")))
    return rows.withColumn("eventchannel_pattern", F.when(F.col("observed_status") != "below_threshold", pattern))


def with_digest(rows: DataFrame) -> DataFrame:
    """norm and its digest for the events that are mined; null for the others."""
    mined = (F.col("observed_status") != "below_threshold") & F.col("eventchannel_pattern").isNull()
    return rows.withColumn("norm", F.when(mined, X.normalize(F.col("full_log")))).withColumn("digest", F.md5("norm"))


def assign_templates(rows: DataFrame, config: MinerConfig | None = None, parallel: bool = True) -> DataFrame:
    """(digest, template) of every different message in ``rows`` (which have digest and norm)."""
    messages = distinct_messages(rows.where("digest IS NOT NULL").select("digest", "norm"))
    return mine(messages, config, parallel)


def finding_groups(rows: DataFrame, assigned: DataFrame | None) -> DataFrame:
    """One row a finding: its keys, counts, times and the smallest event as its sample.

    ``rows`` come from :func:`with_digest`. A left join keeps events whose message has no template: they group by their own
    digest. Events are first gathered by finding and agent, then by finding, so that one pass over them counts the agents,
    too, and a finding of a third of all events is a few rows a task before it is dealt. Template texts are joined to the findings.
    """
    below = F.col("observed_status") == "below_threshold"
    joined = with_templates(rows, assigned).withColumns(
        {
            "rule_key": F.when(below, F.coalesce("rule_id", F.lit("unknown"))),
            "finding_log_type": F.when(~below, F.col("log_type")),
            "_decoder": F.when(~below, F.col("decoder_name")),
            "_location": F.when(~below, F.col("location")),
        }
    )
    first, last, sample = F.min("event_timestamp").alias("first_timestamp"), F.max("event_timestamp").alias("last_timestamp"), smallest("full_log", "_location", "_decoder", "rule_id", "rule_level").alias("sample")
    by_agent = joined.groupBy(*_KEYS, "agent_id").agg(F.count(F.lit(1)).alias("event_count"), first, last, sample)
    groups = by_agent.groupBy(*_KEYS).agg(
        F.sum("event_count").alias("event_count"),
        affected_agents().alias("affected_agents"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
        F.min("sample").alias("sample"),
    )
    if assigned is None:
        return groups.withColumn("template", F.lit(None).cast("string"))
    texts = assigned.select(F.md5("template").alias("template_id"), "template").distinct()
    return groups.join(texts, "template_id", "left")


def with_templates(rows: DataFrame, assigned: DataFrame | None) -> DataFrame:
    """``rows`` with template_id, and orphan: the digest of a message without a template. Rows without a digest have neither."""
    if assigned is None:
        joined = rows.withColumn("template_id", F.lit(None).cast("string"))
    else:
        joined = rows.join(assigned.select("digest", F.md5("template").alias("template_id")), "digest", "left")
    return joined.withColumn("orphan", F.when(F.col("template_id").isNull(), F.col("digest")))


def smallest(first: str, *others: str) -> Column:
    """The least row by ``first`` and then the others, as a struct. A flag before each of the others orders nulls last."""
    return F.min(F.struct(first, *[x for c in others for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))]))


def affected_agents() -> Column:
    """Agents of rows that are grouped by agent already: the null agent is none."""
    return F.count("agent_id")


def present(groups: DataFrame) -> DataFrame:
    """The findings relation: keys, pattern, formatted times, and the sample on one line."""
    pattern = (
        F.when(F.col("observed_status") == "below_threshold", F.concat(F.lit("rule:"), "rule_key"))
        .when(F.col("eventchannel_pattern").isNotNull(), F.col("eventchannel_pattern"))
        .otherwise(F.coalesce("template", X.normalize(F.col("sample.full_log"))))
    )
    return groups.withColumn("message_pattern", pattern).select(
        X.finding_key(F.col("observed_status"), F.col("rule_key"), F.col("finding_log_type"), F.col("message_pattern")).alias("finding_key"),
        "observed_status",
        F.col("finding_log_type").alias("log_type"),
        "message_pattern",
        "event_count",
        "affected_agents",
        X.shown_time(F.col("first_timestamp")).alias("first_seen"),
        X.shown_time(F.col("last_timestamp")).alias("last_seen"),
        F.col("sample._decoder").alias("observed_decoder"),
        F.col("sample._location").alias("observed_location"),
        F.col("sample.rule_id").alias("observed_rule_id"),
        F.col("sample.rule_level").alias("observed_rule_level"),
        X.one_line(F.col("sample.full_log")).alias("sample_log"),
    )


def findings(classified: DataFrame, config: MinerConfig | None = None, parallel: bool = True, mined: bool = True) -> DataFrame:
    """The findings of classified events. ``mined=False`` groups unparsed messages by their own text."""
    rows = with_digest(unresolved(classified))
    assigned = held(assign_templates(rows, config, parallel)) if mined else None
    return present(finding_groups(rows, assigned))


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("event_count"), "observed_status", F.coalesce("log_type", F.lit("")), "finding_key")
