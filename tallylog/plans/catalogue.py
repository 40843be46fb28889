"""Registered queries over the test tables, and the SQL that each is held against.

The tables have no security archive, so one is derived from ``events`` by fixed rules, the same in both engines.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions import expressions as X
from tallylog.functions.suggest import regex_suggestion
from tallylog.operators import counts as C
from tallylog.operators import findings as G
from tallylog.operators import relations as R
from tallylog.operators.mining import held, release
from tallylog.schema import OUTCOMES, STATUSES
from tallylog.sources.archive import parse_events, read_archive
from tallylog.sources.shared import shared_folder

THRESHOLD = 3
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # What the query before kept for itself goes with it.
            release()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- the derived archive -------------------------------------------------------------------------------------------


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event columns from ``events``: every eleventh event is an EventChannel record."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    channel = F.expr("event_id % 11 = 0 AND event_type <> 'error'")
    text = F.expr("concat(event_type, ' user ', user_id, ' id=', event_id * 7919, ' props=', props)")
    record = F.expr("""concat('{"win":{"system":{"channel":"', event_type, '","providerName":"p', event_id % 3, '","eventID":"', event_id % 7, '","systemTime":"', event_id, '"}}}')""")
    return e.select(
        F.lit(False).alias("is_malformed"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("user_id").cast("string").alias("agent_id"),
        F.concat(F.lit("agent-"), "user_id").alias("agent_name"),
        F.concat(F.lit("src/"), "event_type").alias("location"),
        F.when(channel, record).otherwise(text).alias("full_log"),
        F.lit(None).cast("string").alias("program_name"),
        F.when(F.col("event_type") == "error", F.lit(None)).when(channel, "windows_eventchannel").otherwise(F.col("event_type")).alias("decoder_name"),
        F.lit(None).cast("string").alias("decoder_parent"),
        F.expr("CASE WHEN event_type IN ('purchase','signup') THEN CAST(100 + event_id % 5 AS STRING) END").alias("rule_id"),
        F.expr("CAST(event_id % 8 AS INT)").alias("rule_level"),
        F.lit(None).cast("string").alias("rule_description"),
    )


_ARCHIVE = """archive AS (
  SELECT ts AS event_timestamp, CAST(user_id AS VARCHAR) AS agent_id, 'src/' || event_type AS location, event_id, event_type, props,
    CASE WHEN event_id % 11 = 0 AND event_type <> 'error'
      THEN '{"win":{"system":{"channel":"' || event_type || '","providerName":"p' || event_id % 3 || '","eventID":"' || event_id % 7 || '","systemTime":"' || event_id || '"}}}'
      ELSE event_type || ' user ' || user_id || ' id=' || event_id * 7919 || ' props=' || props END AS full_log,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 11 = 0 THEN 'windows_eventchannel' ELSE event_type END AS decoder_name,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(100 + event_id % 5 AS VARCHAR) END AS rule_id,
    CAST(event_id % 8 AS INTEGER) AS rule_level
  FROM events)"""


def _classified_sql(threshold: int = THRESHOLD) -> str:
    return f"""{_ARCHIVE}, classified AS (
  SELECT *, CASE WHEN nullif(decoder_name, '') IS NULL THEN 'no_decoder' WHEN nullif(rule_id, '') IS NULL THEN 'no_alerting_rule'
      WHEN rule_level IS NULL OR rule_level < {threshold} THEN 'below_threshold' ELSE 'at_or_above_threshold' END AS observed_status,
    coalesce(nullif(decoder_name, ''), nullif(location, ''), 'unknown') AS log_type
  FROM archive)"""


def classified(spark: SparkSession, sf_dir: str, threshold: int = THRESHOLD) -> DataFrame:
    return G.classify(archive(spark, sf_dir), threshold)


# ---- counts --------------------------------------------------------------------------------------------------------

_STATUS_ROWS = ", ".join(f"('{s}', {i})" for i, s in enumerate(STATUSES))


@query(f"WITH {_classified_sql()}, s(status, place) AS (VALUES {_STATUS_ROWS}), n AS (SELECT observed_status, count(*) AS n FROM classified GROUP BY 1) SELECT status, coalesce(n, 0) AS event_count, CASE WHEN (SELECT count(*) FROM classified) = 0 THEN 0.0 ELSE 100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM classified) END AS percentage FROM s LEFT JOIN n ON status = observed_status")
def status_counts(spark, sf_dir):
    return C.status_counts(C.by_status_and_type(classified(spark, sf_dir)))


@query(f"WITH {_classified_sql()}, n AS (SELECT observed_status AS status, log_type, count(*) AS event_count FROM classified GROUP BY 1, 2) SELECT *, 100.0::DOUBLE * event_count / sum(event_count) OVER () AS percentage, 100.0::DOUBLE * event_count / sum(event_count) OVER (PARTITION BY status) AS status_percentage FROM n")
def log_type_counts(spark, sf_dir):
    return C.log_type_counts(C.by_status_and_type(classified(spark, sf_dir)))


def _threshold_query(t: int) -> None:
    def run(spark, sf_dir):
        return classified(spark, sf_dir, t).groupBy("observed_status").agg(F.count(F.lit(1)).alias("event_count"))

    run.__name__ = f"classify_threshold_{t}"
    query(f"WITH {_classified_sql(t)} SELECT observed_status, count(*) AS event_count FROM classified GROUP BY 1")(run)


for _t in (1, 3, 7):
    _threshold_query(_t)


# ---- JSON ----------------------------------------------------------------------------------------------------------

_LINES = """lines AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{not-json}' WHEN 1 THEN 'null' WHEN 2 THEN '[1,2]' WHEN 3 THEN '"text"' WHEN 4 THEN '{"a":1} x' WHEN 5 THEN '12'
  ELSE '{"timestamp":"2026-09-18T09:00:00+00:00","agent":{"id":"' || user_id || '"},"rule":{"id":"' || event_id % 5 || '","level":' || event_id % 8 || '},"decoder":{},"props":' || props || '}' END AS value FROM events)"""


def _lines(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.expr("""CASE event_id % 9 WHEN 0 THEN '{not-json}' WHEN 1 THEN 'null' WHEN 2 THEN '[1,2]' WHEN 3 THEN '"text"' WHEN 4 THEN '{"a":1} x' WHEN 5 THEN '12'
      ELSE concat('{"timestamp":"2026-09-18T09:00:00+00:00","agent":{"id":"', user_id, '"},"rule":{"id":"', event_id % 5, '","level":', event_id % 8, '},"decoder":{},"props":', props, '}') END""").alias("value"))


@query(f"WITH {_LINES} SELECT NOT (json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value ELSE 'null' END) = 'OBJECT') AS is_malformed, count(*) AS n FROM lines GROUP BY 1")
def malformed_split(spark, sf_dir):
    return parse_events(_lines(spark, sf_dir)).groupBy("is_malformed").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES} SELECT json_extract_string(value, '$.agent.id') AS agent_id, json_extract_string(value, '$.rule.id') AS rule_id, CAST(json_extract_string(value, '$.rule.level') AS INTEGER) AS rule_level, count(*) AS n FROM lines WHERE event_id % 9 > 5 GROUP BY ALL")
def archive_fields(spark, sf_dir):
    return parse_events(_lines(spark, sf_dir)).where(~F.col("is_malformed")).groupBy("agent_id", "rule_id", "rule_level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_int, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract_fields(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.alias("k"), X.to_int(k).alias("k_int"), F.get_json_object("props", "$.missing").alias("missing"))


_CAST_INT = "CASE event_id % 6 WHEN 0 THEN '3.7' WHEN 1 THEN ' 4 ' WHEN 2 THEN '+5' WHEN 3 THEN 'bad' WHEN 4 THEN '' ELSE CAST(event_id AS {0}) END"
_CAST_TS = "CASE event_id % 5 WHEN 0 THEN '2026-09-18T09:00:00+03:00' WHEN 1 THEN '2026-09-18 09:00:00+00:00' WHEN 2 THEN 'not a time' WHEN 3 THEN '2026-13-01 00:00:00' ELSE '2026-09-18T09:00:00Z' END"


@query(f"SELECT event_id, TRY_CAST({_CAST_INT.format('VARCHAR')} AS INTEGER) AS n, CAST(epoch(TRY_CAST({_CAST_TS} AS TIMESTAMPTZ)) AS BIGINT) AS at FROM events")
def safe_casts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = X.to_timestamp(F.expr(_CAST_TS))
    return e.select("event_id", X.to_int(F.expr(_CAST_INT.format("STRING"))).alias("n"), F.unix_timestamp(ts).alias("at"))


# ---- findings ------------------------------------------------------------------------------------------------------

_SHOWN = "strftime({0}, '%Y-%m-%d %H:%M:%S') || '+00'"
_SAMPLE = "min({'full_log': full_log, 'location': CASE WHEN observed_status <> 'below_threshold' THEN location END, 'decoder': CASE WHEN observed_status <> 'below_threshold' THEN decoder_name END, 'rule_id': rule_id, 'rule_level': rule_level})"


def _finding_sql(where: str, extra: str, pattern: str, key: str, group: str, log_type: str) -> str:
    return f"""WITH {_classified_sql()}, rows AS (SELECT *, {extra} FROM classified WHERE {where}),
g AS (SELECT observed_status, {log_type} AS log_type, {group}, count(*) AS event_count, count(DISTINCT agent_id) AS affected_agents, min(event_timestamp) AS f, max(event_timestamp) AS l, {_SAMPLE} AS sample FROM rows GROUP BY ALL)
SELECT md5(CAST(to_json({key}) AS VARCHAR)) AS finding_key, observed_status, log_type, {pattern} AS message_pattern, event_count, affected_agents, {_SHOWN.format("f")} AS first_seen, {_SHOWN.format("l")} AS last_seen,
sample.decoder AS observed_decoder, sample.location AS observed_location, sample.rule_id AS observed_rule_id, sample.rule_level AS observed_rule_level, trim(regexp_replace(sample.full_log, '[\\r\\n]+', ' ', 'g')) AS sample_log FROM g"""


@query(_finding_sql("observed_status = 'below_threshold'", "coalesce(rule_id, 'unknown') AS rule_key", "'rule:' || rule_key", "[observed_status, rule_key]", "rule_key", "CAST(NULL AS VARCHAR)"))
def below_threshold_findings(spark, sf_dir):
    rows = G.with_digest(G.unresolved(classified(spark, sf_dir).where("observed_status = 'below_threshold'")))
    return G.present(G.finding_groups(rows, None))


_CHANNEL = "'channel=' || coalesce(json_extract_string(full_log, '$.win.system.channel'), '-') || ' provider=' || coalesce(json_extract_string(full_log, '$.win.system.providerName'), '-') || ' eventID=' || coalesce(json_extract_string(full_log, '$.win.system.eventID'), '-') AS p"


@query(_finding_sql("observed_status = 'no_alerting_rule' AND decoder_name = 'windows_eventchannel'", _CHANNEL, "p", "[observed_status, log_type, p]", "p", "log_type"))
def eventchannel_findings(spark, sf_dir):
    rows = classified(spark, sf_dir).where("observed_status = 'no_alerting_rule' AND decoder_name = 'windows_eventchannel'")
    return G.present(G.finding_groups(G.with_digest(G.unresolved(rows)), None))


@query(f"WITH {_classified_sql()} SELECT observed_status, log_type, r.full_log, r.location, r.rule_id, r.rule_level FROM (SELECT observed_status, log_type, min({{'full_log': full_log, 'location': location, 'rule_id': rule_id, 'rule_level': rule_level}}) AS r FROM classified GROUP BY 1, 2)")
def representative_sample(spark, sf_dir):
    g = classified(spark, sf_dir).groupBy("observed_status", "log_type").agg(G.smallest("full_log", "location", "rule_id", "rule_level").alias("r"))
    return g.select("observed_status", "log_type", "r.full_log", "r.location", "r.rule_id", "r.rule_level")


@query(f"WITH {_classified_sql()} SELECT log_type, count(DISTINCT agent_id) AS affected_agents FROM classified GROUP BY 1")
def affected_agents(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("log_type", "agent_id").agg(F.lit(1)).groupBy("log_type").agg(G.affected_agents().alias("affected_agents"))


@query(f"WITH {_classified_sql()} SELECT observed_status, {_SHOWN.format('min(event_timestamp)')} AS first_seen, {_SHOWN.format('max(event_timestamp)')} AS last_seen FROM classified GROUP BY 1")
def first_last_seen(spark, sf_dir):
    g = classified(spark, sf_dir).groupBy("observed_status").agg(F.min("event_timestamp").alias("f"), F.max("event_timestamp").alias("l"))
    return g.select("observed_status", X.shown_time(F.col("f")).alias("first_seen"), X.shown_time(F.col("l")).alias("last_seen"))


@query(f"WITH {_classified_sql()} SELECT DISTINCT md5(CAST(to_json(CASE WHEN observed_status = 'below_threshold' THEN [observed_status, rule_id] ELSE [observed_status, log_type, location] END) AS VARCHAR)) AS finding_key, observed_status FROM classified")
def finding_keys(spark, sf_dir):
    key = X.finding_key(F.col("observed_status"), F.col("rule_id"), F.col("log_type"), F.col("location"))
    return classified(spark, sf_dir).select(key.alias("finding_key"), "observed_status").distinct()


# ---- normalization and messages ------------------------------------------------------------------------------------

# The oracle's engine has no lookarounds; its word boundaries are ASCII already.
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(THE_TEXT, ''), '^" + X.TIMESTAMP + "', '<TIMESTAMP>'), '" + X.UUID + "', '<UUID>', 'g'), '\\b" + X.HEX + "\\b', '<HEX>', 'g'), '\\b" + X.NUM + "\\b', '<NUM>', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.replace('THE_TEXT', 'text')}) AS norm FROM documents")
def normalize_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm"))


@query(f"SELECT conv_id, turn, {_NORM.replace('THE_TEXT', 'text')} AS norm FROM conversations")
def normalize_conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", X.normalize(F.col("text")).alias("norm"))


_STAMPED = "CASE event_id % 9 WHEN 0 THEN '2026-07-18T01:02:03.456+03:00' WHEN 1 THEN '2026-07-18T01:02:03,4' WHEN 2 THEN '2026-07-18 01:02:03Z' WHEN 3 THEN 'Jul  8 01:02:03' WHEN 4 THEN '18/Jul/2026:01:02:03 +0300' WHEN 5 THEN 'Sat Jul 18 01:02:03 2026' WHEN 6 THEN '18/07/2026 01:02:03.5' WHEN 7 THEN '20260718T010203Z' ELSE 'at 2026-07-18T01:02:03Z' END || ' user=' || user_id || ' id=' || event_id * 7919 || ' key=00112233445566778899 550e8400-e29b-41d4-a716-446655440000'"


@query(f"SELECT event_id, {_NORM.replace('THE_TEXT', _STAMPED)} AS norm FROM events")
def normalize_timestamps(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.normalize(F.expr(_STAMPED)).alias("norm"))


_MESSAGES = f"m AS (SELECT event_id, octet_length(encode(full_log)) AS size, {_NORM.replace('THE_TEXT', 'full_log')} AS norm FROM archive)"


@query(f"WITH {_ARCHIVE}, {_MESSAGES} SELECT md5(norm) AS digest, min(event_id) AS first_event, arg_min(size, event_id) AS log_length, count(*) AS n FROM m GROUP BY 1")
def distinct_messages(spark, sf_dir):
    a = _with_event_id(spark, sf_dir).select("event_id", F.octet_length("full_log").cast("long").alias("size"), F.md5(X.normalize(F.col("full_log"))).alias("digest"))
    return a.groupBy("digest").agg(F.min("event_id").alias("first_event"), F.min_by("size", "event_id").alias("log_length"), F.count(F.lit(1)).alias("n"))


def _with_event_id(spark, sf_dir):
    """The archive's logs with the id of the event that each comes from."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.expr("concat(event_type, ' user ', user_id, ' id=', event_id * 7919, ' props=', props)")
    record = F.expr("""concat('{"win":{"system":{"channel":"', event_type, '","providerName":"p', event_id % 3, '","eventID":"', event_id % 7, '","systemTime":"', event_id, '"}}}')""")
    return e.select("event_id", "event_type", "user_id", F.when(F.expr("event_id % 11 = 0 AND event_type <> 'error'"), record).otherwise(text).alias("full_log"))


@query(f"WITH {_ARCHIVE}, {_MESSAGES}, f AS (SELECT min(event_id) AS event_id FROM m GROUP BY md5(norm)) SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM archive WHERE event_id IN (SELECT event_id FROM f)")
def semi_join_first_events(spark, sf_dir):
    a = _with_event_id(spark, sf_dir).withColumn("digest", F.md5(X.normalize(F.col("full_log"))))
    return R.first_of_each(a, "digest", "event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT doc_id, CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - octet_length(encode(text)) AS BIGINT) // 65536 AS chunk FROM documents")
def running_log_bytes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return R.chunked(d, "doc_id", "size", 65536).select("doc_id", "running", "chunk")


@query("""WITH t(event_type, template) AS (VALUES ('click', 'a <*>'), ('view', 'b <*>')) SELECT md5(e.event_type) AS digest, md5(t.template) AS template_id, CASE WHEN t.template IS NULL THEN md5(e.event_type) END AS orphan, count(*) AS n FROM events e LEFT JOIN t ON t.event_type = e.event_type GROUP BY ALL""")
def left_join_orphans(spark, sf_dir):
    t = spark.createDataFrame([("click", "a <*>"), ("view", "b <*>")], "event_type string, template string").select(F.md5("event_type").alias("digest"), "template")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.md5("event_type").alias("digest"))
    return G.with_templates(e, t).groupBy("digest", "template_id", "orphan").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH ch AS (SELECT l_partkey % 500 AS cluster_id, l_orderkey * 10 + l_linenumber AS change, 'template ' || l_suppkey % 50 AS template FROM lineitem),
last AS (SELECT cluster_id, max(change) AS change FROM ch GROUP BY 1), ct AS (SELECT ch.cluster_id, ch.template FROM ch JOIN last USING (cluster_id, change)),
ids AS (SELECT template, min(cluster_id) AS template_id FROM ct GROUP BY 1) SELECT ct.cluster_id, ids.template_id, ct.template FROM ct JOIN ids USING (template)""")
def canonical_template_id(spark, sf_dir):
    """The latest template of each cluster, and the smallest cluster with the same text."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ch = li.select((F.col("l_partkey") % 500).alias("cluster_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change"), F.concat(F.lit("template "), (F.col("l_suppkey") % 50)).alias("template"))
    return R.latest_templates(ch)


# ---- replay, metrics and outcomes ----------------------------------------------------------------------------------


def _found(spark, sf_dir) -> DataFrame:
    """Findings by (status, log type), as stand-ins whose keys SQL can make, too."""
    g = classified(spark, sf_dir).where("observed_status <> 'at_or_above_threshold'").groupBy("observed_status", "log_type").agg(F.count(F.lit(1)).alias("event_count"))
    return g.withColumn("finding_key", F.md5(F.concat("observed_status", F.lit("|"), "log_type")))


_FOUND = "found AS (SELECT observed_status, log_type, count(*) AS event_count, md5(observed_status || '|' || log_type) AS finding_key FROM classified WHERE observed_status <> 'at_or_above_threshold' GROUP BY 1, 2)"
_STATE = "CASE log_type WHEN 'click' THEN 'uncovered' WHEN 'view' THEN 'suppressed' WHEN 'windows_eventchannel' THEN 'unverified' ELSE 'no_decoder' END"
_VERDICTS = f"verdicts AS (SELECT finding_key, {_STATE} AS effective_state, CASE WHEN log_type = 'click' THEN 'web' END AS decoder FROM found WHERE observed_status IN ('no_decoder', 'no_alerting_rule'))"
_EFFECTIVE = f"""{_classified_sql()}, {_FOUND}, {_VERDICTS}, moved AS (SELECT f.*, v.effective_state, v.decoder FROM found f JOIN verdicts v USING (finding_key)),
eff AS (SELECT state, log_type, CAST(sum(n) AS BIGINT) AS event_count FROM (
  SELECT observed_status AS state, log_type, count(*) AS n FROM classified GROUP BY 1, 2
  UNION ALL SELECT observed_status, log_type, -event_count FROM moved
  UNION ALL SELECT effective_state, CASE WHEN effective_state = 'unverified' THEN log_type ELSE coalesce(nullif(decoder, ''), log_type) END, event_count FROM moved) GROUP BY 1, 2 HAVING sum(n) <> 0)"""


def _verdicts(found: DataFrame) -> DataFrame:
    return found.where("observed_status IN ('no_decoder', 'no_alerting_rule')").select("finding_key", F.expr(_STATE).alias("effective_state"), F.expr("CASE WHEN log_type = 'click' THEN 'web' END").alias("decoder"))


def _effective(spark, sf_dir) -> DataFrame:
    found = _found(spark, sf_dir)
    return C.effective_counts(C.by_status_and_type(classified(spark, sf_dir)), found, _verdicts(found))


@query(f"WITH {_EFFECTIVE} SELECT * FROM eff")
def effective_counts(spark, sf_dir):
    return _effective(spark, sf_dir)


_OUTCOME = "CASE WHEN state = 'at_or_above_threshold' THEN 'Rule matched, alerted' WHEN state IN ('suppressed', 'below_threshold') THEN 'Rule matched, no alert' WHEN state = 'uncovered' THEN 'No rule' WHEN state = 'no_decoder' THEN 'No decoder' ELSE 'Not verified' END"


@query(f"WITH {_EFFECTIVE}, o(outcome) AS (VALUES {', '.join(f'({chr(39)}{o}{chr(39)})' for o in OUTCOMES)}), n AS (SELECT {_OUTCOME} AS outcome, CAST(sum(event_count) AS BIGINT) AS n FROM eff GROUP BY 1) SELECT outcome, coalesce(n, 0) AS event_count FROM o LEFT JOIN n USING (outcome)")
def outcome_rollup(spark, sf_dir):
    return C.outcome_rollup(_effective(spark, sf_dir))


@query(f"WITH {_EFFECTIVE} SELECT log_type, " + ", ".join(f"CAST(coalesce(sum(event_count) FILTER ({_OUTCOME} = '{o}'), 0) AS BIGINT) AS {o.lower().replace(',', '').replace(' ', '_')}" for o in OUTCOMES) + ", CAST(sum(event_count) AS BIGINT) AS event_count FROM eff GROUP BY 1 HAVING sum(event_count) <> 0")
def outcome_by_log_type(spark, sf_dir):
    return C.outcome_by_log_type(_effective(spark, sf_dir))


@query(f"WITH {_EFFECTIVE}, c AS (SELECT effective_state, count(*) AS findings, CAST(sum(event_count) AS BIGINT) AS event_count FROM moved GROUP BY 1) SELECT *, 100.0::DOUBLE * event_count / sum(event_count) OVER () AS percentage FROM c")
def effective_coverage(spark, sf_dir):
    found = _found(spark, sf_dir)
    return C.effective_coverage(found, _verdicts(found))


_TOTALS = "t AS (SELECT CAST(sum(event_count) AS BIGINT) AS n, CAST(coalesce(sum(event_count) FILTER (state = 'no_decoder'), 0) AS BIGINT) AS nd, CAST(coalesce(sum(event_count) FILTER (state = 'uncovered'), 0) AS BIGINT) AS u, CAST(coalesce(sum(event_count) FILTER (state IN ('suppressed', 'below_threshold')), 0) AS BIGINT) AS bt, CAST(coalesce(sum(event_count) FILTER (state IN ('no_alerting_rule', 'unverified')), 0) AS BIGINT) AS un FROM eff)"
_METRIC = "SELECT '{0}' AS metric, CAST({1} AS BIGINT) AS count, CAST({2} AS BIGINT) AS denominator, CAST({1} AS DOUBLE) / nullif({2}, 0) AS ratio, true AS available FROM t"


@query(f"WITH {_EFFECTIVE}, {_TOTALS} " + " UNION ALL ".join(_METRIC.format(*m) for m in (("malformed", "0", "n"), ("decoder_failure", "nd", "n"), ("uncovered", "u", "(n - nd)"), ("below_threshold", "bt", "n"), ("uncertainty", "un", "n"))))
def primary_metrics(spark, sf_dir):
    return C.primary_metrics(_effective(spark, sf_dir), archive(spark, sf_dir).agg(F.count_if("is_malformed").alias("malformed")), complete=True)


@query(f"WITH {_EFFECTIVE}, {_TOTALS} " + " UNION ALL ".join(_METRIC.format(*m) for m in (("malformed", "0", "n"), ("decoder_failure", "nd", "n"), ("below_threshold", "bt", "n"), ("uncertainty", "un", "n"))) + " UNION ALL SELECT 'uncovered', NULL, NULL, NULL, false")
def primary_metrics_incomplete(spark, sf_dir):
    """With a replay that is not complete the uncovered rate is not known."""
    return C.primary_metrics(_effective(spark, sf_dir), archive(spark, sf_dir).agg(F.count_if("is_malformed").alias("malformed")), complete=False)


_PER_TYPE = "r AS (SELECT log_type, CAST(sum(event_count) AS BIGINT) AS n, CAST(coalesce(sum(event_count) FILTER (state = 'no_decoder'), 0) AS BIGINT) AS nd, CAST(coalesce(sum(event_count) FILTER (state = 'uncovered'), 0) AS BIGINT) AS u, CAST(coalesce(sum(event_count) FILTER (state IN ('suppressed', 'below_threshold')), 0) AS BIGINT) AS bt FROM eff GROUP BY 1)"


@query(f"WITH {_EFFECTIVE}, {_PER_TYPE} SELECT log_type, n AS event_count, nd AS decoder_failures, nd::DOUBLE / n AS decoder_failure_rate, nd::DOUBLE / nullif(sum(nd) OVER (), 0) AS decoder_failure_contribution, u::DOUBLE / nullif(n - nd, 0) AS uncovered_rate, u::DOUBLE / nullif(sum(u) OVER (), 0) AS uncovered_contribution, bt AS below_threshold_events, bt::DOUBLE / n AS below_threshold_rate, bt::DOUBLE / nullif(sum(bt) OVER (), 0) AS below_threshold_contribution FROM r WHERE n <> 0")
def log_type_metrics(spark, sf_dir):
    return C.log_type_metrics(_effective(spark, sf_dir), complete=True)


@query(f"""WITH {_EFFECTIVE}, {_PER_TYPE}, s AS (
  SELECT 'decoder_failure' AS metric, log_type, nd AS count, nd::DOUBLE / n AS ratio, nd::DOUBLE / nullif(sum(nd) OVER (), 0) AS contribution FROM r WHERE n <> 0
  UNION ALL SELECT 'below_threshold', log_type, bt, bt::DOUBLE / n, bt::DOUBLE / nullif(sum(bt) OVER (), 0) FROM r WHERE n <> 0)
SELECT metric, log_type, count, ratio, contribution, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY contribution DESC, count DESC, coalesce(log_type, '')) AS place FROM s WHERE count <> 0) WHERE place <= 3""")
def top_contributors(spark, sf_dir):
    return C.top_contributors(C.log_type_metrics(_effective(spark, sf_dir), complete=True))


@query(f"WITH {_EFFECTIVE} SELECT log_type, CAST(sum(event_count) AS BIGINT) AS event_count FROM eff GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_log_types(spark, sf_dir):
    return C.top_log_types(_effective(spark, sf_dir), 20)


_ANSWER = "CASE event_id % 5 WHEN 0 THEN 'NoDecoder' WHEN 1 THEN 'NoRule' WHEN 2 THEN 'Error' ELSE 'RuleMatch' END"
_LEVEL = "CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(event_id % 7 AS INT) END"


@query(f"WITH a AS (SELECT {_ANSWER} AS answer, {_LEVEL} AS level FROM events) SELECT CASE WHEN answer = 'NoDecoder' THEN 'no_decoder' WHEN answer = 'NoRule' THEN 'uncovered' WHEN answer <> 'RuleMatch' OR level IS NULL THEN 'unverified' WHEN level = 0 THEN 'suppressed' WHEN level < 3 THEN 'below_threshold' ELSE 'at_or_above_threshold' END AS state, count(*) AS n FROM a GROUP BY 1")
def verdict_mapping(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(X.verdict(F.expr(_ANSWER), F.expr(_LEVEL), THRESHOLD).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_classified_sql()}, {_FOUND} SELECT finding_key, outcome, event_count, CAST(row_number() OVER (PARTITION BY outcome ORDER BY event_count DESC, finding_key) AS INTEGER) AS place FROM (SELECT *, {_OUTCOME.replace('state', 'observed_status')} AS outcome FROM found)")
def numbered_findings(spark, sf_dir):
    return C.numbered(_found(spark, sf_dir)).select("finding_key", "outcome", "event_count", "place")


# ---- mining --------------------------------------------------------------------------------------------------------


def _mined(spark, sf_dir) -> DataFrame:
    return G.findings(classified(spark, sf_dir))


@query()
def mined_findings(spark, sf_dir):
    """All findings of the derived archive: mined, EventChannel and rule groups together."""
    return _mined(spark, sf_dir)


@query(f"WITH {_classified_sql()} SELECT observed_status, count(*) AS events FROM classified WHERE observed_status <> 'at_or_above_threshold' GROUP BY 1")
def mined_event_total(spark, sf_dir):
    """No event is lost on its way to a finding."""
    return _mined(spark, sf_dir).groupBy("observed_status").agg(F.sum("event_count").alias("events"))


@query()
def mined_template_counts(spark, sf_dir):
    """Templates of the lines of ``documents``."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where("line <> ''").select(X.normalize(F.col("line")).alias("norm")).withColumn("digest", F.md5("norm"))
    assigned = held(G.assign_templates(lines))
    return lines.select("digest").join(assigned, "digest").groupBy("template").agg(F.count(F.lit(1)).alias("n"))


# Messages whose templates follow from how they are made: a user and a small number vary, a long number is masked.
_KNOWN = "concat(event_type, ' by user ', user_id, ' seen from gate ', event_id % 7, ' under id ', event_id + 100000)"
_PART = "CASE WHEN count(DISTINCT {0}) > 1 THEN '<*>' ELSE CAST(min({0}) AS VARCHAR) END"


def _known(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(X.normalize(F.expr(_KNOWN)).alias("norm"))
    rows = e.withColumn("digest", F.md5("norm"))
    return rows.join(held(G.assign_templates(rows)), "digest").groupBy("template").agg(F.count(F.lit(1)).alias("n"))


_KNOWN_SQL = f"SELECT event_type || ' by user ' || {_PART.format('user_id')} || ' seen from gate ' || {_PART.format('event_id % 7')} || ' under id <NUM>' AS template, count(*) AS n FROM events GROUP BY event_type"


@query(_KNOWN_SQL)
def mined_known_templates(spark, sf_dir):
    """The miner's templates of messages of one family an event type."""
    return _known(spark, sf_dir)


@query(f"WITH k AS ({_KNOWN_SQL}) SELECT template, 'pcre2' AS dialect, '^' || replace(replace(template, '<*>', '\\S+'), '<NUM>', '[0-9]{{5,}}') || '$' AS expression FROM k")
def suggested_expressions(spark, sf_dir):
    """Suggested expressions for mined templates."""
    return _known(spark, sf_dir).select("template", regex_suggestion(F.col("template")).alias("s")).select("template", "s.*")


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') || ' ' AS body FROM documents),
d AS (SELECT *, regexp_matches(body, '[\^*+]') AS full_ FROM p)
SELECT doc_id, CASE WHEN full_ THEN 'pcre2' ELSE 'osregex' END AS dialect,
  '^' || CASE WHEN full_ THEN regexp_replace(body, '([\\.^$|?*+()\[\]{}])', '\\\1', 'g') ELSE regexp_replace(body, '([$()\\|<])', '\\\1', 'g') END || '\S+$' AS expression FROM d""")
def expressions_of_texts(spark, sf_dir):
    """Suggested expressions for patterns of any characters: texts on one line, then a wildcard."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pattern = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " "), F.lit(" <*>"))
    return d.select("doc_id", regex_suggestion(pattern).alias("s")).select("doc_id", "s.*")


@query()
def regex_suggestions(spark, sf_dir):
    """A suggested expression for each mined finding."""
    found = _mined(spark, sf_dir).where("observed_status IN ('no_decoder', 'no_alerting_rule') AND coalesce(observed_decoder, '') <> 'windows_eventchannel'")
    return found.select("finding_key", "message_pattern", regex_suggestion(F.col("message_pattern")).alias("s")).select("finding_key", "message_pattern", "s.*")


# ---- files ---------------------------------------------------------------------------------------------------------


def _files(spark, sf_dir, codec: str) -> DataFrame:
    """The lines of :func:`_lines` written as an NDJSON archive of several files, and read as one."""
    at = f"{shared_folder(spark)}/tallylog-archive/{uuid.uuid4().hex}"
    blank = F.explode(F.array("value", F.lit(""), F.lit("  ")))
    _lines(spark, sf_dir).select(blank.alias("value")).write.option("compression", codec).text(at)
    return read_archive(spark, at).groupBy("is_malformed", "agent_id", "rule_level").agg(F.count(F.lit(1)).alias("n"))


_FILES_SQL = f"WITH {_LINES} SELECT event_id % 9 <= 5 AS is_malformed, CASE WHEN event_id % 9 > 5 THEN json_extract_string(value, '$.agent.id') END AS agent_id, CASE WHEN event_id % 9 > 5 THEN CAST(json_extract_string(value, '$.rule.level') AS INTEGER) END AS rule_level, count(*) AS n FROM lines GROUP BY ALL"


@query(_FILES_SQL)
def archive_files(spark, sf_dir):
    """Plain NDJSON files with blank lines between."""
    return _files(spark, sf_dir, "none")


@query(_FILES_SQL)
def archive_files_gzip(spark, sf_dir):
    """The same, compressed."""
    return _files(spark, sf_dir, "gzip")
