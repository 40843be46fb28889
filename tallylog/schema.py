"""Row types, closed vocabularies and Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import types as T

# ---- fixed values: the closed vocabularies ---------------------------------------------------------------------------

STATUSES = ("no_decoder", "no_alerting_rule", "below_threshold", "at_or_above_threshold")
EFFECTIVE_STATES = ("no_decoder", "uncovered", "suppressed", "below_threshold", "at_or_above_threshold", "unverified")
REPLAYABLE = ("no_decoder", "no_alerting_rule")
UNALERTED = ("suppressed", "below_threshold")
ALERTED, NO_ALERT, NO_RULE, NO_DECODER, NOT_VERIFIED = "Rule matched, alerted", "Rule matched, no alert", "No rule", "No decoder", "Not verified"
#: In the order of tables, from an alert down to no verdict.
OUTCOMES = (ALERTED, NO_ALERT, NO_RULE, NO_DECODER, NOT_VERIFIED)
#: In the order of the findings list, what can be acted on first.
FINDING_ORDER = (NO_RULE, NO_DECODER, NO_ALERT, ALERTED, NOT_VERIFIED)
OUTCOME_OF = {
    "at_or_above_threshold": ALERTED,
    "suppressed": NO_ALERT,
    "below_threshold": NO_ALERT,
    "uncovered": NO_RULE,
    "no_decoder": NO_DECODER,
    "no_alerting_rule": NOT_VERIFIED,
    "unverified": NOT_VERIFIED,
}
SHORT_OUTCOME = {ALERTED: "Alerted", NO_ALERT: "No alert", NO_RULE: "No rule", NO_DECODER: "No decoder", NOT_VERIFIED: "Not verified"}
PART_LABEL = {"suppressed": "level 0", "below_threshold": "below threshold"}
DEFAULT_THRESHOLD = 3
EVENTCHANNEL_DECODER = "windows_eventchannel"
NO_PAYLOAD = "EventChannel event without an XML payload"

# ---- the events relation ---------------------------------------------------------------------------------------------

#: (column, JSON path, type) of what is read from each record, and nothing else.
EVENT_FIELDS = (
    ("event_timestamp", "$.timestamp", "timestamp"),
    ("agent_id", "$.agent.id", "string"),
    ("agent_name", "$.agent.name", "string"),
    ("location", "$.location", "string"),
    ("full_log", "$.full_log", "string"),
    ("program_name", "$.predecoder.program_name", "string"),
    ("decoder_name", "$.decoder.name", "string"),
    ("decoder_parent", "$.decoder.parent", "string"),
    ("rule_id", "$.rule.id", "string"),
    ("rule_level", "$.rule.level", "int"),
    ("rule_description", "$.rule.description", "string"),
)
EVENTS = T.StructType([T.StructField("is_malformed", T.BooleanType(), False), *[T.StructField(n, {"timestamp": T.TimestampType(), "string": T.StringType(), "int": T.IntegerType()}[t]) for n, _, t in EVENT_FIELDS]])

# ---- results; fixed values: the names of their fields, which callers read ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class StatusCount:
    status: str
    event_count: int
    percentage: float


@dataclass(frozen=True)
class LogTypeCount:
    status: str
    log_type: str | None
    event_count: int
    percentage: float
    status_percentage: float


@dataclass(frozen=True)
class Finding:
    finding_key: str
    observed_status: str
    log_type: str | None
    message_pattern: str
    event_count: int
    affected_agents: int
    first_seen: str | None
    last_seen: str | None
    observed_decoder: str | None
    observed_location: str | None
    observed_rule_id: str | None
    observed_rule_level: int | None
    sample_log: str


@dataclass(frozen=True)
class Verification:
    finding_key: str
    effective_state: str
    replay_status: str | None = None
    decoder: str | None = None
    rule_id: str | None = None
    rule_level: int | None = None
    rule_description: str | None = None
    rule_groups: tuple[str, ...] = ()
    error: str | None = None


@dataclass(frozen=True)
class ArchiveAnalysis:
    path: Path
    total_events: int
    malformed_lines: int
    status_counts: tuple[StatusCount, ...]
    log_type_counts: tuple[LogTypeCount, ...]
    findings: tuple[Finding, ...]


@dataclass(frozen=True)
class MetricValue:
    count: int | None
    denominator: int | None
    ratio: float | None
    available: bool


@dataclass(frozen=True)
class LogTypeMetrics:
    log_type: str | None
    event_count: int
    decoder_failure_rate: MetricValue
    decoder_failure_contribution: MetricValue
    uncovered_rate: MetricValue
    uncovered_contribution: MetricValue
    below_threshold_rate: MetricValue
    below_threshold_contribution: MetricValue


@dataclass(frozen=True)
class MetricSnapshot:
    total_events: int
    malformed_lines: int
    malformed_rate: MetricValue
    decoder_failure_rate: MetricValue
    uncovered_rate: MetricValue
    below_threshold_rate: MetricValue
    uncertainty_rate: MetricValue
    log_types: tuple[LogTypeMetrics, ...]
