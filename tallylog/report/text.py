"""The plain-text report of one archive."""

from __future__ import annotations

from collections.abc import Iterable

from tallylog.functions.suggest import suggest_for_finding
from tallylog.operators.metrics import calculate_metrics, effective_counts, ordered_types
from tallylog.operators.presentation import grouped, outcome_counts, present_finding
from tallylog.schema import EFFECTIVE_STATES, FINDING_ORDER, NO_ALERT, OUTCOMES, PART_LABEL, SHORT_OUTCOME, UNALERTED, ArchiveAnalysis, Finding, MetricSnapshot, MetricValue, Verification

# Column widths.
_LABEL, _TYPE, _COUNT, _PERCENT = 24, 32, 14, 10


def percent(part: int, whole: int) -> str:
    return f"{100.0 * part / whole if whole else 0.0:.2f}%"


def rate(m: MetricValue) -> str:
    return "n/a" if m.ratio is None else f"{m.ratio * 100.0:.2f}%"


def _line(*cells: tuple[str, int]) -> str:
    """Cells side by side: the first to the left of its width, the others to the right."""
    (first, width), *rest = cells
    return (f"{first:<{width}}" + "".join(f"{c:>{w}}" for c, w in rest)).rstrip()


def _title(text: str) -> list[str]:
    return ["", text, "-" * len(text)]


def single_row(text: str) -> str:
    return text.replace("\n", " ").replace("\r", " ").strip()


def outcome_table(states: dict[str, int], total: int) -> list[str]:
    width = max(_LABEL, max(map(len, OUTCOMES)) + 2)
    row = lambda label, n: _line((label, width), (f"{n:,}", _COUNT), (percent(n, total), _PERCENT))
    out = [*_title("Outcome"), _line(("Outcome", width), ("Events", _COUNT), ("% total", _PERCENT))]
    for outcome, n in outcome_counts(states).items():
        out.append(row(outcome, n))
        if outcome == NO_ALERT:
            out += [row(f"  {PART_LABEL[s]}", states.get(s, 0)) for s in UNALERTED]
    return out


def log_type_table(types: dict, total: int) -> list[str]:
    widths = [max(12, len(SHORT_OUTCOME[o]) + 2) for o in OUTCOMES]
    row = lambda label, n, share, cells: _line((label, _TYPE), (n, _COUNT), (share, _PERCENT), *zip(cells, widths, strict=True))
    out = [*_title("Log types"), row("Log type", "Events", "% total", SHORT_OUTCOME.values())]
    for name, states, n in ordered_types(types):
        out.append(row(name or "-", f"{n:,}", percent(n, total), [f"{c:,}" for c in outcome_counts(states).values()]))
    return out


def metrics_table(s: MetricSnapshot) -> list[str]:
    out = [*_title("Metrics"), _line(("Metric", _LABEL), ("Count / denominator", 24), ("Rate", 12))]
    for label, m in (("Malformed input", s.malformed_rate), ("Decoder failure", s.decoder_failure_rate), ("Uncovered", s.uncovered_rate), ("Below threshold", s.below_threshold_rate), ("Not verified", s.uncertainty_rate)):
        out.append(_line((label, _LABEL), (f"{m.count:,} / {m.denominator:,}", 24), (rate(m), 12)) if m.available else f"{label:<{_LABEL}}unavailable without complete replay")
    return out


def contributors(s: MetricSnapshot, name: str, k: int) -> list[tuple]:
    """(log type, local metric, contribution) of the ``k`` largest contributors to a metric."""
    rows = [(t.log_type, getattr(t, f"{name}_rate"), getattr(t, f"{name}_contribution")) for t in s.log_types]
    rows = [r for r in rows if r[1].available and r[1].count and r[2].available and r[2].ratio is not None]
    return sorted(rows, key=lambda r: (-r[2].ratio, -r[1].count, r[0] or ""))[:k]


def contributor_list(s: MetricSnapshot) -> list[str]:
    out: list[str] = []
    for label, name in (("Decoder failure", "decoder_failure"), ("Uncovered", "uncovered"), ("Below threshold", "below_threshold")):
        rows = contributors(s, name, 3)
        if rows:
            out += [*([] if out else _title("Largest metric contributors")), label]
            out += [f"  {t or '-'}: {local.count:,} events | local {rate(local)} | contribution {rate(share)}" for t, local, share in rows]
    return out


def coverage_table(analysis: ArchiveAnalysis, verifications: tuple[Verification, ...]) -> list[str]:
    if not verifications:
        return []
    known, events, count = {v.finding_key: v.effective_state for v in verifications}, dict.fromkeys(EFFECTIVE_STATES, 0), dict.fromkeys(EFFECTIVE_STATES, 0)
    for f in analysis.findings:
        if state := known.get(f.finding_key):
            events[state] += f.event_count
            count[state] += 1
    total = sum(events.values())
    out = [*_title("Effective coverage (replay)"), _line(("State", _LABEL), ("Findings", 12), ("Events", _COUNT), ("% replayed", 12))]
    return out + [_line((s, _LABEL), (f"{count[s]:,}", 12), (f"{events[s]:,}", _COUNT), (percent(events[s], total), 12)) for s in EFFECTIVE_STATES if count[s]]


def finding_block(place: int, f: Finding, v: Verification | None) -> list[str]:
    p = present_finding(f, v)
    out = [f"[{place}] {p.status} | {p.log_type or '-'}"]
    pairs = [("Events", f"{f.event_count:,}"), ("Affected agents", f"{f.affected_agents:,}"), ("First seen", f.first_seen or "-"), ("Last seen", f.last_seen or "-"), ("Decoder", p.decoder or "-")]
    pairs += [(k, x) for k, x in (("Rule", p.rule_id), ("Level", p.rule_level)) if x is not None]
    pairs.append(("Pattern", single_row(f.message_pattern)))
    if suggestion := suggest_for_finding(f, v):
        pairs.append((suggestion[0], single_row(suggestion[1])))
    pairs.append(("Sample", f.sample_log))
    pairs += [(k, single_row(x)) for k, x in (("Matched", p.rule_description), ("Replay", p.replay_error)) if x]
    return out + [f"    {k}: {x}" for k, x in pairs]


def render_report(analysis: ArchiveAnalysis, verifications: Iterable[Verification] = (), *, alert_threshold: int | None = None, threshold_source: str | None = None) -> str:
    verifications = tuple(verifications)
    out = [f"Archive: {analysis.path}"]
    if alert_threshold is not None:
        out.append(f"Alert threshold: {alert_threshold}" + (f" ({threshold_source})" if threshold_source else ""))
    out += [f"Total events: {analysis.total_events:,}", f"Malformed lines skipped: {analysis.malformed_lines:,}"]
    states, types = effective_counts(analysis, verifications)
    snapshot = calculate_metrics(analysis, verifications)
    out += outcome_table(states, analysis.total_events) + log_type_table(types, analysis.total_events) + metrics_table(snapshot) + contributor_list(snapshot) + coverage_table(analysis, verifications)
    out += ["", f"Findings: {len(analysis.findings):,}", ""]
    lists = grouped(analysis.findings, verifications)
    for outcome in FINDING_ORDER:
        if lists[outcome]:
            out += [outcome, "-" * len(outcome)]
            for i, (f, v) in enumerate(lists[outcome], 1):
                out += [*finding_block(i, f, v), ""]
    return "\n".join(out).rstrip() + "\n"
