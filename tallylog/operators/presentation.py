"""What a report shows of a finding: the archive's fields or the replay's, never a mixture."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from tallylog.schema import OUTCOME_OF, OUTCOMES, Finding, Verification


@dataclass(frozen=True)
class FindingPresentation:
    status: str
    log_type: str | None
    decoder: str | None
    rule_id: str | None
    rule_level: int | None
    rule_description: str | None = None
    replay_error: str | None = None


def state_of(f: Finding, v: Verification | None) -> str:
    """A replay's state stands for the archive's, even where the replay failed."""
    return f.observed_status if v is None else v.effective_state


def present_finding(f: Finding, v: Verification | None) -> FindingPresentation:
    # A failed replay tells why it failed, but nothing of the decoder.
    believed = v is not None and v.effective_state != "unverified"
    decoder = v.decoder if believed else f.observed_decoder
    rule = (v.rule_id, v.rule_level, v.rule_description, v.error) if v else (f.observed_rule_id, f.observed_rule_level)
    return FindingPresentation(state_of(f, v), (believed and decoder) or f.log_type, decoder, *rule)


def outcome_counts(states: dict[str, int]) -> dict[str, int]:
    """Events by outcome, every outcome in order."""
    tally = Counter()
    for s, n in states.items():
        tally[OUTCOME_OF[s]] += n
    return {o: tally[o] for o in OUTCOMES}


def grouped(findings: Iterable[Finding], verifications: Iterable[Verification]) -> dict[str, list[tuple[Finding, Verification | None]]]:
    """The findings of each outcome, largest first."""
    known = {v.finding_key: v for v in verifications}
    pairs = [(f, known.get(f.finding_key)) for f in sorted(findings, key=lambda f: (-f.event_count, f.finding_key))]
    return {o: [(f, v) for f, v in pairs if OUTCOME_OF[state_of(f, v)] == o] for o in OUTCOMES}
