"""The HTML report: one file without outside resources. Charts are drawn by a few lines of script; tables stand without it."""

from __future__ import annotations

import json
from collections.abc import Iterable
from html import escape

from tallylog.functions.suggest import suggest_for_finding
from tallylog.operators.metrics import calculate_metrics, effective_counts, ordered_types
from tallylog.operators.presentation import grouped, outcome_counts, present_finding
from tallylog.report.text import contributors, percent, rate
from tallylog.schema import FINDING_ORDER, NO_ALERT, OUTCOMES, PART_LABEL, SHORT_OUTCOME, UNALERTED, ArchiveAnalysis, Verification

_STYLE = """
:root{--ink:#1d2733;--soft:#5b6878;--line:#d9dfe6;--page:#f6f8fa;--a:#2f7d4f;--b:#b98a1d;--c:#b3402f;--d:#7a3b86;--e:#6b7684}
body{font:15px/1.5 system-ui,sans-serif;color:var(--ink);background:var(--page);margin:2rem auto;max-width:70rem;padding:0 1rem}
table{border-collapse:collapse;width:100%;background:#fff}th,td{border-bottom:1px solid var(--line);padding:.35rem .6rem;text-align:right}
th:first-child,td:first-child{text-align:left;overflow-wrap:anywhere}.cards{display:flex;gap:1rem;flex-wrap:wrap}
.card{background:#fff;border:1px solid var(--line);border-radius:6px;padding:.7rem 1rem;min-width:10rem}.card b{display:block;font-size:1.5rem}
.part td{color:var(--soft);font-size:.9em}pre{white-space:pre-wrap;overflow-wrap:anywhere;background:#eef1f5;padding:.5rem}
details{background:#fff;border:1px solid var(--line);border-radius:6px;margin:.5rem 0;padding:.4rem .8rem}.soft{color:var(--soft)}
[role=tab][aria-selected=true]{font-weight:bold}.bar{display:flex;height:1.1rem}.bar i{display:block}
"""
_SCRIPT = """
const data=JSON.parse(document.getElementById('data').textContent),tones=['--a','--b','--c','--d','--e'];
const box=document.getElementById('chart');
for(const t of data.log_types){const sum=t.counts.reduce((a,b)=>a+b,0),p=document.createElement('p'),bar=document.createElement('div');
p.textContent=t.name+' ('+sum.toLocaleString()+')';bar.className='bar';
t.counts.forEach((n,i)=>{const x=document.createElement('i');x.style.width=100*n/data.largest+'%';x.style.background='var('+tones[i]+')';x.title=data.outcomes[i]+': '+n;bar.append(x)});
box.append(p,bar)}
const find=document.getElementById('find');find.hidden=false;
find.oninput=()=>{const w=find.value.toLowerCase();for(const d of document.querySelectorAll('details'))d.hidden=!d.textContent.toLowerCase().includes(w)};
const tabs=[...document.querySelectorAll('[role=tab]')];
for(const t of tabs)t.onclick=()=>{for(const o of tabs){o.setAttribute('aria-selected',o===t);document.getElementById(o.dataset.for).hidden=o!==t}};
document.getElementById('tabs').hidden=false;tabs[0].click();
"""


def safe_json(value) -> str:
    """JSON that no parser of HTML can leave."""
    out = json.dumps(value, ensure_ascii=True, separators=(",", ":"))
    for c in "&<>":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def _table(head: list[str], rows: list[tuple[str, list[str]]]) -> str:
    cells = lambda tag, xs: "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in xs)
    return f"<table><thead><tr>{cells('th', head)}</tr></thead><tbody>" + "".join(f"<tr{kind}>{cells('td', xs)}</tr>" for kind, xs in rows) + "</tbody></table>"


def render_html_report(analysis: ArchiveAnalysis, verifications: Iterable[Verification] = (), *, alert_threshold: int | None = None, threshold_source: str | None = None) -> str:
    verifications = tuple(verifications)
    s = calculate_metrics(analysis, verifications)
    states, types = effective_counts(analysis, verifications)
    total = analysis.total_events
    cards = "".join(
        f'<div class="card">{escape(label)}<b>{rate(m) if m.available else "Unavailable"}</b><span class="soft">{f"{m.count:,} / {m.denominator:,}" if m.available else "needs a complete replay"}</span></div>'
        for label, m in (("Malformed input", s.malformed_rate), ("Decoder failure", s.decoder_failure_rate), ("Uncovered", s.uncovered_rate), ("Below threshold", s.below_threshold_rate), ("Not verified", s.uncertainty_rate))
    )
    rows: list[tuple[str, list[str]]] = []
    for o, n in outcome_counts(states).items():
        rows.append(("", [o, f"{n:,}", percent(n, total)]))
        if o == NO_ALERT:
            rows += [(' class="part"', [PART_LABEL[x], f"{states.get(x, 0):,}", percent(states.get(x, 0), total)]) for x in UNALERTED]
    each = [(name or "-", list(outcome_counts(c).values()), n) for name, c, n in ordered_types(types)]
    type_rows = [("", [name, f"{n:,}", percent(n, total), *[f"{x:,}" for x in c]]) for name, c, n in each]
    tops = ""
    for label, name in (("Decoder failure", "decoder_failure"), ("Uncovered", "uncovered"), ("Below threshold", "below_threshold")):
        if top := contributors(s, name, 10):
            tops += f"<h3>{label}</h3>" + _table(["Log type", "Events", "Local rate", "Contribution"], [("", [t or "-", f"{m.count:,}", rate(m), rate(c)]) for t, m, c in top])
    lists, tabs, panels = grouped(analysis.findings, verifications), "", ""
    for i, o in enumerate(x for x in FINDING_ORDER if lists[x]):
        tabs += f'<button role="tab" data-for="list{i}" aria-selected="false">{escape(o)} ({len(lists[o]):,})</button> '
        panels += f'<section id="list{i}"><h3>{escape(o)}</h3>'
        for place, (f, v) in enumerate(lists[o], 1):
            p = present_finding(f, v)
            facts = [("Affected agents", f"{f.affected_agents:,}"), ("First seen", f.first_seen or "-"), ("Last seen", f.last_seen or "-"), ("Decoder", p.decoder or "-"), ("Rule", p.rule_id), ("Level", p.rule_level), ("Matched", p.rule_description), ("Replay", p.replay_error)]
            panels += f"<details><summary>[{place}] {escape(p.status)} | {escape(p.log_type or '-')} | {f.event_count:,} events</summary><p>" + "<br>".join(f"{k}: {escape(str(x))}" for k, x in facts if x is not None) + f"</p><pre>{escape(f.message_pattern)}</pre>"
            if suggestion := suggest_for_finding(f, v):
                panels += f"<p>{escape(suggestion[0])}</p><pre>{escape(suggestion[1])}</pre>"
            panels += f"<p>Sample</p><pre>{escape(f.sample_log)}</pre></details>"
        panels += "</section>"
    chart = sorted(each, key=lambda r: (-r[2], r[0]))[:20]
    data = safe_json({"outcomes": list(OUTCOMES), "largest": max([n for _, _, n in chart], default=1), "log_types": [{"name": t, "counts": c} for t, c, _ in chart]})
    threshold = "" if alert_threshold is None else f"<p>Alert threshold: {alert_threshold}" + (f" ({escape(threshold_source)})" if threshold_source else "") + "</p>"
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Coverage of {escape(str(analysis.path))}</title><style>{_STYLE}</style></head><body><h1>Log coverage</h1><p>Archive: {escape(str(analysis.path))}</p>{threshold}'
        f"<p>Total events: {total:,}. Malformed lines skipped: {analysis.malformed_lines:,}.</p><div class=\"cards\">{cards}</div><h2>Outcome</h2>{_table(['Outcome', 'Events', '% total'], rows)}<h2>Log types</h2><div id=\"chart\"></div>"
        f"{_table(['Log type', 'Events', '% total', *SHORT_OUTCOME.values()], type_rows)}<h2>Largest contributors</h2>{tops or '<p>None.</p>'}<h2>Findings: {len(analysis.findings):,}</h2><input id=\"find\" placeholder=\"Search findings\" hidden>"
        f'<div id="tabs" role="tablist" hidden>{tabs}</div>{panels}<script type="application/json" id="data">{data}</script><script>{_SCRIPT}</script></body></html>\n'
    )
