import pytest
from helpers import event, write

from tallylog.plans.analysis import analyze_archive
from tallylog.schema import STATUSES


def run(spark, tmp_path, rows, name="a.json", **kw):
    return analyze_archive(write(tmp_path / name, rows), spark=spark, **kw)


BASE = [
    event("connection from host id 12345", agent="001"),
    event("connection from host id 67890", agent="002"),
    event("unmatched text", "sshd", location="syslog"),
    event("low level text", "sshd", "100", 2, location="syslog"),
    event("alert text", "sshd", "101", 5, location="syslog"),
]


def test_base_archive(spark, tmp_path):
    a = run(spark, tmp_path, BASE)
    assert a.total_events == 5 and a.malformed_lines == 0
    assert {s.status: s.event_count for s in a.status_counts} == {"no_decoder": 2, "no_alerting_rule": 1, "below_threshold": 1, "at_or_above_threshold": 1}
    assert sum(s.percentage for s in a.status_counts) == pytest.approx(100)
    first = a.findings[0]
    assert (first.observed_status, first.event_count, first.affected_agents, first.message_pattern) == ("no_decoder", 2, 2, "connection from host id <NUM>")
    assert first.sample_log == "connection from host id 12345" and first.first_seen == "2026-09-18 09:00:00+00"
    assert sum(f.event_count for f in a.findings) == 4


def test_gzip_is_the_same(spark, tmp_path):
    a, b = run(spark, tmp_path, BASE), run(spark, tmp_path, BASE, "a.json.gz")
    assert (a.status_counts, a.log_type_counts, a.findings) == (b.status_counts, b.log_type_counts, b.findings)


@pytest.mark.parametrize(
    ("lines", "total", "bad"),
    [
        ([event(), "{not-json}"], 1, 1),
        (["{not-json}", "null"], 0, 2),
        ([event(), "", "   ", "null", "[1]", '"s"', "12"], 1, 4),
        ([event(), '{"a":1} x', '{"a":1}{"b":2}', "{'a':1}"], 1, 3),
    ],
)
def test_malformed_lines(spark, tmp_path, lines, total, bad):
    a = run(spark, tmp_path, lines)
    assert (a.total_events, a.malformed_lines) == (total, bad)


def test_strict_raises(spark, tmp_path):
    with pytest.raises(Exception, match="not a JSON object"):
        run(spark, tmp_path, [event(), "{not-json}"], skip_malformed=False)


def test_empty_file_and_bad_arguments(spark, tmp_path):
    a = run(spark, tmp_path, [])
    assert [s.status for s in a.status_counts] == list(STATUSES) and a.total_events == 0 and a.findings == ()
    with pytest.raises(FileNotFoundError):
        analyze_archive(tmp_path / "none.json", spark=spark)
    with pytest.raises(ValueError):
        analyze_archive(write(tmp_path / "b.json", [event()]), alert_threshold=-1, spark=spark)


def test_sample_fields_come_from_one_event(spark, tmp_path):
    rows = [event("same words here b", "d", location="L1"), event("same words here a", "d", location="L9"), event("same words here a", "d", location="L2")]
    (f,) = run(spark, tmp_path, rows).findings
    assert (f.sample_log, f.observed_location, f.event_count) == ("same words here a", "L2", 3)


def test_below_threshold_groups_by_rule_alone(spark, tmp_path):
    rows = [event("one", "a", "7", 1, location="x"), event("two", "b", "7", 2, location="y"), event("three", "b", "8", "bad")]
    found = {f.message_pattern: f for f in run(spark, tmp_path, rows).findings}
    assert found["rule:7"].event_count == 2 and found["rule:7"].log_type is None and found["rule:7"].observed_location is None
    assert found["rule:8"].observed_rule_level is None


def test_keys_are_not_confused_by_delimiters(spark, tmp_path):
    a = run(spark, tmp_path, [event("c", location="a|b"), event("b|c", location="a")])
    assert len({f.finding_key for f in a.findings}) == 2


def test_line_breaks_in_samples(spark, tmp_path):
    (f,) = run(spark, tmp_path, [event("  a\r\n\r\nb\tc ")]).findings
    assert f.sample_log == "a b\tc"


def test_times_across_zones(spark, tmp_path):
    rows = [event("x", at="2026-09-18T12:00:00+0300"), event("x", at="2026-09-18T10:30:00.250+00:00"), event("x", at="12:00")]
    (f,) = run(spark, tmp_path, rows).findings
    assert (f.first_seen, f.last_seen, f.event_count) == ("2026-09-18 09:00:00+00", "2026-09-18 10:30:00+00", 3)


def test_no_log_no_finding(spark, tmp_path):
    a = run(spark, tmp_path, [event(""), event(None), event("x")])
    assert a.total_events == 3 and [f.event_count for f in a.findings] == [1]


def record(provider="P", channel="C", event_id="4624", n=0):
    system = {"channel": channel, "providerName": provider, "eventID": event_id, "systemTime": str(n)}
    import json

    return json.dumps({"win": {"system": {k: v for k, v in system.items() if v is not None}}})


def test_eventchannel_records_group_by_their_key(spark, tmp_path):
    d = "windows_eventchannel"
    rows = [event(record(n=i), d) for i in range(5)] + [event(record(event_id="4625", n=i), d) for i in range(3)] + [event(record(event_id="7036"), d)]
    rows += [event('{"win":{"system":{"message":"m"}}}', d), event('{"win":{"system":{}}}', d), event("no json at all", d)]
    found = {f.message_pattern: f.event_count for f in run(spark, tmp_path, rows).findings}
    assert found == {"channel=C provider=P eventID=4624": 5, "channel=C provider=P eventID=4625": 3, "channel=C provider=P eventID=7036": 1, "EventChannel event without an XML payload": 2, "no json at all": 1}


def test_duplicate_keys_and_bare_returns(spark, tmp_path):
    a = run(spark, tmp_path, ['{"full_log":"a","full_log":"b"}\r'])
    assert (a.total_events, a.malformed_lines) == (1, 0) and a.findings[0].sample_log == "a"
