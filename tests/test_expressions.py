import pytest
from pyspark.sql import functions as F

from tallylog.functions import expressions as X
from tallylog.functions.suggest import regex_suggestion, suggest_for_finding, suggest_regex, suggest_rule
from tallylog.schema import Finding, Verification

STAMPS = [
    "2026-07-18T01:02:03Z", "2026-07-18T01:02:03+03:00", "2026-07-18T01:02:03.456-05:00", "2026-07-18T01:02:03,4Z", "2026-07-18T01:02:03", "2026-07-18T01:02:03.9",
    "2026-07-18 01:02:03", "2026-07-18 01:02:03.1", "2026-07-18 01:02:03,1+03:00", "2026-07-18 01:02:03Z", "Jul  8 01:02:03", "Jul 18 01:02:03", "Jul\t8\t01:02:03",
    "18/Jul/2026:01:02:03 +0300", "Sat Jul 18 01:02:03 2026", "Sat Jul  8 01:02:03 2026", "18/07/2026 01:02:03", "18/07/2026 01:02:03.5", "20260718T010203Z", "20260718T010203.25Z",
]
UUID = "550e8400-e29b-41d4-a716-446655440000"
OTHERS = {
    "at 2026-07-18T01:02:03Z done": "at 2026-07-18T01:02:03Z done",
    f"id {UUID} key 0x0011223344556677 n 12345": "id <UUID> key <HEX> n <NUM>",
    "port 8080 ip 10.0.0.1 user bob1 1234": "port 8080 ip 10.0.0.1 user bob1 1234",
    "x_12345 a12345 12345b": "x_12345 a12345 12345b",
    "é12345": "é<NUM>",
    "  padded  ": "padded",
    " nbsp　": "nbsp",
    "\ttab": "\ttab",
    None: "",
    "": "",
    "١٢٣٤٥": "١٢٣٤٥",
    "deadbeefdeadbeef": "<HEX>",
}


def one(spark, f, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values[0])))
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(f(*[F.col(f"c{i}") for i in range(len(values[0]))])).collect()]


def test_normalize(spark):
    assert one(spark, X.normalize, *[(f"{s} rest of it",) for s in STAMPS]) == ["<TIMESTAMP> rest of it"] * len(STAMPS)
    assert one(spark, X.normalize, *[(k,) for k in OTHERS]) == list(OTHERS.values())


def test_casts(spark):
    assert one(spark, X.to_int, *[(v,) for v in ("3.7", "2.5", " 4 ", "+5", "", "true", "99999999999", "1e1", None)]) == [4, 3, 4, 5, None, None, None, 10, None]
    got = one(spark, lambda c: X.shown_time(X.to_timestamp(c)), *[(v,) for v in ("2026-09-18T12:00:00+0300", "2026-09-18T12:00:00Z", "2026-09-18", "12:00", "2026-13-01", "x", None)])
    assert got == ["2026-09-18 09:00:00+00", "2026-09-18 12:00:00+00", "2026-09-18 00:00:00+00", None, None, None, None]


def test_tokens_split_as_the_miner_does(spark):
    texts = ["".join(f"a{chr(c)}b" for c in range(0x3001) if chr(c).isspace()), " x  y ", ""]
    assert one(spark, X.tokens, *[(t,) for t in texts]) == [t.split() for t in texts]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("Failed <*> from <*>", ("osregex", r"^Failed \S+ from \S+$")),
        ("cost $5 (a|b) <x", ("osregex", r"^cost \$5 \(a\|b\) \<x$")),
        ("id <NUM>.", ("pcre2", r"^id [0-9]{5,}\.$")),
        ("a+b <*>", ("pcre2", r"^a\+b \S+$")),
    ],
)
def test_suggest_regex(pattern, want):
    assert suggest_regex(pattern) == want


def test_suggested_timestamp_matches():
    import re

    for s in STAMPS:
        assert re.fullmatch(suggest_regex("<TIMESTAMP> x")[1], f"{s} x")


def finding(**kw):
    base = dict(finding_key="k", observed_status="no_alerting_rule", log_type="t", message_pattern="p <*>", event_count=1, affected_agents=1, first_seen=None, last_seen=None, observed_decoder="sshd", observed_location=None, observed_rule_id=None, observed_rule_level=None, sample_log="s")
    return Finding(**(base | kw))


def test_suggest_for_finding():
    assert suggest_for_finding(finding()) == ("Suggested regex (osregex)", r"^p \S+$")
    assert suggest_for_finding(finding(observed_status="below_threshold")) is None
    assert suggest_for_finding(finding(), Verification("k", "at_or_above_threshold")) is None
    win = finding(observed_decoder="windows_eventchannel", sample_log='{"win":{"system":{"channel":"C&","providerName":"P.x","eventID":"7"}}}')
    assert suggest_for_finding(win) is None
    heading, rule = suggest_for_finding(win, Verification("k", "suppressed", rule_id="61100"))
    assert heading == "Suggested rule (eventchannel)" and "<if_sid>61100</if_sid>" in rule and r"^P\.x$" in rule and "C&amp;: P.x event 7" in rule
    assert suggest_rule('{"win":{"system":{"providerName":"P","eventID":7}}}', "1") is None and suggest_rule("no", "1") is None


def test_suggestions_as_a_column(spark):
    patterns = ["Failed <*> from <*>", "cost $5 (a|b) <x", "id <NUM>.", "a+b <*>", "", "<*>", "<*><TIMESTAMP>x", "a\\b [c] {d} <UUID>-<HEX>", "^x$ é", "<TIMESTAMP"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    assert [tuple(r["s"]) for r in df.select(regex_suggestion(F.col("p")).alias("s")).collect()] == [suggest_regex(p) for p in patterns]
