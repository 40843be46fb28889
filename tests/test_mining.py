import random

import pytest
from helpers import event, write
from pyspark.sql import functions as F

from tallylog.operators.miner import MinerConfig, TemplateMiner, mine_all
from tallylog.operators.mining import mine
from tallylog.plans.analysis import analyze_archive


def corpus(seed, n=600):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        u, p, h = f"user{rng.randrange(40)}", rng.randrange(1, 65000), rng.choice("alpha beta gamma delta".split())
        out.append(rng.choice([f"Failed password for {u} from 10.0.0.{p % 250} port {p}", f"Accepted password for {u} from {h}", f"session opened for {u} by {h} at tty{p % 9}", f"kernel usb {p} device {h} attached", f"{h} {u} {p} restarted service {h}", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9)))]))
    return out


def test_variants_collapse_and_families_stay_apart():
    got = mine_all(["login of anna from hostone ok now", "login of bert from hosttwo ok now", "usb device new high speed found"])
    assert got["login of anna from hostone ok now"] == got["login of bert from hosttwo ok now"] == "login of <*> from <*> ok now"
    assert len(set(got.values())) == 2


@pytest.mark.parametrize("cap", [20_000, 7])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_gives_what_a_full_search_gives(seed, cap):
    texts = corpus(seed)
    assert mine_all(texts, MinerConfig(max_clusters=cap)) == mine_all(texts, MinerConfig(max_clusters=cap, indexed=False))


def test_index_saves_comparisons():
    a, b = TemplateMiner(), TemplateMiner(MinerConfig(indexed=False))
    for i in range(300):
        for m in (a, b):
            m.add("x " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "pqrst"))
    assert a.comparisons == 0 and b.comparisons == 300 * 299 // 2


def test_eviction_keeps_every_message():
    got = mine_all(["a", "b c", "d e f"], MinerConfig(max_clusters=1))
    assert got == {"a": "a", "b c": "b c", "d e f": "d e f"}


def test_empty_message():
    assert mine_all([""]) == {"": ""}


@pytest.mark.parametrize("config", [MinerConfig(), MinerConfig(depth=5), MinerConfig(max_children=4)])
def test_parallel_feed_equals_one_miner(spark, config):
    texts = sorted(set(corpus(5) + [f"9lead {x} one two" for x in "abcd"] + ["é ü ß", " ", ""]))
    df = spark.createDataFrame([(t,) for t in texts], "norm string").withColumn("digest", F.md5("norm"))
    one = mine_all(texts, config)
    for parallel in (True, False):
        got = {r["norm"]: r["template"] for r in df.join(mine(df, config, parallel), "digest").collect()}
        assert got == one


def test_archive_keeps_every_event(spark, tmp_path):
    rows = [event(t, agent=str(i % 5)) for i, t in enumerate(corpus(9, 300))] + [event('a, "b"\r\nc'), event("x" * 32_766)]
    a = analyze_archive(write(tmp_path / "m.json", rows), spark=spark)
    assert sum(f.event_count for f in a.findings) == len(rows)
    b = analyze_archive(write(tmp_path / "m2.json", rows[::-1]), spark=spark)
    assert a.findings == b.findings


def test_ssh_failures_are_one_finding(spark, tmp_path):
    rows = [event(f"Failed password for user{i} from 192.0.2.{i} port 5{i}000 ssh2", agent=str(i)) for i in range(5)]
    (f,) = analyze_archive(write(tmp_path / "s.json", rows), spark=spark).findings
    assert f.event_count == 5 and f.affected_agents == 5 and "<*>" in f.message_pattern


FAMILIES = {
    "logon": lambda r: f"An account {r.choice('abcdef')}x was successfully logged on from host{r.randrange(99)} process svc",
    "fail": lambda r: f"Logon failure for account {r.choice('abcdef')}x from host{r.randrange(99)} bad password given",
    "accept": lambda r: f"fw action accept src 10.0.{r.randrange(9)}.{r.randrange(99)} dst 10.1.1.{r.randrange(99)} proto tcp",
    "drop": lambda r: f"fw action drop reason policy src 10.0.{r.randrange(9)}.{r.randrange(99)} dst 10.1.1.{r.randrange(99)}",
    "copy": lambda r: f"backup copied file /data/{r.randrange(999)}/x to vault{r.randrange(9)} without errors",
}


@pytest.mark.parametrize("seed", [11, 23, 42])
def test_labelled_families_are_pure(seed):
    r = random.Random(seed)
    label = {make(r): name for name, make in FAMILIES.items() for _ in range(120)}
    seen: dict[str, set[str]] = {}
    for m, t in mine_all(label).items():
        seen.setdefault(t, set()).add(label[m])
    assert all(len(s) == 1 for s in seen.values()) and len(seen) <= 3 * len(FAMILIES)


def test_sweep_of_depth_and_similarity(spark):
    from tallylog.operators.tuning import Trial, best, sweep, trial

    r = random.Random(7)
    label = {make(r): name for name, make in FAMILIES.items() for _ in range(60)}
    rows = [Trial(*x) for x in sweep(spark, label, (4, 5), (0.3, 0.56, 0.95)).collect()]
    assert len(rows) == 6 and trial(label, MinerConfig()) in rows
    strict = next(x for x in rows if x.similarity == 0.95 and x.depth == 4)
    chosen = best(rows)
    assert strict.templates > chosen.templates and not chosen.mixed and strict.split >= chosen.split


def test_hot_groups_are_mined_in_parts(spark):
    """Groups of more messages than a miner keeps: the families' templates come out of the parts as one each."""
    texts = sorted({f"w{i} logged in from host{i * 7 % 1000} with key {c}" for i in range(900) for c in "ab"})
    df = spark.createDataFrame([(t,) for t in texts], "norm string").withColumn("digest", F.md5("norm"))
    got = df.join(mine(df, MinerConfig(max_clusters=200)), "digest").select("norm", "template").collect()
    assert sorted(r["norm"] for r in got) == texts and {r["template"] for r in got} == {"<*> logged in from <*> with key <*>"}
    # Messages without any common shape stay apart, and none is lost.
    odd = sorted({" ".join(f"{c}{i}" for c in "pqrst") for i in range(700)})
    df = spark.createDataFrame([(t,) for t in odd], "norm string").withColumn("digest", F.md5("norm"))
    assert {(r["digest"], r["template"]) for r in mine(df, MinerConfig(max_clusters=100)).collect()} == {(r["digest"], r["norm"]) for r in df.collect()}
