import random

import corpus_pipeline
from tallylog.llm import op5_simhash
from tallylog.llm import similar as m


def words(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def alike(a, b):
    a, b = words(a), words(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def smallest_of_each(rows):
    keep, left = set(), dict(rows)
    while left:
        group = [min(left)]
        keep.add(group[0])
        left_text = {group[0]: left.pop(group[0])}
        while group:
            t = left_text[group.pop()]
            for i in [i for i, x in left.items() if alike(t, x)]:
                left_text[i] = left.pop(i)
                group.append(i)
    return keep


def test_near_dedup_takes_a_similarity_of_four_fifths(spark, docs_of):
    r = random.Random(3)
    rows, texts = [], []
    for _ in range(6):
        base = ["w%d" % r.randrange(5000) for _ in range(150)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5):  # similarities around 0.8, and chains of them
            copy = list(base)
            for i in r.sample(range(150), edits):
                copy[i] = "x%d" % r.randrange(5000)
            texts.append(" ".join(copy))
            base = copy if edits == 3 else base
    r.shuffle(texts)
    rows = list(enumerate(texts)) + [(90, ""), (91, None), (92, "a b"), (93, "A  b"), (94, "a c")]
    docs = docs_of(rows + [(None, "no id here"), (3, texts[3])])
    want = smallest_of_each(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = [x["doc_id"] for x in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert {x["doc_id"] for x in op5_simhash.one_of_each(docs_of(rows)).collect()} > want
    assert m.one_of_similar(docs.limit(0)).count() == 0


def test_fingerprints_link_by_themselves(spark, docs_of, monkeypatch):
    """Without a single band, near copies whose fingerprints lie within op5's bits still go; the sets decide on each link."""
    from pyspark.sql import functions as F

    signed = m._signed
    monkeypatch.setattr(m, "_signed", lambda docs, size: signed(docs, size).withColumn("bands", F.array().cast("array<long>")))
    r = random.Random(4)
    base = [" ".join("w%d" % r.randrange(5000) for _ in range(600)) for _ in range(8)]
    rows = list(enumerate(base + [t + " tail" for t in base] + ["", "a b"]))
    prints = op5_simhash.simhash([t for _, t in rows], 5)
    close = [i for i in range(8) if bin(int(prints[i] ^ prints[i + 8]) & (1 << 64) - 1).count("1") <= op5_simhash.MAX_BITS]
    assert close
    got = {x["doc_id"] for x in op5_simhash.one_of_near_copies(docs_of(rows)).collect()}
    assert got == set(range(18)) - {i + 8 for i in close}


def test_a_large_family_below_the_line_is_not_compared_pair_by_pair(spark, docs_of, monkeypatch):
    """Copies of one text with edits of their own: few pairs are similar, and candidates grow with the members, not their square."""
    verified, seen = m._verified, []

    def counted(pairs, sets):
        seen.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(m, "_verified", counted)
    r = random.Random(6)
    base, texts = ["w%d" % r.randrange(5000) for _ in range(150)], []
    for i in range(160):
        copy = list(base)
        for at in r.sample(range(150), 1 + i % 2 if i < 12 else r.randint(5, 7)):
            copy[at] = "x%d" % r.randrange(10**6)
        texts.append(" ".join(copy[: 150 - i % 3]))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x["doc_id"] for x in op5_simhash.one_of_near_copies(docs_of(rows)).collect()}
    assert got == smallest_of_each(rows)
    assert sum(seen) < 40 * len(rows)


def generated(spark, run):
    """The result of ``run``, and the most rows that a single Generate of its Spark jobs made."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ids, most = [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())], 0
    for i in set(ids) - done:
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if node.name() == "Generate" and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return out, most


def family(seed, members):
    r = random.Random(seed)
    base, texts = ["w%d" % r.randrange(5000) for _ in range(150)], []
    for i in range(members):
        copy = list(base)
        for at in r.sample(range(150), 1 + i % 2 if i < 12 else r.randint(5, 7)):
            copy[at] = "x%d" % r.randrange(10**6)
        texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_a_large_family_is_not_laid_out_shingle_by_shingle(spark, docs_of):
    """A fifth of a member's shingles and one more become rows: fewer than its bands here, where it has 146 shingles."""
    rows = family(7, 80)
    got, made = generated(spark, lambda: {x["doc_id"] for x in op5_simhash.one_of_near_copies(docs_of(rows)).collect()})
    assert got == smallest_of_each(rows)
    assert made <= m.BANDS * len(rows)


def test_any_order_of_shingles_gives_the_same_components(spark, docs_of, monkeypatch):
    """With one bucket for all shingles the order tells nothing of how rare they are, and no result changes."""
    monkeypatch.setattr(m, "BUCKETS", 1)
    monkeypatch.setattr(m, "PARTS", 1)
    rarity, seen = m._rarity, []
    monkeypatch.setattr(m, "_rarity", lambda have: seen.append(rarity(have)) or seen[-1])
    rows = family(8, 80)
    assert {x["doc_id"] for x in op5_simhash.one_of_near_copies(docs_of(rows)).collect()} == smallest_of_each(rows)
    assert [len(x) for x in seen] == [1] and seen[0][0] > 32 * 100
