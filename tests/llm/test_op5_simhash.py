import random
import re

import numpy as np
import pytest
import xxhash

from tallylog.llm import op5_simhash as m


def fingerprint(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    sh = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(prints):
    """doc -> smallest doc reachable, by union over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    r = random.Random(1)
    texts = [None, "", "  \n", "One", "a b c", "a B c d", "É é x y z z z z z"] + [" ".join(r.choice("a bb CCC d é".split()) for _ in range(r.randrange(1, 300))) for _ in range(60)]
    assert [x & (1 << 64) - 1 for x in m.simhash(texts).tolist()] == [fingerprint(t) for t in texts]


def test_same_hash_as_the_engine(spark):
    from pyspark.sql import functions as F

    t = "drei wörter hier"
    assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] == np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)


@pytest.mark.parametrize("hot", [4])
def test_components_of_close_fingerprints(spark, hot):
    r = random.Random(hot)
    seeds = [r.getrandbits(64) for _ in range(6)]
    prints = []
    for s in seeds:  # chains and stars within and just beyond 4 bits
        for _ in range(8):
            prints.append(s)
            for b in r.sample(range(64), r.choice([1, 2, 3, 4, 5])):
                s ^= 1 << b
    prints += [0, 1, 0b11111]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint long")
    from tallylog.llm.common import connected_components

    got = {x["node"]: x["component"] for x in connected_components(m.links(df, hot_key=hot)).collect()}
    want = labels(prints)
    groups = {}
    for p, w in zip(prints, want, strict=True):
        k = int(np.uint64(p).astype(np.int64))
        groups.setdefault(w, set()).add(got.get(k, k))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_whole_operator(spark, docs_of):
    r = random.Random(8)
    base = [" ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(200)) for _ in range(4)]
    rows = [(i, base[i % 4] if i % 3 else base[i % 4] + " more words") for i in range(24)] + [(30, None), (31, ""), (None, "alone text here now"), (5, base[1]), (40, "x " * 20_000)]
    docs = docs_of(rows)
    got = m.components(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted((x for x in rows if x[0] is not None), key=lambda x: x[0])
    prints = [fingerprint(t) for _, t in ordered]
    want = {(d, p): ordered[w][0] for (d, _), p, w in zip(ordered, prints, labels(prints), strict=True)}
    for x in got:
        if x["doc_id"] is not None:
            assert x["component_id"] == want[x["doc_id"], x["fingerprint"] & (1 << 64) - 1]
    kept = m.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted(set(want.values())) and kept.where("doc_id IS NULL").count() == 1
    assert m.components(docs.limit(0)).count() == 0 and m.one_of_each(docs.limit(0)).count() == 0


def test_parts_grow_with_the_fingerprints(spark):
    assert [m.blocks_for(n) for n in (0, 10**6, 2**26, 2**26 + 1, 2**31, 10**10)] == [7, 7, 7, 8, 8, 9]
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), k)) for p in prints[:20] for k in (4, 5)]
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint long").distinct()
    want = {tuple(sorted((a, b))) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 4}
    got = {tuple(sorted((x["a"] & (1 << 64) - 1, x["b"] & (1 << 64) - 1))) for x in m.links(df, 4, 9).collect()}
    assert got == want
