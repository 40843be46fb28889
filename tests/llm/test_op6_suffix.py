import random

import numpy as np
import pytest

from tallylog.llm import op6_suffix as m


def brute(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - n + 1):
            seen[r[i : i + n]] = seen.get(r[i : i + n], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g))
    return out


def corpus(seed):
    r = random.Random(seed)
    t = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    p, q = t(90), t(60)
    out = [t(150), p + t(40) + q, t(30) + p[:70] + t(9), t(5) + q + p + q, "ab" * 80, "x" * 130, "x" * 60, "", None, t(39), p, p, t(20) + p[10:60], t(20) + p[10:50]]
    return out + [t(12) + q[: 30 + i] + t(12) for i in range(30)]


@pytest.mark.parametrize(("seed", "hot", "piece"), [(1, 512, 2 << 20), (4, 2, 64)])
def test_against_brute_force(spark, docs_of, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(m, "PIECE", piece)
    texts = corpus(seed)
    got = {r["doc_id"]: r for r in m.remove_repeats(docs_of(list(enumerate(texts))), length=40, gram=8, hot_anchor=hot).collect()}
    want = brute(texts, 40)
    assert [bytes(got[i]["kept"]) for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        removed = [(x["s"], x["e"]) for x in got[i]["removed"]]
        assert got[i]["n_bytes"] == len((t or "").encode()) == len(want[i]) + sum(e - s for s, e in removed)
        assert all(a[1] < b[0] for a, b in zip(removed, removed[1:], strict=False))


def test_suffix_sort_and_extensions():
    r = random.Random(5)
    data = bytes(r.choice(b"ab") for _ in range(600))
    s = m.Suffixes(data, m._BASES[0])
    starts = np.array(r.sample(range(500), 200))
    order = m.sort_suffixes(s, starts, np.zeros(200, dtype=np.int64), 50)
    pieces = [data[i : i + 50] for i in starts[order]]
    assert pieces == sorted(pieces)
    n = s.common(starts[:-1], starts[1:], 50)
    for a, b, k in zip(starts[:-1], starts[1:], n, strict=True):
        assert data[a : a + k] == data[b : b + k] and (k == 50 or data[a + k] != data[b + k])


def test_collisions_are_noticed(monkeypatch):
    monkeypatch.setattr(m, "_BASES", (0, *m._BASES))  # every string of two bytes or more hashes like its first byte
    data = b"a" + b"b" * 30 + b"a" + b"c" * 30
    got = m.repeated(data, np.array([0, 31]), np.zeros(2, dtype=np.int64), 20)
    assert got.tolist() == [False, False]


def test_odd_rows(spark, docs_of):
    p = "0123456789" * 10
    rows = [(None, p), (None, None), (1, p[:39]), (2, None), (2, p), (2, p)]
    got = m.remove_repeats(docs_of(rows), length=40, gram=8).collect()
    assert len(got) == 6 and sorted(len(r["kept"]) for r in got) == [0, 0, 0, 0, 0, 39]
    assert m.remove_repeats(docs_of([])).count() == 0


def passages(rows, n):
    """For each row (key, text) the words inside windows of n words that rows with another key have, too."""
    split = [(k, (t or "").encode().split()) for k, t in rows]
    seen = {}
    for k, ws in split:
        for i in range(len(ws) - n + 1):
            seen.setdefault(tuple(ws[i : i + n]), set()).add(k)
    out = []
    for _, ws in split:
        inside = set()
        for i in range(len(ws) - n + 1):
            if len(seen[tuple(ws[i : i + n])]) > 1:
                inside |= set(range(i, i + n))
        out.append(len(inside))
    return out


@pytest.mark.parametrize(("seed", "piece", "hot"), [(1, 2 << 20, 512), (2, 40, 1)])
def test_passages_against_brute_force(spark, docs_of, monkeypatch, seed, piece, hot):
    monkeypatch.setattr(m, "PIECE", piece)
    r = random.Random(seed)
    words = lambda n: [r.choice(["a", "bc", "déf", "ghij"]) + str(r.randint(0, 99)) for _ in range(n)]
    p, q = words(30), words(12)
    lists = [words(5) + p + words(9), words(40), words(20) + p, p[:19], p[:11] + words(20), words(8) + p[6:18] + words(8), q * 3, words(3), [], p + q, words(9) + p[3:15], ["x"] * 40, ["x"] * 15]
    lists += [words(6) + q + words(6) for _ in range(20)] + [q + q + words(5)]
    texts = [r.choice([" ", "\n", " \t "]).join(x) for x in lists]
    rows = [*enumerate(texts), (0, texts[0]), (None, None), (None, texts[1])]
    got = sorted((str(x["doc_id"]), sum(y["e"] - y["s"] for y in x["passages"])) for x in m.remove_repeats(docs_of(rows), length=400, gram=8, hot_anchor=hot, passage=12, passage_gram=4).collect())
    assert got == sorted((str(d), n) for (d, _), n in zip(rows, passages([((d, t), t) for d, t in rows], 12), strict=True))
