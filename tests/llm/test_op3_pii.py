import random
import re

from tallylog.llm import op3_pii as m

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for x in re.finditer(p, t):
            d = re.sub("[^0-9]", "", x[0])
            if name == "ip" and any(int(q) > 255 for q in x[0].split(".")) or name == "card" and not (12 <= len(d) <= 19 and m.luhn(d)) or name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((x.start(), k, x.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    r = random.Random(4)
    texts = ["", "a@b.c@d.e", "x@y", "1.2.3.4.5.6.7.8", "007.1.1.255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567.", "é😀 me@x.org", "+", "1" * 3000, "@" * 50]
    texts += ["".join(r.choice("1.@a+- ()25\n") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        assert m.base_spans(t) == brute(t), t


def test_the_field_learns_its_table_and_others_like_it():
    field = m.default_field()
    wrong = 0
    for row in m.labelled_table(seed=77, rows=150):
        shapes, tags = m._tagged(*row)
        wrong += field.decode([shapes])[0] != tags
    assert wrong <= 6


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    field = m.default_field()
    k = len(m._TAGS)
    for text in ("at 10.1.2.3 now", "4929 x", "a@b"):
        shapes = m.tokens(text)[1][:4]
        around, _ = m._padded([shapes])
        e = field.scores(around)[0]
        first = [0 if i == 0 or i % 2 else -1e4 for i in range(k)]
        total = lambda p: first[p[0]] + sum(e[i][t] for i, t in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(range(k), repeat=len(shapes)), key=total)
        assert np.isclose(total(field.decode([shapes])[0]), total(best), atol=1e-3)


def test_added_spans_keep_base_ones_and_clean_texts_stay_clean():
    clean = "In 2024, 35% of 12,500 users paid $9.99 for v1.2.3 (see #42, 10:30).\n1. first\n2. second 1990-2000 at room 101"
    texts = [clean, "card 1234567890123456 and (555) 123-4567", "mail me@x.org or 10.0.0.1", None, ""]
    for text, (base, spans) in zip(texts, m.all_spans(texts, m.default_field()), strict=True):
        assert base == brute(text or "") and set(base) <= set(spans)
    found = [s for _, s in m.all_spans(texts, m.default_field())]
    assert found[0] == [] and [m.KINDS[k] for _, k, _ in found[1]] == ["card", "phone"]


def test_on_a_table(spark, docs_of):
    rows = [(1, "me@x.org"), (1, "me@x.org"), (None, None), (2, ""), (3, ("word " * 500 + "\n") * 50 + "10.0.0.1")]
    got = m.find_pii(docs_of(rows)).collect()
    assert len(got) == 5 and sorted(len(r["_pii"]["base"]) for r in got) == [0, 0, 1, 1, 1]
    assert m.find_pii(docs_of([])).count() == 0


def test_long_lines_are_one_sequence():
    field = m.default_field()
    for before in (394, 396, 397, 398, 399):
        for value, kind in (("1234 5678 9012 3456", 2), ("(555) 123-4567", 3)):
            line = "word " * before + value + " word" * 900
            assert m.field_spans([line], field) == [[(5 * before, kind, 5 * before + len(value))]]
    _, shapes = m.tokens("a " * 300 + "1234-5678-9012-3456 b " * 90)
    assert field.decode_long(shapes) == field.decode([shapes])[0]
