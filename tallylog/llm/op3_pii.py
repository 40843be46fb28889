"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans, which always stay. The field is trained here from a small labelled table
(:func:`labelled_table`) and decoded by Viterbi in numpy batches; it adds the spans that the patterns are too strict for
(numbers laid out like a card that fail the checksum, phone numbers without a country code, addresses written in
unusual ways). An added span never overlaps a base span or another added one.

A line is a sequence. What the field labels counts as a span only if it holds an ``@`` or enough digits for its kind
(:func:`_plausible`), so a line without any digit or ``@`` can give none and is not decoded; the result is the same.

Defined results: a null text is empty and has no spans. Repeated rows and null ids keep their rows. Offsets are code points, ends
exclusive. Spans are listed by start, then kind in the order email, ip, card, phone, then end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]
"""(start, kind's place in KINDS, end)."""

# ---- base patterns -------------------------------------------------------------------------------------------------

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails at its start fails all through, so matches are only tried at the start of a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((s, 0, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- tokens and shapes ---------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
_PUNCTUATION = "@.+-()%_:/,;|#$&*!?\"'=<>[]"
_SHAPES = {s: i for i, s in enumerate([f"{g}{s}" for g in ("", " ") for s in ("a", "Aa", "A", *[f"d{n}" for n in (1, 2, 3, 4)], "d5-6", "d7-8", "d9-11", "d12-19", "d20", *_PUNCTUATION, "other")])}
_PAD = len(_SHAPES)
#: Places around a token whose shapes are its features.
_AROUND = (-3, -2, -1, 0, 1, 2, 3)


def _shape(tok: str, gap: bool) -> int:
    c = tok[0]
    if c in "0123456789":
        n = len(tok)
        s = f"d{n}" if n <= 4 else "d5-6" if n <= 6 else "d7-8" if n <= 8 else "d9-11" if n <= 11 else "d12-19" if n <= 19 else "d20"
    elif c.isalpha():
        s = "a" if tok.islower() else "Aa" if tok[1:].islower() and c.isupper() else "A"
    else:
        s = c if c in _PUNCTUATION else "other"
    return _SHAPES[(" " if gap else "") + s]


def tokens(line: str) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end) and shape of each token."""
    at, shapes, before = [], [], 0
    for m in _TOKEN.finditer(line):
        s, e = m.span()
        at.append((s, e))
        shapes.append(_shape(m[0], s > before or s == 0))
        before = e
    return at, shapes


def labelled_table(seed: int = 11, rows: int = 420) -> list[tuple[str, list[tuple[str, str]]]]:
    """The small labelled table: (text, [(kind, value)]) rows, made from a few layouts and a fixed seed."""
    rng = np.random.default_rng(seed)
    syllables = ["ka", "lo", "mer", "tin", "sa", "vor", "ne", "pil", "du", "ran", "os", "el"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    make = {
        "email": [lambda: f"{word()}.{n(2)}@{word()}{n(1)}.{word()}.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}_{word()}@{word()}-{word()}.net", lambda: f"{n(3)}{word()}@{word()}.{word()}.de"],
        "ip": [lambda: ".".join(str(x) for x in rng.integers(1, 256, 4))],
        "card": [lambda: n(16), lambda: " ".join(n(4) for _ in range(4)), lambda: "-".join(n(4) for _ in range(4)), lambda: n(15)],
        "phone": [lambda: f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", lambda: f"+{n(2)} {n(3)} {n(7)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"+{n(11)}", lambda: f"{n(3)}-{n(3)}-{n(4)}"],
    }
    # What looks like data but is none: years, sums, versions, dates, times, codes, list numbers.
    plain = [word, word, word, word, lambda: word().capitalize(), lambda: word().upper(), lambda: word() + ",", lambda: word() + "."]
    odd = [lambda: n(4), lambda: n(2), lambda: f"{n(1)}.{n(1)}.", lambda: f"{n(1)}.{n(2)}", lambda: f"{n(2)},{n(3)}", lambda: f"{n(4)}-{n(2)}-{n(2)}", lambda: f"{n(2)}:{n(2)}", lambda: f"${n(3)}", lambda: f"{n(2)}%", lambda: f"v{n(1)}.{n(1)}.{n(1)}", lambda: f"#{n(3)}", lambda: f"@{word()}", lambda: f"{n(1)}+{n(1)}", lambda: f"({n(4)})", lambda: f"{n(1)}.", lambda: f'token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}"', lambda: f"{word()}***", lambda: f"{word()}$$$", lambda: f"{word()}!!", lambda: f"| {word()} |", lambda: n(5), lambda: n(6), lambda: n(8), lambda: f"{n(3)}-{n(2)}", lambda: f"{word()}-{word()}", lambda: f"{word()}:{word()}/{word()}"]
    out = []
    for i in range(rows):
        parts: list[tuple[str, str | None]] = [(plain[rng.integers(len(plain))](), None) for _ in range(rng.integers(2, 12))]
        for _ in range(rng.integers(0, 3)):
            parts.insert(rng.integers(len(parts) + 1), (odd[rng.integers(len(odd))](), None))
        if i % 5:
            kind = KINDS[i % 4]
            value = make[kind][rng.integers(len(make[kind]))]()
            parts.insert(rng.integers(len(parts) + 1), (value + ["", "", ".", ",", "!!", "%%%"][rng.integers(6)], kind))
        spans = []
        for p, kind in parts:
            if kind:
                value = p.rstrip("%!,")
                spans.append((kind, value[:-1] if value.endswith(".") else value))
        out.append((" ".join(p for p, _ in parts), spans))
    return out


def _tagged(text: str, spans: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    at, shapes = tokens(text)
    tags = [0] * len(at)
    for kind, value in spans:
        s = text.index(value)
        inside = [i for i, (a, b) in enumerate(at) if a >= s and b <= s + len(value)]
        for j, i in enumerate(inside):
            tags[i] = 1 + 2 * KINDS.index(kind) + (j > 0)
    return shapes, tags


# ---- the field -----------------------------------------------------------------------------------------------------

_NEVER = np.float32(-1e4)


def _allowed() -> np.ndarray:
    """(tag, next tag): an I follows the B or I of its kind alone."""
    k = len(_TAGS)
    ok = np.ones((k, k), dtype=bool)
    for j in range(2, k, 2):
        ok[:, j] = False
        ok[j - 1, j] = ok[j, j] = True
    return ok


def _padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes of the rows side by side with their surroundings: (row, token, place), and the lengths."""
    n, t, r = len(rows), max(map(len, rows)), max(_AROUND)
    flat = np.full((n, t + 2 * r), _PAD, dtype=np.int64)
    for i, x in enumerate(rows):
        flat[i, r : r + len(x)] = x
    return np.stack([flat[:, r + a : r + a + t] for a in _AROUND], axis=2), np.array(list(map(len, rows)))


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # (place, shape, tag)
    step: np.ndarray  # (tag, next tag)

    def scores(self, around: np.ndarray) -> np.ndarray:
        out = self.emit[0][around[:, :, 0]]
        for k in range(1, len(_AROUND)):
            out = out + self.emit[k][around[:, :, k]]
        return out

    def decode(self, rows: list[list[int]]) -> list[list[int]]:
        """The best tags of each row: Viterbi over all rows of a batch at once."""
        around, lens = _padded(rows)
        e = self.scores(around)
        n, t, k = e.shape
        first = np.where(np.arange(k) % 2 + (np.arange(k) == 0) > 0, 0, _NEVER).astype(np.float32)
        best, back = e[:, 0] + first, np.zeros((t, n, k), dtype=np.int8)
        done = np.zeros((n, k), dtype=np.float32)
        done[lens == 1] = best[lens == 1]
        for i in range(1, t):
            paths = best[:, :, None] + self.step[None]
            back[i] = paths.argmax(axis=1)
            best = paths.max(axis=1) + e[:, i]
            done[lens == i + 1] = best[lens == i + 1]
        tag = done.argmax(axis=1)
        out = np.zeros((n, t), dtype=np.int8)
        for i in range(t - 1, -1, -1):
            live = lens > i
            out[live, i] = tag[live]
            tag = np.where(live & (i > 0), back[i][np.arange(n), tag], tag)
        return [out[j, : lens[j]].tolist() for j in range(n)]

    def decode_long(self, shapes: list[int]) -> list[int]:
        """The best tags of one row of any length: scores come by slices, and a byte a tag and token is kept of the paths."""
        t, k, r = len(shapes), len(_TAGS), max(_AROUND)
        flat = np.full(t + 2 * r, _PAD, dtype=np.int16)
        flat[r : r + t] = shapes
        best = np.where(np.arange(k) % 2 + (np.arange(k) == 0) > 0, 0.0, float(_NEVER))
        back = np.zeros((t, k), dtype=np.int8)
        step = self.step.astype(np.float64)
        for at in range(0, t, _MOST):
            end = min(at + _MOST, t)
            e = self.scores(np.stack([flat[r + a + at : r + a + end] for a in _AROUND], axis=1)[None])[0]
            for i in range(at, end):
                if i:
                    paths = best[:, None] + step
                    back[i] = paths.argmax(axis=0)
                    best = paths.max(axis=0)
                best = best + e[i - at]
            best -= best.max()  # keeps the sums small; all paths lose the same
        out, tag = [0] * t, int(best.argmax())
        for i in range(t - 1, -1, -1):
            out[i] = tag
            tag = int(back[i, tag])
        return out


def train(table: list[tuple[str, list[tuple[str, str]]]], steps: int = 120, rate: float = 0.15, l2: float = 0.02) -> Field:
    """Maximum likelihood by forward-backward over the padded table, with Adam and an L2 penalty."""
    data = [_tagged(*row) for row in table]
    data = [d for d in data if d[0]]
    around, lens = _padded([d[0] for d in data])
    n, t, _ = around.shape
    k, p = len(_TAGS), len(_AROUND)
    gold = np.zeros((n, t), dtype=np.int64)
    for i, (_, tags) in enumerate(data):
        gold[i, : len(tags)] = tags
    live = np.arange(t)[None, :] < lens[:, None]
    ok = np.where(_allowed(), 0.0, _NEVER)
    first = np.where(np.arange(k) % 2 + (np.arange(k) == 0) > 0, 0.0, _NEVER)
    emit, step = np.zeros((p, _PAD + 1, k)), np.zeros((k, k))
    seen_e, seen_s = np.zeros_like(emit), np.zeros_like(step)
    for a in range(p):
        np.add.at(seen_e[a], (around[:, :, a][live], gold[live]), 1)
    pair = live[:, 1:]
    np.add.at(seen_s, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, step)]
    log_sum = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for it in range(1, steps + 1):
        e = sum(emit[a][around[:, :, a]] for a in range(p))
        s = step + ok
        fwd, bwd = np.zeros((n, t, k)), np.zeros((n, t, k))
        fwd[:, 0] = e[:, 0] + first
        for i in range(1, t):
            fwd[:, i] = np.where(live[:, i, None], log_sum(fwd[:, i - 1][:, :, None] + s[None], 1) + e[:, i], fwd[:, i - 1])
        z = log_sum(fwd[:, -1], 1)
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.where(live[:, i + 1, None], log_sum(s[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0.0)
        mean = np.where(live[:, :, None], np.exp(fwd + bwd - z[:, None, None]), 0.0)
        grad_e = seen_e.copy()
        for a in range(p):
            np.subtract.at(grad_e[a], around[:, :, a][live], mean[live])
        both = fwd[:, :-1, :, None] + s[None, None] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
        grad_s = seen_s - np.where(pair[:, :, None, None], np.exp(np.minimum(both, 0)), 0.0).sum(axis=(0, 1))
        for x, g, mo in ((emit, grad_e, moments[0]), (step, grad_s, moments[1])):
            g = g / n * 10 - l2 * x
            mo[0] = 0.9 * mo[0] + 0.1 * g
            mo[1] = 0.99 * mo[1] + 0.01 * g * g
            x += rate * (mo[0] / (1 - 0.9**it)) / (np.sqrt(mo[1] / (1 - 0.99**it)) + 1e-8)
    return Field(emit.astype(np.float32), (step + ok).astype(np.float32))


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_table())


#: Tokens of a line up to which lines are decoded side by side; a longer one is decoded alone, in slices of as many.
_MOST = 400
_SIGNS = re.compile(r"[0-9@]")


def _sequences(text: str) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    start = 0
    for line in text.split("\n"):
        if _SIGNS.search(line):
            at, shapes = tokens(line)
            yield [(a + start, b + start) for a, b in at], shapes
        start += len(line) + 1


#: What an added span of each kind must at least be, so that a slip of the field adds nothing absurd.
_LEAST_DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}


def _plausible(kind: str, value: str) -> bool:
    if kind == "email":
        return "@" in value[1:-1] and "." in value.partition("@")[2]
    digits = sum(c in "0123456789" for c in value)
    low, high = _LEAST_DIGITS[kind]
    return low <= digits <= high and (kind != "ip" or value.count(".") == 3)


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """The spans that the field finds in each text."""
    rows = [(i, at, shapes) for i, t in enumerate(texts) for at, shapes in _sequences(t) if shapes]
    rows.sort(key=lambda r: len(r[1]))
    out: list[list[Span]] = [[] for _ in texts]
    lo = 0
    while lo < len(rows):
        hi, size = lo + 1, len(rows[lo][1])
        while hi < len(rows) and len(rows[hi][1]) <= _MOST and (hi - lo + 1) * len(rows[hi][1]) <= 60_000 and len(rows[hi][1]) <= 1.3 * size + 8:
            hi += 1
        tagged = field.decode([r[2] for r in rows[lo:hi]]) if size <= _MOST else [field.decode_long(rows[lo][2])]
        for (i, at, _), tags in zip(rows[lo:hi], tagged, strict=True):
            j = 0
            while j < len(tags):
                if tags[j] % 2:
                    e = j + 1
                    while e < len(tags) and tags[e] == tags[j] + 1:
                        e += 1
                    kind = tags[j] // 2
                    if _plausible(KINDS[kind], texts[i][at[j][0] : at[e - 1][1]]):
                        out[i].append((at[j][0], kind, at[e - 1][1]))
                    j = e
                else:
                    j += 1
        lo = hi
    return out


def all_spans(texts: Iterable[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and those together with what the field adds."""
    texts = [t or "" for t in texts]
    out = []
    for t, more in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(t)
        taken, added = sorted((s, e) for s, _, e in base), []
        for s, k, e in sorted(more):
            if not any(a < e and s < b for a, b in taken):
                added.append((s, k, e))
                taken.append((s, e))
        out.append((base, sorted(base + added)))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with a struct ``_pii``: base and spans (arrays of kind, start and end)."""
    small_batches(docs.sparkSession)
    field = field or default_field()
    span = "array<struct<kind: string, start: int, end: int>>"

    @F.pandas_udf(f"base {span}, spans {span}")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        named = lambda xs: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in xs]
        for t in batches:
            found = all_spans(t, field)
            yield pd.DataFrame({"base": [named(b) for b, _ in found], "spans": [named(a) for _, a in found]})

    return docs.withColumn("_pii", of("text"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of_kind = lambda k: F.size(F.filter("_pii.base", lambda x: x.kind == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", *counts, F.sha2(text("_pii.base"), 256).alias("base_sha256"), text("_pii.spans").alias("spans"))
