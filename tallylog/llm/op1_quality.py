"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of whole texts (shares of character classes, word lengths, repetition).
2. Shallow boosted trees on a bounded sample of labelled rows. Each node's path is a conjunctive rule.
3. Lasso logistic regression over the rules (proximal gradient), which leaves few of them.
4. The rules that are left become one Spark column expression over the statistics.

Labels, lang, source and doc_id are never inputs of a score. The fit uses at most ``sample`` labelled rows (those with the
smallest hash of the id); everything is scored.

Defined results: null and empty texts have all statistics zero and are scored like any other. A null doc_id is never in the
fit and its ``held_out`` is false. Repeated documents keep their rows. A label that is null is left out; several
labels of one document count as their mean, rounded up from one half. With labels of one class or none
the score is that share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import packed, small_batches, unpacked

#: Labelled rows that a fit may use.
SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST = 40, 3, 48, 0.3, 10
L1, STEPS = 0.002, 400

STATISTICS = ("chars", "words", "upper", "digits", "symbols", "bars", "stops", "white", "high", "word_len", "short_words", "long_words", "distinct_words", "distinct_triples", "distinct_lines", "line_len", "top_word", "symbol_words")

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_CLASSES = {
    "upper": list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": list(b"0123456789"),
    "symbols": list(b"#$%&*!?@^~+=<>{}[]\\/_\"'`"),
    "bars": list(b"|"),
    "stops": list(b".,;:"),
    "white": list(b" \t\r\n\x0b\x0c"),
    "high": list(range(128, 256)),
}
_EDGES = b"#$%&*!?|@^~"


def statistics_of(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [float(len(text or ""))] + [0.0] * (len(STATISTICS) - 1)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, w = len(raw), len(words)
    lens = list(map(len, words))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (w - 2) if w > 2 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = [float(hist[c].sum()) / n for c in _CLASSES.values()]
    letters = max(1, int(hist[_LETTERS].sum()))
    share[0] *= n / letters
    return [
        float(len(text)), float(w), *share, sum(lens) / w, sum(x <= 3 for x in lens) / w, sum(x > 12 for x in lens) / w, len(counts) / w, triples,
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), max(counts.values()) / w, sum(x[-1] in _EDGES for x in words) / w,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``_s`` of the statistics of ``text``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame([statistics_of(x) for x in t], columns=list(STATISTICS), dtype=float)

    return docs.withColumn("_s", of("text"))


Rule = tuple[tuple[int, bool, float], ...]
"""Conditions (statistic, above, cut): the statistic is above the cut, or is not."""


def _tree(binned: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rng: np.random.Generator) -> tuple[list[Rule], np.ndarray]:
    """The rules of one regression tree's nodes, and its prediction on the rows."""
    rules: list[Rule] = []
    out = np.zeros(len(target))
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(target)), ())]
    while todo:
        rows, path = todo.pop()
        if path:
            rules.append(path)
        out[rows] = target[rows].mean()
        if len(path) == DEPTH or len(rows) < 2 * LEAST:
            continue
        best, y = (1e-9, -1, -1), target[rows]
        for j in rng.permutation(len(cuts))[: max(4, len(cuts) * 2 // 3)]:
            size = len(cuts[j]) + 1
            b = binned[rows, j]
            n, s = np.bincount(b, minlength=size).cumsum(), np.bincount(b, weights=y, minlength=size).cumsum()
            left, right = n[:-1], n[-1] - n[:-1]
            ok = (left >= LEAST) & (right >= LEAST)
            if not ok.any():
                continue
            gain = np.where(ok, s[:-1] ** 2 / np.maximum(left, 1) + (s[-1] - s[:-1]) ** 2 / np.maximum(right, 1) - s[-1] ** 2 / n[-1], -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(j), k)
        if best[1] < 0:
            continue
        _, j, k = best
        above = binned[rows, j] > k
        cut = float(cuts[j][k])
        todo += [(rows[above], (*path, (j, True, cut))), (rows[~above], (*path, (j, False, cut)))]
    return rules, out


def _applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def _lasso(z: np.ndarray, y: np.ndarray, l1: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps. Columns are used as 0/1."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / max(1e-9, float(np.linalg.norm(z.T @ z / n, 2)) + 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        g = p - y
        w1 = v - step * (z.T @ g) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * l1, 0)
        b1 = c - step * float(g.mean())
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return b, w


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, s: str = "_s") -> Column:
        """The score as a Spark expression over the struct of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            hit = F.lit(True)
            for j, above, cut in rule:
                x = F.col(f"{s}.{STATISTICS[j]}")
                hit = hit & ((x > cut) if above else (x <= cut))
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * _applies(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleEnsemble:
    if len(y) < 2 * LEAST or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    # The rarer class counts as much as the other in the trees, so that its kinds are all found.
    f, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        got, out = _tree(binned, cuts, y - p, rng)
        f += SHRINK * 4 * out
        rules |= dict.fromkeys(got)
    z = np.stack([_applies(r, x) for r in rules], axis=1).astype(np.float32)
    keep = np.unique(z, axis=1, return_index=True)[1]
    names = [list(rules)[i] for i in sorted(keep)]
    bias, w = _lasso(z[:, sorted(keep)], y.astype(float), L1, STEPS)
    return RuleEnsemble(bias, tuple((r, float(v)) for r, v in zip(names, w, strict=True) if v))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> RuleEnsemble:
    """Fit on at most ``sample`` labelled documents that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # One text an id, whatever its rows, before anything goes to the driver.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    rows = with_statistics(texts).select("doc_id", "_y", "_s.*").toPandas().sort_values("doc_id")
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` with ``_score``."""
    return with_statistics(docs).withColumn("_score", model.column()).drop("_s")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least 0.5."""
    return unpacked(score(packed(docs), learn(docs, labels)).where("_score >= 0.5"), docs.columns)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
