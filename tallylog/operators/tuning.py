"""How the miner's depth and similarity group messages whose families are known: the sweep behind the defaults."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tallylog.operators.miner import MinerConfig, mine_all


@dataclass(frozen=True)
class Trial:
    depth: int
    similarity: float
    templates: int
    mixed: int  # templates that hold messages of several families
    split: int  # families that fall to several templates


def trial(families: Mapping[str, str], config: MinerConfig) -> Trial:
    """``families`` gives the family of each message."""
    of, to = defaultdict(set), defaultdict(set)
    for message, template in mine_all(families, config).items():
        of[template].add(families[message])
        to[families[message]].add(template)
    return Trial(config.depth, config.similarity, len(of), sum(len(x) > 1 for x in of.values()), sum(len(x) > 1 for x in to.values()))


def sweep(spark: SparkSession, families: Mapping[str, str], depths: Iterable[int], similarities: Iterable[float], config: MinerConfig | None = None) -> DataFrame:
    """One row a trial, a task each: depth, similarity, templates, mixed, split. ``families`` is a corpus that a worker holds."""
    config = config or MinerConfig()
    grid = [(d, float(s)) for d in depths for s in similarities]
    shared = spark.sparkContext.broadcast(dict(families))

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([vars(trial(shared.value, replace(config, depth=d, similarity=s))) for d, s in zip(b["depth"].tolist(), b["similarity"].tolist(), strict=True)])

    rows = spark.createDataFrame(grid, "depth int, similarity double").repartition(max(1, len(grid)))
    return rows.mapInPandas(run, "depth int, similarity double, templates int, mixed int, split int")


def best(trials: Iterable[Trial]) -> Trial:
    """The fewest templates among the trials that mix no families; the shallower tree, then the laxer similarity, where equal."""
    pure = [t for t in trials if not t.mixed]
    if not pure:
        raise ValueError("every trial mixes families")
    return min(pure, key=lambda t: (t.templates, t.depth, t.similarity))
