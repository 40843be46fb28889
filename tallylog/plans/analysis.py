"""analyze_archive: one pass over an archive, and what it gives.

:func:`analyze` gives DataFrames, for archives whose findings are too many for a driver; :func:`analyze_archive` collects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.operators import counts as C
from tallylog.operators.findings import classify, findings, in_order
from tallylog.operators.miner import MinerConfig
from tallylog.operators.mining import release
from tallylog.schema import DEFAULT_THRESHOLD, ArchiveAnalysis, Finding, LogTypeCount, StatusCount
from tallylog.sources.archive import located, read_archive


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:
        return active
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    return SparkSession.builder.appName("tallylog").config(map=conf).getOrCreate()


@dataclass(frozen=True)
class Analysis:
    """What an archive holds, as DataFrames: nothing of them is on the driver."""

    tally: DataFrame  # one row: total_events, malformed_lines
    status_counts: DataFrame
    log_type_counts: DataFrame
    findings: DataFrame


@contextmanager
def analyze(paths: str | list[str], *, alert_threshold: int = DEFAULT_THRESHOLD, skip_malformed: bool = True, spark: SparkSession | None = None, config: MinerConfig | None = None) -> Iterator[Analysis]:
    """The analysis of one archive or several, on any file system that Spark reads; what it keeps is released at the end."""
    if alert_threshold < 0:
        raise ValueError(f"a threshold of {alert_threshold} is below zero")
    spark = spark or session()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = read_archive(spark, paths, strict=not skip_malformed).persist(StorageLevel.MEMORY_AND_DISK)
    classified = classify(events, alert_threshold)
    counts = C.by_status_and_type(classified).persist(StorageLevel.MEMORY_AND_DISK)
    tally = events.agg(F.count_if(~F.col("is_malformed")).alias("total_events"), F.count_if("is_malformed").alias("malformed_lines"))
    try:
        yield Analysis(tally, C.status_counts(counts), C.log_type_counts(counts), in_order(findings(classified, config)))
    finally:
        release()
        counts.unpersist()
        events.unpersist()


def analyze_archive(path: str | Path, *, alert_threshold: int = DEFAULT_THRESHOLD, skip_malformed: bool = True, spark: SparkSession | None = None, config: MinerConfig | None = None, most_findings: int | None = None) -> ArchiveAnalysis:
    """Classify an archive's events, count them, and group the unresolved ones into findings.

    Malformed lines are counted and left out; with ``skip_malformed=False`` the first one is an error. ``path`` is a file, or a
    folder or glob of any file system. ``most_findings`` bounds what comes to the driver, largest first; None is all.
    """
    spark = spark or session()
    shown, paths = located(spark, path)
    with analyze(paths, alert_threshold=alert_threshold, skip_malformed=skip_malformed, spark=spark, config=config) as found:
        total, bad = found.tally.first()
        by_status = tuple(StatusCount(*r) for r in found.status_counts.collect())
        by_type = tuple(LogTypeCount(*r) for r in found.log_type_counts.collect())
        listed = found.findings if most_findings is None else found.findings.limit(most_findings)
        return ArchiveAnalysis(shown, total, bad, by_status, by_type, tuple(Finding(*r) for r in listed.collect()))
