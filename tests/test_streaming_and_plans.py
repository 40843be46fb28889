from helpers import event, write
from pyspark.sql import functions as F

from tallylog.operators.findings import classify
from tallylog.sources.archive import read_archive
from tallylog.streaming.live import stream_lines, windowed_counts


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [event("a"), event("b", "sshd"), event("c", "sshd", "1", 9), "{bad"]
    write(folder / "1.json", rows)
    q = windowed_counts(stream_lines(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["observed_status"], r["log_type"]): r["event_count"] for r in spark.table("live").collect()}
    batch = classify(read_archive(spark, str(folder)), 3).groupBy("observed_status", "log_type").count().collect()
    assert got == {(r[0], r[1]): r[2] for r in batch}


def test_columns_are_pruned_and_text_is_not_carried(spark, tmp_path):
    path = write(tmp_path / "p.json", [event()])
    df = classify(read_archive(spark, str(path)), 3).groupBy("observed_status").agg(F.count(F.lit(1)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "full_log" not in plan and "agent" not in plan and "python" not in plan.lower()
    parsed = read_archive(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert parsed.count("try_parse_json") + parsed.count("parse_json(") <= 1
