import datetime as dt

from passagework.operators.quota import quota_decisions
from passagework.streaming.jobs import audit_stream, file_stream, quota_stream, usage_by_window


def test_quota_stream_agrees_with_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(u, 100 * u + i, at + dt.timedelta(seconds=s)) for u in (1, 2) for i, s in enumerate([0, 5, 9, 3600, 3700, 3800])]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp")
    for half in (0, 1):
        df.where(f"event_id % 100 >= {3 * half} AND event_id % 100 < {3 * half + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    decided = quota_stream(file_stream(spark, str(tmp_path / "in"), "user_id int, event_id int, ts timestamp"), 2)
    run = decided.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {(r["event_id"], r["allowed"]) for r in quota_decisions(df, 2).collect()}
    assert {(r["event_id"], r["allowed"]) for r in spark.table("decided").collect()} == want


def test_audit_stream_appends_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = dt.datetime(2024, 1, 1)
    schema = "status string, created_at timestamp, latency_ms double"
    for n in (3, 2):
        spark.createDataFrame([("completed", at, 1.0)] * n, schema).write.mode("append").parquet(source)
        audit_stream(file_stream(spark, source, schema), target, checkpoint).awaitTermination(120)
    assert spark.read.parquet(target).count() == 5
    assert usage_by_window(spark.read.parquet(target)).first()["n"] == 5
