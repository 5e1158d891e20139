"""Streaming twins: the audit log, and quotas with state per key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passagework.operators.quota import WINDOW_SECONDS


def audit_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of audit rows to a table, once each."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def usage_by_window(rows: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and mean latency per status and tumbling window; rows later than ``late`` are left out."""
    windows = rows.withWatermark("created_at", late).groupBy(F.window("created_at", width), "status")
    counted = windows.agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"))
    return counted.select(F.col("window.start").alias("window_start"), "status", "n", "avg_latency_ms")


def quota_stream(requests: DataFrame, limit: int, window: int = WINDOW_SECONDS) -> DataFrame:
    """``user_id, event_id, allowed`` of a stream of ``user_id, event_id, ts``; a key's state is its anchor and count.

    Within a batch the requests of a key are taken in order of time; the state of a key that stays silent for
    a whole window is dropped, since its next request opens a new one anyway.
    """

    def decide(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        anchor, count = state.get if state.exists else (None, 0)
        allowed = []
        for us in (rows["ts"].astype("int64") // 1000 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].astype("int64")):
            if anchor is None or us - anchor >= window * 1_000_000:
                anchor, count = us, 0
            count += 1
            allowed.append(count <= limit)
        state.update((int(anchor), count))
        state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    kinds = dict(requests.dtypes)
    return requests.groupBy("user_id").applyInPandasWithState(
        decide, f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, allowed boolean", "anchor long, n int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
