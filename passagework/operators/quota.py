"""Fixed-window quotas anchored at the first request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.ranking import distributed_rank
from passagework.operators.scans import anchored

# The window and the limits per hour.
WINDOW_SECONDS = 3600
LIMITS = {"query": 30, "sections": 120, "analytics": 120, "auth": 100}


def quota_decisions(requests: DataFrame, limit: int, *, key: str = "user_id", at: str = "ts", order: str = "event_id", window: int = WINDOW_SECONDS) -> DataFrame:
    """``key, order, at`` with ``request_no``, ``allowed`` and ``retry_after`` seconds.

    The first request of a key opens a window of ``window`` seconds; later requests in it count, rejected ones
    too; the first request after it opens the next.  ``retry_after`` is null for allowed requests.

    Which request opens a window depends on the window before it: see ``scans``, by which a key that has very many
    requests, with pauses or without, is spread over tasks.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    width = window * 1_000_000
    opened = anchored(requests.select(key, order, at, us.alias("_us")), [key], ["_us", order], width, "_opened")
    numbered = distributed_rank(opened, [key, "_opened"], ["_us", order], "request_no")
    allowed = F.col("request_no") <= limit
    wait = F.ceil((F.col("_opened") + width - F.col("_us")) / 1_000_000).cast("long")
    return numbered.select(key, order, at, F.col("request_no").cast("long").alias("request_no"), allowed.alias("allowed"), F.when(~allowed, wait).alias("retry_after"))
