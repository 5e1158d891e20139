"""Usage analytics over audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.ranking import percentiles, top_k


def usage_summary(rows: DataFrame, owner: str, as_of: Column, statuses: Sequence[str]) -> DataFrame:
    """One row per owner from ``status, created_at, latency_ms``.

    Totals, a count per status, the rows of the 24 hours that end at ``as_of`` (both ends included), mean and
    median latency (nulls left out, zeros kept), and the first and last time.
    """
    recent = F.col("created_at").between(as_of - F.expr("INTERVAL 24 HOURS"), as_of)
    counted = rows.groupBy(owner).agg(
        F.count(F.lit(1)).alias("total_queries"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses), F.count_if(recent).alias("queries_last_24h"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.min("created_at").alias("first_query_at"), F.max("created_at").alias("last_query_at"),
    )
    median = percentiles(rows, [owner], "latency_ms", [50]).select(owner, F.round("p50", 6).alias("p50_latency_ms"))
    return counted.join(median, owner, "left")


def history(rows: DataFrame, owner: str, limit: int = 50) -> DataFrame:
    """Each owner's newest rows with their rank; ties in time go to the larger id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    return top_k(rows, [owner], [F.desc("created_at"), F.desc("id")], limit)
