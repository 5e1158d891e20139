"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.ranking import top_k

# The rank constant, and the depth of either side.
RANK_CONSTANT, LEAST_DEPTH = 60, 20


def depth(k: int) -> int:
    """Candidates that each side gives for ``k`` results."""
    return max(k, LEAST_DEPTH)


def reciprocal_rank_fusion(hits: DataFrame, cut: int, *, decimals: int = 9) -> DataFrame:
    """``query_id, doc_id, rrf_score, dense_rank, sparse_rank, sources, rank`` from ``query_id, doc_id, source, rank``.

    A list that holds an id twice adds twice.  Ties go to the smaller id; ``sources`` names dense first.
    """
    of = lambda source: F.min(F.when(F.col("source") == source, F.col("rank")))
    fused = hits.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))), decimals).alias("rrf_score"), of("dense").cast("long").alias("dense_rank"), of("sparse").cast("long").alias("sparse_rank")
    )
    named = fused.withColumn("sources", F.concat_ws(",", F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(F.col("sparse_rank").isNotNull(), F.lit("sparse"))))
    return top_k(named, ["query_id"], [F.desc("rrf_score"), F.asc("doc_id")], cut)


def payload_conflicts(hits: DataFrame, payload: list[str]) -> DataFrame:
    """Ids whose payload differs between lists; fusing such lists is an error."""
    return hits.groupBy("query_id", "doc_id").agg(F.count_distinct(F.struct(*payload)).alias("n")).where("n > 1").select("query_id", "doc_id")
