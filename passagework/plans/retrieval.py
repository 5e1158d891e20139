"""Retrieval plans: hybrid search, reranking and compression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators import bm25, dense, fusion
from passagework.operators.rerank import FUSION_CUT, Scorer, compress, rerank


def hybrid(index: bm25.Bm25Index, terms: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int, *, cut: int | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """Fused ranks of lexical and vector search over one id space.

    Each side gives ``max(k, 20)``; the result is cut at ``cut``, or ``k``.  ``eligible`` (``doc_id``) limits
    what either side returns and never the lexical statistics.
    """
    n = fusion.depth(k)
    sparse = bm25.search(index, terms, n, eligible=eligible).select("query_id", "doc_id", "rank", F.lit("sparse").alias("source"))
    if eligible is not None:
        vectors = vectors.join(eligible.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = dense.nearest(vectors, query_vectors, n, exclude_self=False).select("query_id", F.col("vec_id").alias("doc_id"), "rank", F.lit("dense").alias("source"))
    return fusion.reciprocal_rank_fusion(near.unionByName(sparse), cut or k)


def retrieve(fused: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer: Scorer) -> DataFrame:
    """Reranked and compressed passages of fused hits; texts are joined to the few that are left, last."""
    texts = fused.where(F.col("rank") <= FUSION_CUT).join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return compress(rerank(texts, k, scorer), scorer)
