"""Second-stage scoring and extractive compression with an injected scorer.

A scorer is a function of two columns, the query and a passage, that gives a
double; a model comes in as an Arrow function.  The default is the share of a
passage's distinct tokens that the query holds, minus a margin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import sentence_spans, tokenize
from passagework.operators.ranking import top_k

# Candidates that are scored, and the score from which a sentence is kept.
FUSION_CUT, KEEP_FROM = 40, 0.0

Scorer = Callable[[Column, Column], Column]


def overlap_scorer(margin: float = 0.25) -> Scorer:
    def score(query: Column, passage: Column) -> Column:
        held = F.array_distinct(tokenize(passage, exact=True))
        share = F.size(F.array_intersect(held, tokenize(query, exact=True))) / F.greatest(F.size(held), F.lit(1))
        return F.round(share - margin, 6)

    return score


def rerank(fused: DataFrame, k: int, scorer: Scorer, *, cut: int = FUSION_CUT) -> DataFrame:
    """``fused`` (``query_id, query, doc_id, text, rank``) with ``rerank_score`` and the new ``rank``, ``k`` per query.

    The first ``cut`` are taken before blank passages are left out; equal scores keep the fused order.
    """
    taken = fused.where(F.col("rank") <= cut).where(F.col("text").rlike(r"\S")).withColumnRenamed("rank", "fused_rank")
    scored = taken.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    return top_k(scored, ["query_id"], [F.desc("rerank_score"), F.asc("fused_rank")], k)


def passage_field(embedding_text: Column, text: Column) -> Column:
    """Struct of the passage and the field it came from: ``embedding_text`` if filled, else ``text``, else none."""
    filled = lambda c: c.isNotNull() & (c != "")
    return (
        F.when(filled(embedding_text), F.struct(embedding_text.alias("passage"), F.lit("embedding_text").alias("passage_field")))
        .when(filled(text), F.struct(text.alias("passage"), F.lit("text").alias("passage_field")))
        .otherwise(F.struct(F.lit("").alias("passage"), F.lit("none").alias("passage_field")))
    )


def compress(hits: DataFrame, scorer: Scorer, *, keep_from: float = KEEP_FROM) -> DataFrame:
    """``hits`` (``query_id, query, doc_id, text``) reduced to their relevant sentences.

    Adds ``spans`` in document order, ``compressed_text``, ``compression_mode`` and ``low_confidence``.  If no
    sentence reaches ``keep_from`` the best one (the first on ties) stays, marked ``fallback_best``; a blank
    passage is ``skipped``.
    """
    key = ["query_id", "doc_id"]
    spans = hits.select(*key, "query", F.posexplode(sentence_spans(F.col("text"))).alias("pos", "span"))
    scored = spans.select(*key, F.struct("pos", "span.char_start", "span.char_end", "span.text", scorer(F.col("query"), F.col("span.text")).alias("score")).alias("s"))
    # sentences of one passage only: bounded by its length
    grouped = scored.groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("all"))
    kept = F.filter("all", lambda s: s["score"] >= keep_from)
    best = F.filter("all", lambda s: s["score"] == F.array_max(F.transform("all", lambda t: t["score"])))
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.slice(best, 1, 1))
    reduced = grouped.select(*key, chosen.alias("spans"), F.when(F.size(kept) > 0, F.lit("extractive")).otherwise(F.lit("fallback_best")).alias("mode"))
    out = hits.join(reduced, key, "left")
    mode = F.coalesce("mode", F.lit("skipped"))
    return out.withColumns({
        "compressed_text": F.coalesce(F.array_join(F.transform("spans", lambda s: s["text"]), " "), F.lit("")), "compression_mode": mode, "low_confidence": mode == "fallback_best",
    }).drop("mode")
