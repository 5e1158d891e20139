"""One retriever over questions as texts, and one answer call: retrieve, compress, generate, check, record."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.jsontext import ANSWER_SCHEMA, extract_object, violation
from passagework.functions.vectors import is_finite, norm
from passagework.operators import bm25, dense
from passagework.operators.artifacts import answered, embedded
from passagework.operators.chunking import MAX_TOKENS, Tokenizer, token_limited, whitespace_tokens
from passagework.operators.rerank import Scorer
from passagework.operators.verify import first_seen, is_known
from passagework.plans.retrieval import hybrid, retrieve
from passagework.sources.scratch import save_scratch

# What a query encoder wants before a question, how far a norm may be from 1, and the reasons of failures.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
NORM_SLACK = 1e-5
UNAVAILABLE, PARSE_ERROR = "llm_unavailable", "parse_error"

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def query_vectors(questions: DataFrame, encode: Encoder, *, prefix: str = QUERY_PREFIX, tokenizer: Tokenizer = whitespace_tokens, limit: int = MAX_TOKENS, keep: Sequence[str] = ()) -> DataFrame:
    """``query_id, embedding`` and the columns ``keep`` of ``query_id, text``; blank questions have none.

    A question that with ``prefix`` has more than ``limit`` tokens is an error, since it would be cut, and so is a vector
    that isn't finite or hasn't the length 1.  Questions are encoded once and written.
    """
    asked = questions.where(F.trim("text") != "").select("query_id", F.trim("text").alias("text"), *keep)
    fit = asked.where(token_limited(F.concat(F.lit(prefix), "text"), tokenizer, limit) > 0)
    found = embedded(fit.select("query_id", "text"), encode, prefix=prefix, key="query_id")
    vector = F.col("embedding")
    good = is_finite(vector) & (F.abs(norm(vector) - 1) <= NORM_SLACK)
    checked = found.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), vector).otherwise(F.raise_error(F.lit("the encoder gave a vector that is not finite or not of length 1")).cast("array<double>")))
    vectors = save_scratch(checked, "query-vectors")
    return vectors.join(questions.select("query_id", *keep), "query_id") if keep else vectors


def dense_search(vectors: DataFrame, questions: DataFrame, encode: Encoder, k: int, *, act: str | None = None, **options) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` nearest of ``vec_id, embedding`` to each question ``query_id, text``.

    ``act`` names a column of both sides: a question whose act isn't null gets vectors of that act only.
    ``options`` go to ``query_vectors``.
    """
    asked = query_vectors(questions, encode, keep=[act] if act else [], **options)
    if act is None:
        return dense.nearest(vectors, asked, k, exclude_self=False)
    free = dense.nearest(vectors, asked.where(F.col(act).isNull()), k, exclude_self=False)
    return free.unionByName(dense.nearest(vectors, asked.where(F.col(act).isNotNull()), k, filters=(act,), exclude_self=False))


def answers_from_hits(questions: DataFrame, hits: DataFrame, step: Callable[[Column, Column], Column], known: DataFrame | None = None) -> DataFrame:
    """Responses to all ``questions`` (``query_id, text``) from ``hits`` (``query_id, citation_id, text, rank``).

    ``step`` makes a model's output from the question and its passages (an array of ``citation_id, text`` in order), null where
    the model is not available.  ``known`` (``citation_id``) are the corpus' citations; by default all well-formed ones count.

    ``query_id, query, retrieved, answer, query_type, citations, flags, citations_valid, error``: ``retrieved`` are the distinct
    citations of the hits in order.  Of the claims the first of each counts; one that wasn't retrieved is a flag, one that
    was but isn't known is left out and makes the answer invalid, the others are ``citations``.  A blank question and
    one without hits have no answer and no error; no output is ``llm_unavailable``, an output that breaks the
    contract ``parse_error``, and both have no claims.
    """
    asked = questions.select("query_id", F.trim(F.coalesce("text", F.lit(""))).alias("query"))
    found = save_scratch(hits.join(asked.where("query <> ''"), "query_id").select("query_id", "query", "citation_id", "text", "rank"), "hits")
    first = first_seen(found.select("query_id", "citation_id", "rank"), ["query_id"], "citation_id", ["rank"])
    retrieved = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "citation_id"))), lambda c: c["citation_id"]).alias("retrieved"))
    outputs = answered(found, step).select("query_id", F.col("answer").alias("output"), extract_object(F.col("answer")).alias("raw"))
    outputs = save_scratch(outputs.withColumn("parsed", F.from_json("raw", ANSWER_SCHEMA)), "outputs")  # the step runs once
    error = F.when(F.col("output").isNull(), UNAVAILABLE).when(violation(F.col("raw"), F.col("parsed")).isNotNull(), PARSE_ERROR)
    judged = outputs.select("query_id", "parsed", error.alias("error"))
    claims = judged.where("error IS NULL").select("query_id", F.posexplode("parsed.citations").alias("at", "citation_id"))
    claims = first_seen(claims, ["query_id"], "citation_id", ["at"]).join(first.select("query_id", "citation_id", F.lit(True).alias("there")), ["query_id", "citation_id"], "left")
    marked = is_known(claims, known).withColumn("there", F.coalesce("there", F.lit(False)))
    in_order = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("position", "citation_id")))), lambda c: c["citation_id"])
    verdict = marked.groupBy("query_id").agg(in_order(F.col("there") & F.col("known")).alias("citations"), in_order(~F.col("there")).alias("flags"), F.bool_and(F.col("there") & F.col("known")).alias("citations_valid"))
    none = F.array().cast("array<string>")
    both = asked.join(retrieved, "query_id", "left").join(judged, "query_id", "left").join(verdict, "query_id", "left")
    done = F.col("parsed").isNotNull() & F.col("error").isNull()
    return both.select(
        "query_id", "query", F.coalesce("retrieved", none).alias("retrieved"), F.when(done, F.col("parsed.answer")).alias("answer"), F.when(done, F.col("parsed.query_type")).alias("query_type"),
        F.coalesce("citations", none).alias("citations"), F.coalesce("flags", none).alias("flags"), F.when(done, F.coalesce("citations_valid", F.lit(True))).alias("citations_valid"), "error",
    )


def answer_questions(
    questions: DataFrame, index: bm25.Bm25Index, vectors: DataFrame, passages: DataFrame, encode: Encoder, scorer: Scorer, step: Callable[[Column, Column], Column],
    *, k: int = 3, known: DataFrame | None = None, eligible: DataFrame | None = None, **options,
) -> DataFrame:
    """The whole call for ``questions`` (``query_id, text``): hybrid search, reranking, compression, the step, and the checks of its citations.

    ``passages``: ``doc_id, citation_id, text``; ``vectors``: ``vec_id`` (a ``doc_id``), ``embedding``.  The result is that of ``answers_from_hits``.
    """
    asked = questions.where(F.trim("text") != "").select("query_id", F.trim("text").alias("text"))
    near = query_vectors(asked, encode, **options)
    fused = hybrid(index, bm25.query_terms(asked), vectors, near, max(k, 20), eligible=eligible)
    best = retrieve(fused, asked, passages, k, scorer)
    hits = best.join(passages.select("doc_id", "citation_id"), "doc_id").select("query_id", "citation_id", F.col("compressed_text").alias("text"), "rank")
    return answers_from_hits(questions, hits, step, known)


def audit_rows(responses: DataFrame, created_at: Column) -> DataFrame:
    """Rows for the audit trail: responses with ``status`` (failed with an error, else completed) and when they were made."""
    return responses.withColumns({"created_at": created_at, "status": F.when(F.col("error").isNotNull(), "failed").otherwise("completed")})
