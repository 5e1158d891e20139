"""Retrieval metrics, evaluation reports and release gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cut-offs, the probes of a full run, and the release threshold.
K_VALUES = (1, 3, 5, 10)
N_PROBES = 5
RECALL_AT_5_GATE = 0.807


def require_k(k: object) -> int:
    if type(k) is not int or k < 1:
        raise ValueError("k must be a positive integer")
    return k


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Distinct gold ids among the first ``k``, over ``k``."""
    return F.size(F.array_intersect(F.slice(retrieved, 1, require_k(k)), gold)) / F.lit(k)


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """The same, over the gold ids; 0 without gold."""
    return F.size(F.array_intersect(F.slice(retrieved, 1, require_k(k)), gold)) / F.greatest(F.size(gold), F.lit(1))


def ranked_metrics(hits: DataFrame, gold: DataFrame, ks: Sequence[int] = K_VALUES, questions: DataFrame | None = None) -> DataFrame:
    """``query_id, k, precision, recall`` from ranked ``query_id, id, rank`` and ``query_id, id`` (gold).

    Works by joins, so gold sets of any size stay distributed.  A query without gold has recall 0.  ``questions``
    (``query_id``) lists all that were asked; those without hits, which failed, count with zeros.  By default
    they are the queries with hits or gold.
    """
    sizes = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    right = hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).join(gold.distinct(), ["query_id", "id"], "left_semi")
    counts = right.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= require_k(k)).alias(f"c{k}") for k in ks))
    asked = questions.select("query_id") if questions is not None else hits.select("query_id").unionByName(gold.select("query_id"))
    base = asked.distinct().join(sizes, "query_id", "left").join(counts, "query_id", "left")
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("c")) for k in ks)))
    rows = base.select("query_id", F.greatest(F.coalesce("n_gold", F.lit(0)), F.lit(1)).alias("n"), stacked.alias("x"))
    return rows.select("query_id", F.col("x.k").alias("k"), F.round(F.col("x.c") / F.col("x.k"), 6).alias("precision"), F.round(F.col("x.c") / F.col("n"), 6).alias("recall"))


def finite_mean(value: Column) -> Column:
    """Mean of the values that aren't null; null without any; a value that isn't finite is an error."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.avg(F.when(bad, F.raise_error(F.lit("a measurement is not finite")).cast("double")).otherwise(value))


def report(results: DataFrame, measures: Sequence[str], breakdowns: Sequence[str]) -> DataFrame:
    """Macro means of ``measures`` over all rows and for each value of each breakdown, in one aggregation.

    Columns ``breakdown, value, n`` and the means; failed questions keep their zeros, missing measures don't count.
    """
    keyed = results.select(*measures, F.explode(F.array(
        F.struct(F.lit("all").alias("breakdown"), F.lit("all").alias("value")),
        *(F.struct(F.lit(b).alias("breakdown"), F.col(b).cast("string").alias("value")) for b in breakdowns),
    )).alias("x"))
    return keyed.groupBy("x.breakdown", "x.value").agg(F.count(F.lit(1)).alias("n"), *(F.round(finite_mean(F.col(m).cast("double")), 6).alias(m) for m in measures))


def hallucination_rate(flags: Column, valid: Column, answer: Column) -> Column:
    """Percent of answers (not null) that have flags or invalid citations; null without answers."""
    bad = answer.isNotNull() & ((F.coalesce(F.size(flags), F.lit(0)) > 0) | (F.coalesce(valid, F.lit(True)) == F.lit(False)))
    return F.try_divide(F.lit(100.0) * F.count_if(bad), F.count(answer))


def refusal_accuracy(answer: Column, error: Column) -> Column:
    """Share of probes that were refused without an error; null unless there are exactly five."""
    return F.when(F.count(F.lit(1)) == N_PROBES, F.count_if(answer.isNull() & error.isNull()) / F.lit(N_PROBES))


def gate(recall_at_5: float | None, at_least: float = RECALL_AT_5_GATE) -> int:
    """Exit code of the release gate: 0 passes, 1 is a regression, 2 a run without a measurement."""
    if recall_at_5 is None or recall_at_5 != recall_at_5:
        return 2
    return 0 if recall_at_5 >= at_least else 1


def run_gate(n_questions: int, n_failed: int, recall_at_5: float | None, *, at_least: float | None = None, strict: bool = False) -> int:
    """Exit code of an evaluation: 2 if all questions failed, any did and ``strict`` is asked for, or there is nothing to hold against ``at_least``; 1 below it; else 0."""
    if (strict and n_failed) or (n_questions and n_failed == n_questions):
        return 2
    return 0 if at_least is None else gate(recall_at_5, at_least)
