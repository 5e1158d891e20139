"""Grounding and citation checks by semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import is_citation
from passagework.operators.ranking import distributed_rank


def first_seen(rows: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """The first row of each value in a group, with its place among the distinct values.

    First rows are found by partial aggregates and ranked in parts, so neither a value nor a group is one task's work.
    """
    keys = [*group, value]
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*").select(*rows.columns) if rest else rows.distinct()
    return distributed_rank(kept, group, order, "position").withColumn("position", F.col("position").cast("long"))


def grounded(cited: DataFrame, retrieved: DataFrame, on: list[str]) -> DataFrame:
    """Citations that were retrieved; a null id never is."""
    return cited.join(retrieved, on, "left_semi")


def hallucinated(cited: DataFrame, retrieved: DataFrame, on: list[str]) -> DataFrame:
    """Citations that were not retrieved."""
    return cited.join(retrieved, on, "left_anti")


def known_citations(cited: DataFrame, known: DataFrame | None, column: str = "citation_id") -> DataFrame:
    """Well-formed citations that the corpus knows.

    Row, note and form identifiers are not well-formed.  Without ``known`` every well-formed citation counts
    as known; that is an explicit choice of the caller.
    """
    formed = cited.where(is_citation(F.col(column)))
    return formed if known is None else formed.join(known.select(column), column, "left_semi")


# Why a citation isn't accepted.
MALFORMED, NOT_FOUND = "malformed", "not found"


def is_known(cited: DataFrame, known: DataFrame | None, column: str = "citation_id") -> DataFrame:
    """``cited`` with ``known``: whether a citation is well-formed and, unless ``known`` is left out, the corpus has it."""
    formed = F.coalesce(is_citation(F.col(column)), F.lit(False))
    if known is None:
        return cited.withColumn("known", formed)
    there = known.select(F.col(column).alias("_there")).distinct()
    return cited.join(there, F.col(column) == F.col("_there"), "left").withColumn("known", formed & F.col("_there").isNotNull()).drop("_there")


def checked_citations(cited: DataFrame, known: DataFrame, group: list[str], order: list[str], column: str = "citation_id") -> DataFrame:
    """Group columns, ``citation_id, position, reason``: the first of each citation of a group, with why it isn't accepted (null if it is)."""
    first = is_known(first_seen(cited.select(*group, column, *order), group, column, order), known, column)
    reason = F.when(~F.coalesce(is_citation(F.col(column)), F.lit(False)), MALFORMED).when(~F.col("known"), NOT_FOUND)
    return first.select(*group, column, "position", reason.alias("reason"))


def resolved(cited: DataFrame, known: DataFrame, column: str = "citation_id") -> DataFrame:
    """``cited`` as it is; a citation that is malformed or that the corpus lacks is an error when the rows are read."""
    found = is_known(cited, known, column)
    why = F.when(~F.coalesce(is_citation(F.col(column)), F.lit(False)), MALFORMED).otherwise(NOT_FOUND)
    told = F.raise_error(F.concat(F.lit("citation "), F.coalesce(column, F.lit("null")), F.lit(" is "), why)).cast("boolean")
    return found.where(F.when(F.col("known"), F.lit(True)).otherwise(told)).drop("known")


def grounding_summary(cited: DataFrame, retrieved: DataFrame, group: list[str], column: str) -> DataFrame:
    """Per group the distinct citations, how many are grounded, and the ratio (1 when nothing is cited)."""
    marked = cited.select(*group, column).distinct().join(retrieved.select(*group, column).distinct().withColumn("_found", F.lit(1)), [*group, column], "left")
    counted = marked.groupBy(*group).agg(F.count(column).alias("n_cited"), F.count("_found").alias("n_grounded"))
    return counted.withColumn("grounding_ratio", F.coalesce(F.try_divide("n_grounded", "n_cited"), F.lit(1.0)))


def answer_validity(claims: DataFrame, retrieved: DataFrame, known: DataFrame | None, group: list[str], column: str = "citation_id") -> DataFrame:
    """Per group ``citations_valid``: every claim is retrieved, well-formed and known; no claims are valid."""
    good = known_citations(grounded(claims.where(F.col(column).isNotNull()), retrieved, [*group, column]), known, column).select(*group, column).distinct()
    marked = claims.select(*group, column).distinct().join(good.withColumn("_good", F.lit(True)), [*group, column], "left")
    return marked.groupBy(*group).agg(F.coalesce(F.bool_and(F.col(column).isNull() | F.coalesce("_good", F.lit(False))), F.lit(True)).alias("citations_valid"))
