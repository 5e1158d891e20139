"""Assertions on tables: a violation report where one is wanted, an error where one is not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import alpha_value, question_key, roman_value


def require(condition: object, message: str) -> None:
    """Raises ``ValueError``, also where assertions are switched off."""
    if not condition:
        raise ValueError(message)


def require_empty(rows: DataFrame, message: str) -> None:
    """Raises with up to five of the offending rows."""
    found = rows.take(5)
    require(not found, f"{message}: {found}")


def checked(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """``rows``, failing at run time on the first row that breaks the condition or leaves it null."""
    return rows.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_differences(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of one side only, marked ``left`` or ``right``; equal sets give no rows."""
    only = lambda a, b, side: a.select(*key).distinct().join(b.select(*key).distinct(), list(key), "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def row_differences(left: DataFrame, right: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """``key, field`` for each field in which rows of one key differ (nulls equal each other).

    A key of one side only is reported with the field ``missing left`` or ``missing right``.
    """
    fields = [c for c in left.columns if c in right.columns and c not in (key, *ignore)]
    here = [df.select(key, *fields, F.lit(True).alias("_here")).alias(side) for df, side in ((left, "l"), (right, "r"))]
    both = here[0].join(here[1], F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    differing = F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in fields))
    alone = F.when(F.col("l._here").isNull(), F.array(F.lit("missing left"))).when(F.col("r._here").isNull(), F.array(F.lit("missing right")))
    return both.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), F.explode(F.coalesce(alone, F.array_compact(differing))).alias("field"))


def question_violations(questions: DataFrame, citations: DataFrame, categories: Sequence[str], provenances: Sequence[str]) -> DataFrame:
    """``id, violation`` of benchmark questions.

    Checks blank texts, unknown categories and provenances, repeated ids and texts (as ``question_key`` sees
    them), empty or repeated gold, gold that the corpus lacks, and gold of another act than the question's.
    """
    text = question_key(F.col("query"))
    simple = questions.select("id", F.explode(F.array_compact(F.array(
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("blank query")),
        F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), F.lit("category")),
        F.when(~F.coalesce(F.col("provenance").isin(*provenances), F.lit(False)), F.lit("provenance")),
        F.when(F.col("needs_legal_review").isNull(), F.lit("review flag")),
        F.when(F.coalesce(F.size("gold_citation_ids"), F.lit(0)) < 1, F.lit("no gold")),
        F.when(F.size(F.array_distinct("gold_citation_ids")) < F.size("gold_citation_ids"), F.lit("repeated gold")),
    ))).alias("violation"))
    again = duplicates(questions, ["id"]).select("id", F.lit("repeated id").alias("violation"))
    texts = questions.select("id", F.sha2(text, 256).alias("t"))
    same = texts.join(duplicates(texts.where("t IS NOT NULL"), ["t"]), "t", "left_semi").select("id", F.lit("repeated query").alias("violation"))
    gold = questions.select("id", "act", F.explode("gold_citation_ids").alias("citation_id")).join(citations.select("citation_id", F.col("act").alias("gold_act")), "citation_id", "left")
    wrong = F.when(F.col("gold_act").isNull(), F.lit("unknown gold")).when(F.col("act").isNotNull() & (F.col("act") != F.col("gold_act")), F.lit("gold of another act"))
    return simple.unionByName(again).unionByName(same).unionByName(gold.select("id", wrong.alias("violation")).where("violation IS NOT NULL").distinct())


def marker_faults(markers: DataFrame, group: Sequence[str], order: str, label: str) -> DataFrame:
    """Groups of sibling labels that are neither all missing nor a run without gaps in one numbering.

    A numbering is numbers (``1``, ``1A``, ``2``), roman numerals, or letters; each must be non-decreasing and
    cover 1 to its maximum without a repeated label.  Siblings of one parent only: bounded groups.
    """
    ordered = markers.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, label))).alias("rows"))
    labels = F.transform("rows", lambda r: F.regexp_replace(r[label], r"[()\s]", ""))

    def dense(values: Column) -> Column:
        whole = ~F.exists(values, lambda v: v.isNull())
        top = F.array_max(values)
        return whole & (F.array_sort(values) == values) & (F.array_distinct(values) == F.sequence(F.lit(1), F.greatest(top, F.lit(1))))

    number = F.transform("labels", lambda x: F.when(x.rlike(r"^\d+[A-Za-z]*$"), F.regexp_extract(x, r"^\d+", 0).try_cast("int")))
    once = F.size(F.array_distinct(F.transform("labels", F.upper))) == F.size("labels")
    good = F.coalesce(once & (dense(number) | dense(F.transform("labels", roman_value)) | dense(F.transform("labels", alpha_value))), F.lit(False))
    none = F.forall("labels", lambda x: x.isNull() | (x == ""))
    mixed = F.exists("labels", lambda x: x.isNull() | (x == ""))
    checked_rows = ordered.select(*group, labels.alias("labels"))
    fault = F.when(none, F.lit(None).cast("string")).when(mixed, F.lit("mixed")).when(~good, F.lit("not a run"))
    return checked_rows.select(*group, fault.alias("fault")).where("fault IS NOT NULL")
