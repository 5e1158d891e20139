"""Joins by position: the n-th row of one table with the n-th of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.ordered import dealt, running

POSITION = "position"


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their ``position`` from 1 in ``order``, which must tell them apart; no task holds more than a range of them."""
    one = rows.withColumn("_all", F.lit(0))
    return running(dealt(one, ["_all"], order), ["_all"], order, {POSITION: ("sum", F.lit(1).cast("long"))}).select(*rows.columns, POSITION)


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` at its place; column names must differ.

    Tables of different lengths are an error when the result is read.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    a, b = numbered(left, left_order), numbered(right, right_order)
    both = a.withColumn("_left", F.lit(True)).join(b.withColumn("_right", F.lit(True)), POSITION, "full")
    whole = F.col("_left") & F.col("_right")
    place = F.when(whole.isNull(), F.raise_error(F.lit("the tables have different lengths")).cast("long")).otherwise(F.col(POSITION))
    return both.select(place.alias(POSITION), *left.columns, *right.columns)
