"""Nearest rows on a line, and groups of rows around baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.scans import anchored
from passagework.operators.structure import as_of


def nearest_within(rows: DataFrame, lookup: DataFrame, on: Sequence[str], position: str, values: Sequence[str], tolerance: float, *, name: str = "near") -> DataFrame:
    """Rows with the nearest position of ``lookup`` (``on``, ``position``, ``values``) in their group, if it is less than ``tolerance`` away.

    ``<name>_<position>`` and ``values`` are null where none is.  Of two at one distance the lower one counts, of
    several at one place the one with the largest values.  The nearest is the last one before or the first one
    behind, so both sides are laid in one order and carried forward and backward: rows are never paired within a
    band, and a hot group is spread over many tasks.  ``on`` and ``position`` are never null.
    """
    at, back = f"{name}_{position}", "_turned"
    held = lookup.select(*on, position, F.struct(F.col(position).alias("at"), *values).alias("_below"))
    below = as_of(rows, held, on, position, ["_below"])
    turned = held.select(*on, (-F.col(position)).alias(back), F.col("_below").alias("_above"))
    both = as_of(below.withColumn(back, -F.col(position)), turned, on, back, ["_above"]).drop(back)
    low, high = F.col(position) - F.col("_below.at"), F.col("_above.at") - F.col(position)
    picked = F.when(F.col("_below").isNotNull() & (low < tolerance) & (F.col("_above").isNull() | (low <= high)), F.col("_below")).when(high < tolerance, F.col("_above"))
    return both.withColumn("_picked", picked).select(*rows.columns, F.col("_picked.at").alias(at), *(F.col("_picked")[v].alias(v) for v in values))


def baselines(rows: DataFrame, group: Sequence[str], position: str, order: Sequence[str], tolerance: float, *, name: str = "baseline") -> DataFrame:
    """Rows with the baseline that they stand on: going up, a row that is ``tolerance`` or more behind the latest baseline begins its own.

    ``order`` tells rows of one position apart.
    """
    return anchored(rows, group, [position, *order], tolerance, name)
