"""Order statistics and ranks that don't bring a group's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passagework.operators.ordered import dealt as ordered_parts
from passagework.operators.ordered import running
from passagework.sources.scratch import save_scratch


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank; the plan limits each partition before the shuffle."""
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank).cast("long"))


def distributed_rank(rows: DataFrame, group: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """All rows with their 1-based rank in the group; rows that agree in ``order`` are numbered as they come.

    Rows are dealt by range of group, order and their place in the input, numbered within a part, and shifted by what the earlier
    parts hold; a group, or a single value, that is a third of all rows is spread over a third of the parts.
    """
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = save_scratch(placed.repartitionByRange(*group, *order, "_tie").withColumn("_part", F.spark_partition_id()), "ranked")
    part = ["_part", *group]
    local = F.row_number().over(W.partitionBy(*part).orderBy(*order, "_tie"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    same = dealt.withColumn("_local", local).alias("d").join(counts.alias("c"), [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in part])
    return same.select("d.*", (F.col("d._local") + F.col("c._before")).alias(rank)).drop("_part", "_local", "_tie")


def percentiles(rows: DataFrame, group: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Group columns, ``n``, and ``p<point>`` for each point: percentiles with linear interpolation between ranks.

    Null values are left out; a group without values has none; a value that isn't finite is an error.  Equal values
    are counted before they are dealt, so neither a group's values nor the rows of one value are one task's work.
    """
    number = F.col(value).cast("double")
    finite = F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(number)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, finite.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_all", F.lit(0))
    every = ["_all", *group]
    ranked = running(ordered_parts(counted, every, ["_v"]), every, ["_v"], {"_upto": ("sum", F.col("_n"))}).withColumn("_from", F.col("_upto") - F.col("_n") + 1)
    sizes = ranked.groupBy(*every).agg(F.max("_upto").alias("n"))
    joined = ranked.alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in every])
    holds = lambda rank: (F.col("r._from") <= rank) & (rank <= F.col("r._upto"))
    picks, near = [], F.lit(False)
    for p in points:
        at = (F.col("s.n") - 1) * (p / 100) + 1
        low, high = (F.max(F.when(holds(rank), F.col("r._v"))) for rank in (F.floor(at), F.ceil(at)))
        picks.append((low + (high - low) * F.first(at - F.floor(at))).alias(f"p{p:g}"))
        near = near | holds(F.floor(at)) | holds(F.ceil(at))
    return joined.where(near).groupBy(*(F.col(f"r.{c}").alias(c) for c in group)).agg(F.first("s.n").alias("n"), *picks)
