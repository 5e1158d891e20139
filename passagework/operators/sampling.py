"""Deterministic strided samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.ranking import distributed_rank


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def strided_sample(rows: DataFrame, group: Sequence[str], order: str, *, seed: int, stride: int, per_group: int) -> DataFrame:
    """Rows at ``(seed + i * stride) mod n`` of each group in order, for ``i`` below ``per_group``, with that ``i``.

    A group that is smaller than ``per_group``, or whose size shares a factor with the stride, is an error.
    The pools are numbered without bringing one into a task; only their sizes come to the driver.
    """
    if min(seed, stride - 1, per_group - 1) < 0:
        raise ValueError("seed, stride and per_group are out of range")
    ranked = distributed_rank(rows, group, [order], "_rank")
    sizes = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    for row in sizes.select("_n").distinct().collect():
        if row["_n"] < per_group or _gcd(stride, row["_n"]) != 1:
            raise ValueError(f"a pool of {row['_n']} can't be sampled by stride {stride}")
    wanted = sizes.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))))
    at = (F.lit(seed) + F.col("sample_index").cast("long") * stride) % F.col("_n") + 1
    wanted = wanted.select(*group, "sample_index", at.alias("_rank"))
    return ranked.join(wanted, [*group, "_rank"]).drop("_rank")
