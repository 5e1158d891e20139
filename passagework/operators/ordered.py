"""Running values over ordered groups of any size.

Rows are dealt by range of group and order and written once, so a group that is a third of all rows is spread over a
third of the parts.  Each part computes its own running values by a window.  What it needs from earlier parts is
added from one row for each part of a group that lies in several: ranges cut at most the first and the last group of
a part, so these are at most two rows for each part, and only they are broadcast.  Rows that agree in group and order
stay in one part, so the order should tell rows apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passagework.sources.scratch import save_scratch

#: Column with the number of a row's part; parts of one group follow its order.
PART = "_part"


def dealt(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their part."""
    return save_scratch(rows.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()), "ordered")


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Dealt rows with running values of their group: name to kind and what is gathered.

    ``sum`` and ``last`` (not null) end with the row itself, ``max_before`` and ``previous`` with the row before it.
    What ``previous`` gathers must not be null, as a struct is; the first row of a group has none.
    """
    own = W.partitionBy(PART, *group).orderBy(*order)
    to_here, to_before = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    place = F.struct(*order)
    local, totals, carries, whole = {}, [], [], {}
    for i, (name, (kind, value)) in enumerate(values.items()):
        here, total, carry = f"_here{i}", f"_total{i}", f"_carry{i}"
        if kind == "sum":
            local[here], every, past = F.sum(value).over(to_here), F.sum(value), F.sum(total)
            whole[name] = F.col(here) + F.coalesce(F.col(carry), F.lit(0))
        elif kind == "max_before":
            local[here], every, past = F.max(value).over(to_before), F.max(value), F.max(total)
            whole[name] = F.greatest(here, carry)
        elif kind == "last":
            local[here], every, past = F.last(value, ignorenulls=True).over(to_here), F.max_by(value, F.when(value.isNotNull(), place)), F.last(total, ignorenulls=True)
            whole[name] = F.coalesce(here, carry)
        elif kind == "previous":
            local[here], every, past = F.lag(value).over(own), F.max_by(value, place), F.last(total, ignorenulls=True)
            whole[name] = F.coalesce(here, carry)
        else:
            raise ValueError(f"unknown kind {kind!r}")
        totals.append(every.alias(total))
        carries.append(past.over(earlier).alias(carry))
    keys = [PART, *group]
    parts = rows.groupBy(*keys).agg(*totals).withColumn("_parts", F.count(F.lit(1)).over(W.partitionBy(*group))).where("_parts > 1")
    cut = parts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *carries)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    both = rows.withColumns(local).join(F.broadcast(cut), same, "left")
    return both.select(*(whole.pop(c).alias(c) if c in whole else c for c in rows.columns), *(v.alias(name) for name, v in whole.items()))


def with_previous(rows: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str = "before") -> DataFrame:
    """Rows with the ``columns`` of the row before them in the group as a struct; the first has null."""
    return running(dealt(rows, group, order), group, order, {name: ("previous", F.struct(*columns))}).drop(PART)
