"""Ordered structure: runs, intervals, as-of lookups, sequences and trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.ordered import PART, dealt, running, with_previous
from passagework.sources.scratch import save_scratch


def _numbered(parts: DataFrame, group: Sequence[str], order: Sequence[str], starts: Column, run: str) -> DataFrame:
    """Dealt rows with the number of their run; ``starts`` is never null and true for a group's first row."""
    return running(parts, group, order, {run: ("sum", starts.cast("int"))}).drop(PART)


def runs(rows: DataFrame, group: Sequence[str], order: Sequence[str], starts: Column, run: str = "run", before: Sequence[str] = ()) -> DataFrame:
    """Rows with the number of their run, counted from 1; ``starts`` is true where one begins.

    The first row of a group always begins a run.  ``starts`` may use the columns ``before`` of the row before, as ``_before.<column>``.
    """
    seen = running(dealt(rows, group, order), group, order, {"_before": ("previous", F.struct(*before, F.lit(1).alias("_any")))})
    return _numbered(seen, group, order, F.col("_before").isNull() | F.coalesce(starts, F.lit(False)), run).drop("_before")


def gap_runs(rows: DataFrame, group: Sequence[str], position: str, order: Sequence[str], gap: Column, run: str = "run") -> DataFrame:
    """Runs that break where ``position`` is more than ``gap`` after the row before."""
    seen = running(dealt(rows, group, order), group, order, {"_before": ("previous", F.struct(F.col(position).alias("at")))})
    starts = F.coalesce(F.col(position) > F.col("_before.at") + gap, F.lit(False))
    return _numbered(seen, group, order, F.col("_before").isNull() | starts, run).drop("_before")


def carry_forward(rows: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each of ``values`` filled with the last value before it in the group that isn't null."""
    return running(dealt(rows, group, order), group, order, {v: ("last", F.col(v)) for v in values}).drop(PART)


def merge_intervals(rows: DataFrame, group: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Touching and overlapping intervals of a group as one: group columns, ``start``, ``end``, ``n``.

    Equal intervals are counted before they are dealt.
    """
    distinct = rows.groupBy(*group, F.col(start).alias("start"), F.col(end).alias("end")).agg(F.count(F.lit(1)).alias("_n"))
    order = ["start", "end"]
    seen = running(dealt(distinct, group, order), group, order, {"_before": ("previous", F.struct("start")), "_reach": ("max_before", F.col("end"))})
    marked = _numbered(seen, group, order, F.col("_before").isNull() | F.coalesce(F.col("start") > F.col("_reach"), F.lit(False)), "_run")
    merged = marked.groupBy(*group, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("n"))
    return merged.drop("_run")


def interval_gaps(merged: DataFrame, group: Sequence[str]) -> DataFrame:
    """What lies between the merged intervals of a group: group columns, ``start``, ``end``."""
    seen = with_previous(merged.select(*group, "start", "end"), group, ["start"], ["end"], "_before")
    return seen.where("_before IS NOT NULL AND start IS NOT NULL").select(*group, F.col("_before.end").alias("start"), F.col("start").alias("end"))


def subtract_intervals(total: DataFrame, removed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Parts of each group's one interval (``start, end``) that no removed interval covers; empty parts are left out."""
    edges = total.select(*group, F.col("start").alias("start"), F.col("start").alias("end")).unionByName(total.select(*group, F.col("end").alias("start"), F.col("end").alias("end")))
    bounds = total.select(*group, F.col("start").alias("_low"), F.col("end").alias("_high"))
    inside = removed.join(bounds, list(group)).select(*group, F.greatest("start", "_low").alias("start"), F.least("end", "_high").alias("end")).where("start < end")
    gaps = interval_gaps(merge_intervals(edges.unionByName(inside), group), group)
    return gaps.where("start < end")


def coverage_faults(spans: DataFrame, group: Sequence[str], length: str, start: str = "char_start", end: str = "char_end") -> DataFrame:
    """Groups whose spans don't tile ``0..length``: group columns and ``fault`` (start, gap, empty or end)."""
    before = F.col("_before")[end]
    fault = F.when(F.col(start) >= F.col(end), F.lit("empty")).when(before.isNull() & (F.col(start) != 0), F.lit("start")).when(before != F.col(start), F.lit("gap"))
    checked = with_previous(spans.select(*group, start, end, length), group, [start, end], [end], "_before").withColumn("_fault", fault)
    last = F.when(F.max(end) != F.max(length), F.lit("end"))
    return checked.groupBy(*group).agg(F.coalesce(F.min("_fault"), last).alias("fault")).where("fault IS NOT NULL")


def sequence_gaps(rows: DataFrame, group: Sequence[str], number: str, order: Sequence[str] | None = None) -> DataFrame:
    """Rows whose number is not one more than the row before; the first of a group must be 1."""
    seen = with_previous(rows, group, order or [number], [number], "_before")
    checked = seen.withColumn("expected", F.coalesce(F.col("_before")[number] + 1, F.lit(1)))
    return checked.where(F.col(number) != F.col("expected")).drop("_before")


def as_of(rows: DataFrame, lookup: DataFrame, on: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """Rows with ``values`` of the last lookup row at or before their ``position`` in the group; null before the first.

    Both sides are laid in one order and the values carried forward, so the work is no range join.
    Of several lookup rows at one position the one with the largest values counts.
    """
    latest = lookup.groupBy(*on, position).agg(F.max(F.struct(*values)).alias("_found"))
    kind = latest.schema["_found"].dataType
    both = rows.withColumns({"_found": F.lit(None).cast(kind), "_side": F.lit(1)}).unionByName(latest.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    filled = carry_forward(both, on, [position, "_side"], ["_found"]).where("_side = 1")
    return filled.select(*rows.columns, *(F.col("_found")[v].alias(v) for v in values))


def nearest_boundary(position: Column, boundaries: Sequence[float], slack: float = 1.7) -> Column:
    """0-based index of the last boundary at or before ``position`` plus ``slack``, and 0 before the first."""
    at = F.array(*(F.lit(float(b)) for b in sorted(boundaries)))
    return F.greatest(F.lit(0), F.size(F.filter(at, lambda b: b - slack <= position)) - 1)


def bounding_boxes(rows: DataFrame, group: Sequence[str], x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


def descendants(edges: DataFrame) -> DataFrame:
    """``ancestor, descendant, depth`` of a forest of ``parent, child`` edges, of any depth.

    One join per level; each level is written.  A node that lies below itself is an error.
    """
    edges = edges.select("parent", "child")
    level = out = save_scratch(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")), "tree")
    while True:
        n, cycle = level.agg(F.count(F.lit(1)), F.bool_or(F.col("ancestor") == F.col("descendant"))).first()
        if cycle:
            raise ValueError("the edges have a cycle")
        if not n:
            return out
        step = level.join(edges, level["descendant"] == edges["parent"]).select("ancestor", F.col("child").alias("descendant"), (F.col("depth") + 1).alias("depth"))
        level = save_scratch(step, "tree")
        out = out.unionByName(level)
