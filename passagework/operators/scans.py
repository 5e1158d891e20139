"""Scans in which what a row decides depends on what earlier rows decided, over groups of any size.

No window function can tell such a state, but a stretch of rows is a function from the state before it to the state
behind it, and these functions can be chained.  Rows are dealt by range of group and order.  Each piece of a group
that lies in several parts is read once to make its function, as a small table; the tables are chained per group,
at most two for each part; then every piece is decided from its own incoming state, all in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from passagework.operators.ordered import PART, dealt
from passagework.sources.scratch import save_scratch


class Rule(Protocol):
    """How a scan over numbers goes on; a state is a number, or none before the first row."""

    output: T.DataType

    def table(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The function of a stretch of rows: states and what they become."""

    def after(self, keys: np.ndarray, outs: np.ndarray, state: float | None) -> float | None:
        """The state behind a stretch."""

    def decide(self, values: np.ndarray, state: float | None) -> tuple[np.ndarray, float | None]:
        """What each row gets, and the state behind them."""


@dataclass(frozen=True)
class Anchors:
    """A row that is ``width`` or more behind the anchor becomes the next anchor; values come in ascending order.  Rows get their anchor."""

    width: float
    output: T.DataType

    def table(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        following = np.searchsorted(values, values + self.width)
        last, jump = np.arange(len(values)), np.minimum(following, len(values) - 1)
        jump = np.where(following == len(values), last, jump)  # where a row's run is the last one, it stays
        while (jump[jump] != jump).any():
            jump = jump[jump]
        # an earlier anchor is at most the first value, so it can only be left at a row of the first row's run, or right behind it
        n = min(int(following[0]) + 1, len(values))
        ends = values[jump[:n]]
        kept = np.append(np.flatnonzero(ends[1:] != ends[:-1]), n - 1)  # of equal outcomes the last
        return values[:n][kept], ends[kept]

    def after(self, keys: np.ndarray, outs: np.ndarray, state: float | None) -> float | None:
        at = 0 if state is None else int(np.searchsorted(keys, state + self.width))
        return state if at == len(keys) else outs[at]

    def decide(self, values: np.ndarray, state: float | None) -> tuple[np.ndarray, float | None]:
        out, at = np.empty(len(values), values.dtype), 0
        if state is not None:
            at = int(np.searchsorted(values, state + self.width))
            out[:at] = state
        while at < len(values):
            state = values[at]
            end = int(np.searchsorted(values, state + self.width))
            out[at : max(end, at + 1)] = state
            at = max(end, at + 1)
        return out, state


@dataclass(frozen=True)
class Turns:
    """A row is accepted if its number is the next wanted one; ``first`` is wanted first.  Rows get whether they are."""

    first: int
    output: T.DataType = T.BooleanType()

    def table(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted: dict[int, int] = {}  # what a wanted number becomes, from the end
        for v in values[::-1].tolist():
            wanted[v] = wanted.get(v + 1, v + 1)
        keys = np.array(sorted(wanted), values.dtype)
        return keys, np.array([wanted[k] for k in keys.tolist()], values.dtype)

    def after(self, keys: np.ndarray, outs: np.ndarray, state: float | None) -> float | None:
        state = self.first if state is None else state
        at = int(np.searchsorted(keys, state))
        return outs[at] if at < len(keys) and keys[at] == state else state

    def decide(self, values: np.ndarray, state: float | None) -> tuple[np.ndarray, float | None]:
        state, out = self.first if state is None else state, np.zeros(len(values), bool)
        for i, v in enumerate(values.tolist()):
            if v == state:
                out[i], state = True, v + 1
        return out, state


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with what the small ``right`` has for their keys, which may be null."""
    other = right.select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(and_, (left[k].eqNullSafe(other[f"_of_{i}"]) for i, k in enumerate(keys)))
    return left.join(F.broadcast(other), same, "left").drop(*(f"_of_{i}" for i in range(len(keys))))


def _pieces(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """Keys, start and end of the runs of equal keys in a batch."""
    rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield rows[start], start, i
            start = i


def scanned(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, rule: Rule, name: str) -> DataFrame:
    """``rows`` with what ``rule`` gives each for its ``value``, a number that is never null, in the group's order.

    ``order`` tells the rows of a group apart.  A part's values of one group are held as one array.
    """
    keys = [PART, *group]
    placed = dealt(rows, group, order)
    found = placed.select(*keys).distinct().withColumn("_parts", F.count(F.lit(1)).over(W.partitionBy(*group))).where("_parts > 1")
    cut = _same_keys(placed.select(*keys, *dict.fromkeys([*order, value])), save_scratch(found, "cut"), keys).where("_parts > 1")
    fields = {f.name: f.dataType.simpleString() for f in placed.schema}
    kind, names = fields[value], rows.columns

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, now = None, [], None

        def table() -> pa.RecordBatch:
            made = rule.table(np.concatenate(held))
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(now, schema, strict=True)), *(pa.array([m.tolist()], pa.list_(number)) for m in made)], [*keys, "_keys", "_outs"])

        for batch in batches:
            schema, number = [batch.schema.field(k).type for k in keys], batch.schema.field(value).type
            values = batch.column(value).to_numpy(zero_copy_only=False)
            for key, start, end in _pieces(batch, keys):
                if held and key != now:
                    yield table()
                    held = []
                now = key
                held.append(values[start:end])
        if held:
            yield table()

    def chained(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, state, out = pieces.sort_values(PART), None, []
        for states, outs in zip(pieces["_keys"], pieces["_outs"], strict=True):
            out.append(state)
            state = rule.after(np.asarray(states), np.asarray(outs), state)
        return pieces.drop(columns=["_keys", "_outs"]).assign(_state=pd.Series(out, pieces.index, object))

    listed = ", ".join(f"{k} {fields[k]}" for k in keys)
    made = cut.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, value).mapInArrow(tables, f"{listed}, _keys array<{kind}>, _outs array<{kind}>")
    states = save_scratch(made.groupBy(*(group or [F.lit(0)])).applyInPandas(chained, f"{listed}, _state {kind}"), "states")
    ready = _same_keys(placed, states, keys).repartition(*keys).sortWithinPartitions(*keys, *order)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            values, given = batch.column(value).to_numpy(zero_copy_only=False), batch.column("_state")
            out = []
            for key, start, end in _pieces(batch, keys):
                if key != now:
                    now, state = key, given[start].as_py()
                mine, state = rule.decide(values[start:end], state)
                out.append(mine)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(out) if out else [], arrow)], [*names, name])

    arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[rule.output.simpleString()]
    return ready.mapInArrow(decided, T.StructType([*rows.schema.fields, T.StructField(name, rule.output)]))


def anchored(rows: DataFrame, group: Sequence[str], order: Sequence[str], width: float, name: str = "anchor") -> DataFrame:
    """Rows with the first value of their run in a column ``name``; ``order`` begins with the value.

    In a group's order a run ends where a value is ``width`` or more behind the run's first.
    """
    return scanned(rows, group, order, order[0], Anchors(width, rows.schema[order[0]].dataType), name)


def next_in_turn(rows: DataFrame, group: Sequence[str], order: Sequence[str], number: str, first: int = 1, name: str = "accepted") -> DataFrame:
    """Rows with whether their number is the one that was wanted, one more than the last accepted; ``first`` is wanted first."""
    return scanned(rows, group, order, number, Turns(first), name)
