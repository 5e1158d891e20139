"""Checks and reports over a corpus' artifacts: joins that must match, provenance, counts, differences, answers.

What a check finds is a DataFrame of violations, or an error where the caller asks for one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from passagework.operators.ordered import with_previous
from passagework.operators.validation import duplicates, require_empty
from passagework.operators.verify import first_seen, grounded

# Fixed value: how far a table row may reach into the next before that counts.
ROW_SLACK = 1.5


def must_match(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with their one row of ``right``; a key that ``right`` lacks or has twice is an error."""
    require_empty(duplicates(right, key), "keys that are not unique")
    require_empty(left.select(*key).join(right.select(*key), list(key), "left_anti"), "keys without a match")
    return left.join(right, list(key))


def provenance_faults(reports: Mapping[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    """``field, values`` of the fields in which one-row reports differ, nulls included; equal reports give no rows."""
    rows = [df.select(F.lit(name).alias("report"), *(F.col(f).cast("string").alias(f) for f in fields)) for name, df in sorted(reports.items())]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    pairs = every.select("report", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("null")).alias("value")) for f in fields))).alias("x"))
    found = pairs.groupBy("x.field").agg(F.count_distinct("x.value").alias("n"), F.array_sort(F.collect_list(F.struct("report", "x.value"))).alias("values"))
    return found.where("n > 1").select("field", "values")


def count_faults(rows: DataFrame, group: str, expected: Mapping[str, int]) -> DataFrame:
    """Groups whose number of rows isn't the expected one: ``group, n, expected``; groups of one side only count as 0."""
    wanted = F.create_map(*(F.lit(x) for pair in expected.items() for x in pair)) if expected else F.create_map().cast("map<string,int>")
    listed = rows.sparkSession.createDataFrame([(g,) for g in expected], f"{group} string")
    counted = rows.groupBy(F.col(group).cast("string").alias(group)).agg(F.count(F.lit(1)).alias("n")).join(listed, group, "full")
    both = counted.select(group, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(wanted[F.col(group)], F.lit(0)).cast("long").alias("expected"))
    return both.where("n <> expected")


def manifest_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, value, n``: rows for each value of each field; a null counts under ``null``."""
    stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("value")) for f in fields)))
    return rows.select(stacked.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def failures(results: DataFrame) -> DataFrame:
    """``id, error`` of failed questions, by id."""
    return results.where("error IS NOT NULL").select("id", "error").orderBy("id")


def distinct_values(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """The sorted distinct values of each group, such as the pages of a section."""
    return rows.groupBy(*group).agg(F.array_sort(F.collect_set(value)).alias(name))


def chunk_report(chunks: DataFrame, tokens: str, target: int) -> DataFrame:
    """One row: ``n_chunks, max_tokens, above_target, chars`` of chunks with ``text`` and their number of tokens."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max(tokens).cast("long").alias("max_tokens"), F.count_if(F.col(tokens) > target).alias("above_target"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
    )


def row_overlaps(rows: DataFrame, group: Sequence[str], order: Sequence[str], start: str, end: str, slack: float = ROW_SLACK) -> DataFrame:
    """Rows that start more than ``slack`` before the row ahead of them ends, with that end as ``before``; ``order`` tells a group's rows apart."""
    seen = with_previous(rows, group, order, [end], "_ahead").withColumn("before", F.col("_ahead")[end])
    return seen.drop("_ahead").where(F.col(start) < F.col("before") - slack)


def vectors_by_id(vectors: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """Vectors of the asked ids; an id without one has no row."""
    return vectors.join(ids.select(key).distinct(), key, "left_semi")


def embedded(texts: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]], *, prefix: str = "", key: str = "chunk_id") -> DataFrame:
    """``key, embedding`` of ``key, text`` by an injected encoder that takes a list of texts.

    ``prefix`` goes before each text, as query encoders want it.  A null text has a null vector.  An encoder that
    returns another number of vectors than it was given texts is an error.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = batch["text"].notna().to_numpy()
            found = encode([prefix + t for t in batch["text"][given]]) if given.any() else []
            if len(found) != given.sum():
                raise ValueError("the encoder gave another number of vectors than texts")
            each = iter(found)
            yield pd.DataFrame({key: batch[key], "embedding": [list(map(float, next(each))) if g else None for g in given]})

    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<double>")


def without_keys(value: object, keys: frozenset[str]) -> object:
    """A JSON value without the named keys, at any depth."""
    if isinstance(value, dict):
        return {k: without_keys(v, keys) for k, v in value.items() if k not in keys}
    return [without_keys(v, keys) for v in value] if isinstance(value, list) else value


def json_without(text: Column, keys: Sequence[str]) -> Column:
    """JSON text without the named keys at any depth, compact; null for a null text."""
    dropped = frozenset(keys)

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else json.dumps(without_keys(json.loads(t), dropped), ensure_ascii=False, separators=(",", ":")) for t in batch.to_pylist()], pa.string())

    return run(text)


def differences(left: object, right: object) -> Iterator[str]:
    """Where two JSON values differ, in the order of the left one: ``$.name[0]: what``; what differs as a whole isn't looked into."""
    todo = [("$", left, right)]
    while todo:
        path, a, b = todo.pop()
        inside: list[tuple[str, object, object]] = []
        if type(a) is not type(b):
            yield f"{path}: different types"
        elif isinstance(a, dict):
            if a.keys() == b.keys():
                inside = [(f"{path}.{name}", value, b[name]) for name, value in a.items()]
            else:
                yield f"{path}: different keys"
        elif isinstance(a, list):
            if len(a) == len(b):
                inside = [(f"{path}[{i}]", *pair) for i, pair in enumerate(zip(a, b, strict=True))]
            else:
                yield f"{path}: different list lengths"
        elif a != b:
            yield f"{path}: different value"
        todo += reversed(inside)


@F.arrow_udf(T.StringType())
def first_difference(left: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The first difference of two JSON texts with its place and kind; null where they are equal or one is null."""
    for a, b in left:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        yield pa.array([None if x is None or y is None else next(differences(json.loads(x), json.loads(y)), None) for x, y in pairs], pa.string())


def zoned_timestamp(text: Column) -> Column:
    """Timestamp of an ISO-8601 text that names its offset from UTC; null without one or for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"), text.try_cast("timestamp"))


def prompt_key(system: Column, prompt: Column) -> Column:
    """Cache key of a prompt: SHA-256 of both parts with a line feed between."""
    return F.sha2(F.concat(system, F.lit("\n"), prompt), 256)


def kept_citations(cited: DataFrame, retrieved: DataFrame, known: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Citations of an answer that stay: the first of each id, if it was retrieved for the same question and is known.

    Group columns, ``value`` and ``position``, counted anew from 1.
    """
    first = first_seen(cited.where(F.col(value).isNotNull()), list(group), value, list(order))
    there = grounded(first, retrieved, [*group, value]).join(known.select(value).distinct(), value, "left_semi")
    position = F.row_number().over(W.partitionBy(*group).orderBy("position"))
    return there.withColumn("position", position).select(*group, value, "position")


def answered(hits: DataFrame, step: Callable[[Column, Column], Column]) -> DataFrame:
    """``query_id, query, answer`` by an injected step over the question and its passages in order.

    ``hits`` has ``query_id, query, citation_id, text, rank``; ``passages`` is an array of ``citation_id, text``, as long
    as a question has hits.
    """
    passages = F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation_id", "text"))), lambda h: F.struct(h["citation_id"].alias("citation_id"), h["text"].alias("text")))
    packed = hits.groupBy("query_id", "query").agg(passages.alias("passages"))
    return packed.select("query_id", "query", step(F.col("query"), F.col("passages")).alias("answer"))
