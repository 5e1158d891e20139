"""JSON of any depth and shape as Spark's VARIANT: values by pointer, and all leaves with their pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.jsontext import json_pointer_parts
from passagework.sources.scratch import save_scratch

#: What json_at and json_leaves need beside the columns that they are given.
_VALUE, _POINTER = "_value", "_pointer"


def kind_of(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``; null for a missing value."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def _below(value: Column, part: Column) -> Column:
    """What an object holds under the name ``part``, or an array at that place; null if it has none."""
    quote = F.when(part.contains("'"), F.lit('"')).otherwise(F.lit("'"))
    named = F.when(part.contains("'") & part.contains('"'), F.raise_error(F.lit("a name with both kinds of quotes can't be looked up")).cast("string"))
    by_name = F.coalesce(named, F.concat(F.lit("$["), quote, part, quote, F.lit("]")))
    by_place = F.when(part.rlike("^(0|[1-9][0-9]{0,8})$"), F.concat(F.lit("$["), part, F.lit("]")))
    return F.coalesce(F.try_variant_get(value, by_name, "variant"), F.try_variant_get(value, by_place, "variant"))


def json_at(rows: DataFrame, json: str, pointer: str, name: str = "found", *, max_parts: int | None = None) -> DataFrame:
    """``rows`` with the JSON text of what each row's RFC 6901 ``pointer`` names in its own ``json``.

    An empty pointer names the whole; what isn't there, a null pointer and a null text give null; a JSON null gives
    ``null``.  A pointer that doesn't begin with a slash, and a text that is no JSON, are errors.  ``max_parts`` bounds
    the pointers' parts; by default they are counted first.
    """
    valid = F.when((F.col(pointer) != "") & ~F.col(pointer).startswith("/"), F.raise_error(F.concat(F.lit("not a pointer: "), F.col(pointer))).cast("string")).otherwise(F.col(pointer))
    split = rows.withColumn(_POINTER, F.when(F.col(pointer) == "", F.array().cast("array<string>")).otherwise(json_pointer_parts(valid)))
    if max_parts is None:
        max_parts = split.agg(F.max(F.size(_POINTER))).first()[0] or 0
    found = split.withColumn(_VALUE, F.when(F.col(_POINTER).isNotNull(), F.parse_json(F.col(json))))
    for i in range(max_parts):
        part = F.get(_POINTER, F.lit(i))
        found = found.withColumn(_VALUE, F.when(part.isNull(), F.col(_VALUE)).otherwise(_below(F.col(_VALUE), part)))
    text = F.when(F.size(_POINTER) <= max_parts, F.to_json(F.col(_VALUE)))
    return found.withColumn(name, text).select(*rows.columns, name)


def json_leaves(rows: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """``keys``, ``pointer``, ``kind`` and ``value`` (JSON text) of all leaves: values that hold no others, empty objects and arrays too.

    One step for each level of the data, each written; no row is gathered.  A null text has no leaves, a text that is no JSON is an error.
    """
    session = rows.sparkSession
    level = rows.where(F.col(json).isNotNull()).select(*keys, F.lit("").alias("pointer"), F.parse_json(F.col(json)).alias(_VALUE))
    leaves = None
    while True:
        level = save_scratch(level.select(*keys, "pointer", F.to_json(_VALUE).alias("value"), kind_of(F.col(_VALUE)).alias("kind")), "leaves")
        holds = F.col("kind").isin("object", "array") & ~F.col("value").isin("{}", "[]")
        flat = level.where(~holds).select(*keys, "pointer", "kind", "value")
        leaves = flat if leaves is None else leaves.unionByName(flat)
        rest = level.where(holds)
        if rest.isEmpty():
            return leaves
        parsed = rest.select(*keys, "pointer", F.parse_json("value").alias("_held"))
        each = parsed.lateralJoin(session.tvf.variant_explode(F.col("_held").outer()))
        part = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        level = each.select(*keys, F.concat("pointer", F.lit("/"), part).alias("pointer"), F.col("value").alias(_VALUE))
