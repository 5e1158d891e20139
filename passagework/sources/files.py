"""JSON, JSONL, binary and vector sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.vectors import is_finite
from passagework.operators.validation import checked


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON; a malformed file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped and malformed ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, sha256, content`` of files, for an injected page parser."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def usable_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages as they are, failing on one without text or with unmapped glyphs or replacement characters."""
    good = F.col(text).rlike(r"\S") & ~F.col(text).contains("(cid:") & ~F.col(text).contains("�") & ~F.col(text).contains("\u0000")
    return checked(pages, good, "a page has no usable text")


def read_vectors(spark: SparkSession, path: str, dim: int, column: str = "embedding") -> DataFrame:
    """A vector table, failing on a row of another length or with a component that isn't finite."""
    vectors = spark.read.parquet(path)
    return checked(vectors, (F.size(column) == dim) & is_finite(F.col(column)), f"a vector doesn't have {dim} finite components")


def remove_folios(lines: DataFrame) -> DataFrame:
    """Lines (``page, text, y, height``) without the one at the foot that is the page's number; one per page is required."""
    folio = (F.trim("text") == F.col("page").cast("string")) & (F.col("y") > F.col("height") - 80)
    marked = lines.withColumn("_folio", F.coalesce(folio, F.lit(False)))
    counts = marked.groupBy("page").agg(F.count_if("_folio").alias("_n"))
    checked_pages = checked(counts, F.col("_n") == 1, "a page must have exactly one folio")
    return marked.join(checked_pages, "page").where("NOT _folio").drop("_folio", "_n")
