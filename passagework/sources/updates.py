"""Clustered tables with point reads, conditional updates that rewrite only what they touch, and verified chains of builds.

A table is a list of Parquet files in a manifest; the pointer of its root names the newest manifest.  An update finds the
files that hold rows to change, writes new ones in their place, and appends a manifest with the rest as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.sources.publish import current_build, point_to, publish_tables, read_published

FILES_SCHEMA = "path string"


def write_clustered(rows: DataFrame, path: str, by: str, ids: Sequence[str], *, filters: bool = True) -> None:
    """Write ``rows`` to a folder for each value of ``by``, sorted by ``ids`` and with Bloom filters on them.

    A hot value of ``by`` is spread over files by ranges of the ids, so a lookup by id reads few row groups: file and
    row group statistics skip what is sorted apart, and the filters skip the rest.
    """
    dealt = rows.repartitionByRange(by, *ids).sortWithinPartitions(by, *ids)
    out = dealt.write.mode("errorifexists").partitionBy(by)
    for column in ids if filters else ():
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
    out.parquet(path)


def read_point(spark: SparkSession, path: str, key: Mapping[str, Any]) -> DataFrame:
    """Rows of a clustered table with the given values; partition and id conditions reach the scan."""
    found = spark.read.parquet(path)
    for column, value in key.items():
        found = found.where(F.col(column) == F.lit(value))
    return found


def create_table(rows: DataFrame, root: str) -> None:
    """Write ``rows`` as the first version of the table under ``root``."""
    spark = rows.sparkSession
    if current_build(spark, root) is not None:
        raise FileExistsError(f"a table is published under {root}")
    _publish(spark, root, None, rows)


def _publish(spark: SparkSession, root: str, kept: DataFrame | None, fresh: DataFrame) -> None:
    version = uuid.uuid4().hex
    fresh.write.parquet(f"{root}/data/{version}")
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/data/{version}").select("path")
    files = names if kept is None else names.unionByName(kept)
    files.write.parquet(f"{root}/builds/{version}")
    point_to(spark, root, version)


def table_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of the files of the table's newest version."""
    now = current_build(spark, root)
    if now is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.schema(FILES_SCHEMA).parquet(f"{root}/builds/{now[1]}")


def read_versioned(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the table's newest version.  The names of its files go through the driver, as those of any scan do."""
    return spark.read.parquet(*[r["path"] for r in table_files(spark, root).orderBy("path").collect()])


def update_where(spark: SparkSession, root: str, keys: DataFrame, changes: Mapping[str, Column]) -> int:
    """Change the rows whose key columns (all of ``keys``) are in ``keys``; returns how many files were rewritten.

    Rows are picked by a semi-join; only files that hold one of them are read and written anew, and the new version takes over
    by one append to the pointer, so readers see all of an update or nothing.  A null key matches nothing.  Types stay as
    they are.  Where two writers update at once the loser is an error and may try again.
    """
    now, on = read_versioned(spark, root), keys.columns
    wanted = keys.dropna().distinct()
    source = F.col("_metadata.file_path")
    touched = now.select(*on, source.alias("path")).join(wanted, on, "left_semi").select("path").distinct()
    paths = [r["path"] for r in touched.collect()]
    if not paths:
        return 0
    hit = wanted.withColumn("_hit", F.lit(True))
    both = spark.read.schema(now.schema).parquet(*paths).join(hit, on, "left")
    kinds = dict(now.dtypes)
    changed = [F.when(F.col("_hit"), changes[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in now.columns]
    plain = lambda p: F.regexp_replace(F.url_decode(p), "^file:/+", "file:/")
    kept = table_files(spark, root).where(~plain(F.col("path")).isin([_plain(p) for p in paths]))
    _publish(spark, root, kept, both.select(*changed))
    return len(paths)


def _plain(path: str) -> str:
    head, _, rest = path.partition(":/")
    return unquote(f"{head}:/{rest.lstrip('/')}" if head == "file" else path)


def table_digest(rows: DataFrame) -> dict[str, str]:
    """Number of rows, schema, and a digest of a table's content that depends neither on the order of rows nor on how they are partitioned.

    Rows are hashed by their values in the order of the columns' names, nulls told from values, and the hashes of all rows are
    added up, so repeated rows count as often as they occur.  It finds changes, it is no protection against forgery.
    """
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    value = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`")), {"ignoreNullFields": "false"}) if isinstance(f.dataType, _NESTED) else F.col(f"`{f.name}`")
    parts = [x for f in fields for x in (value(f), F.col(f"`{f.name}`").isNull())]
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")).cast("string").alias(f"d{seed}") for seed in (0, 1)]
    row = rows.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    return {"rows": str(row["n"]), "schema": schema, "digest": f"{row['d0'] or 0}:{row['d1'] or 0}"}


_NESTED = (T.ArrayType, T.MapType, T.StructType)


def publish_chained(tables: Mapping[str, DataFrame], root: str, build_id: str, source: tuple[str, str] | None = None, about: Mapping[str, Any] | None = None) -> None:
    """Publish ``tables`` as a build whose manifest holds their digests, and of ``source`` (root and build id) the digest of its manifest."""
    spark = next(iter(tables.values())).sparkSession
    above = None if source is None else {"root": source[0], "build_id": source[1], "manifest": manifest_digest(spark, *source)}
    publish_tables(dict(tables), root, build_id, {**(about or {}), "digests": {n: table_digest(t) for n, t in tables.items()}, "source": above})


def manifest_digest(spark: SparkSession, root: str, build_id: str) -> str:
    text = spark.read.parquet(f"{root}/builds/{build_id}/manifest").select(F.sha2(F.col("manifest").cast("binary"), 256).alias("d"))
    return text.first()["d"]


def verified_chain(spark: SparkSession, root: str, build_id: str | None = None) -> list[dict[str, Any]]:
    """Manifests of a build and of all that it was made from, newest first, after their tables were read and compared with their digests.

    A changed, missing or additional row, another type, and a manifest that isn't the one that the next build was made from are errors.
    """
    chain: list[dict[str, Any]] = []
    while True:
        tables, manifest = read_published(spark, root, build_id)
        for name, table in tables.items():
            if table_digest(table) != manifest["digests"].get(name):
                raise ValueError(f"table {name} of build {manifest['build_id']} is not what was published")
        chain.append(manifest)
        source = manifest["source"]
        if source is None:
            return chain
        root, build_id = source["root"], source["build_id"]
        if manifest_digest(spark, root, build_id) != source["manifest"]:
            raise ValueError(f"build {build_id} is not the one that {manifest['build_id']} was made from")

