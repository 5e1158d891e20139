"""Versioned builds behind a pointer, append-only audit rows, and small JSON reports."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a report must not be written to.
GUARDED = ("data", "reference", "backend")
POINTER_SCHEMA = "seq long, build_id string"


def publish_build(df: DataFrame, root: str, build_id: str) -> str:
    """Write ``df`` to the folder of its build, unless that is complete already, and point ``root`` at it.

    Spark's commit marks a build complete; the pointer is a table of its own with one appended row per swap,
    the newest of which counts.  Publishing what is current already changes nothing.
    """
    spark = df.sparkSession
    path = f"{root}/builds/{build_id}"
    if not _complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    point_to(spark, root, build_id)
    return path


def point_to(spark: SparkSession, root: str, build_id: str) -> None:
    """Append a swap to the pointer; of swaps with one number, which two writers at once may make, the larger build id counts."""
    now = current_build(spark, root)
    if now is None or now[1] != build_id:
        seq = 0 if now is None else now[0] + 1
        spark.createDataFrame([(seq, build_id)], POINTER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    if current_build(spark, root)[1] != build_id:
        raise RuntimeError("the pointer was moved by another writer")


def _complete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def current_build(spark: SparkSession, root: str) -> tuple[int, str] | None:
    if not _complete(spark, f"{root}/pointer"):
        return None
    row = spark.read.schema(POINTER_SCHEMA).parquet(f"{root}/pointer").orderBy(F.desc("seq"), F.desc("build_id")).first()
    return (row["seq"], row["build_id"]) if row else None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The build that the pointer names now; the path is resolved once, so a later swap doesn't change the result."""
    now = current_build(spark, root)
    if now is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/builds/{now[1]}")


def publish_tables(tables: dict[str, DataFrame], root: str, build_id: str, about: dict[str, Any]) -> None:
    """Write several tables as one build with a manifest of ``about`` and the row counts, and point ``root`` at it.

    The manifest is written last, so a build without one is incomplete and is written anew.
    """
    spark = next(iter(tables.values())).sparkSession
    path = f"{root}/builds/{build_id}"
    if not _complete(spark, f"{path}/manifest"):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows = {name: spark.read.parquet(f"{path}/{name}").count() for name in tables}
        text = json.dumps({**about, "build_id": build_id, "rows": rows}, sort_keys=True)
        spark.createDataFrame([(text,)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    point_to(spark, root, build_id)


def read_published(spark: SparkSession, root: str, build_id: str | None = None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Tables and manifest of a build, by default the one that the pointer names; fails if it is incomplete or a count differs."""
    if build_id is None:
        now = current_build(spark, root)
        build_id = now[1] if now else None
    path = f"{root}/builds/{build_id}"
    if build_id is None or not _complete(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"no complete build {build_id} under {root}")
    manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["rows"]}
    if manifest["build_id"] != build_id or any(tables[name].count() != n for name, n in manifest["rows"].items()):
        raise ValueError(f"build {build_id} does not fit its manifest")
    return tables, manifest


def snapshot_id(spark: SparkSession, path: str) -> str:
    """Identity of the Parquet files under ``path``, by their names, lengths and times of change; no file is opened."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet").load(path)
    n, total = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n}-{int(total or 0) % (1 << 64):016x}"


def audit_status(response: Any, error: str | None, response_error: str | None = None) -> str:
    """``completed`` with a response and no error, else ``failed``, which needs an error that isn't blank."""
    if response is not None and error is None and response_error is None:
        return "completed"
    if not (error or response_error or "").strip():
        raise ValueError("a failed request needs an error")
    return "failed"


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows; the write is committed whole or not at all."""
    rows.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(report: dict[str, Any], path: str | Path, base: str | Path = ".") -> None:
    """Write a small report as JSON with sorted keys, by a temporary file that then takes its place.

    Only ``.json`` files outside the guarded folders of ``base`` are written, and numbers must be finite.
    """
    target, top = Path(path).resolve(), Path(base).resolve()
    inside = target.relative_to(top).parts[:1] if target.is_relative_to(top) else ()
    if target.suffix != ".json" or (inside and inside[0] in GUARDED):
        raise ValueError(f"a report can't be written to {path}")
    text = json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"
    waiting = target.with_suffix(".json.tmp")
    with open(waiting, "w", encoding="utf-8", newline="\n") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(waiting, target)
