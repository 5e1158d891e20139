"""Intermediate tables in the folder that driver and executors share.

Iterative and two-pass operators cut their lineage here: a written table
survives the loss of any executor, and a lost task re-reads it instead of
recomputing the whole chain.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings for tables that are far larger on the way than when written.
FRUGAL = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "200", "spark.sql.parquet.columnarReaderBatchSize": "256"}
_local_folder: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and all runs in one process."""
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="passagework-")
    return _local_folder


def save_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark removes the shuffle files of a query when it ends, here: when its table is written, and reads and hands on few rows at once."""
    before = {key: spark.conf.get(key, None) for key in FRUGAL}
    for key, value in FRUGAL.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
