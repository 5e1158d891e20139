"""Every registered query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from passagework.plans import registry
from passagework.sources.tables import TABLES

import __spark_entry__


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    got, want = ordered(registry.QUERIES[name](spark, sf_dir).toPandas()), ordered(duck.execute(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_rows_only_queries(spark, sf_dir):
    hits = registry.QUERIES["compress_extractive"](spark, sf_dir).toPandas()
    assert len(hits) and set(hits["compression_mode"]) <= {"extractive", "fallback_best", "skipped"}
    assert ((hits["compression_mode"] == "fallback_best") == hits["low_confidence"]).all()
    chunks = registry.QUERIES["passage_chunks"](spark, sf_dir).toPandas().sort_values(["doc_id", "fragment_index"])
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert chunks.groupby("doc_id")["text"].sum().to_dict() == texts[texts != ""].to_dict()
    assert (chunks["token_count"] <= 480).all()
