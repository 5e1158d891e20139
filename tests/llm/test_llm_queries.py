"""Registered queries of the training-data operators, and the pipeline stage by stage."""

import duckdb
import pandas as pd
import pytest

pytest.importorskip("passagework.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from passagework.llm import queries as Q  # noqa: E402

import __spark_entry__  # noqa: E402


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = (df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True) for df in (Q.QUERIES[name](spark, sf_dir).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"] for r in out.collect()}
        assert kept[name] <= {r["doc_id"] for r in docs.collect()}
        if name == "near_duplicates":
            groups = Q.near_duplicates(docs).toPandas()
            assert kept[name] == set(groups["component_id"])
        docs = out
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(last["doc_id"]) == kept["near_duplicates"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert set(labels.loc[labels["quality"] == 1, "doc_id"]) <= kept["quality"]
    run = pipeline.run(spark, sf_dir).toPandas()
    assert len(run) == len(last) and set(run["doc_id"]) == set(last["doc_id"])


def test_pipeline_stages_on_odd_documents(spark, sf_dir):
    texts = [None, "", " \n", "A tie of words that is long enough.", "A tie of words that is long enough.", "word " * 30000, "é 你好 😀"]
    rows = [(i, t, None, None, None, "Text", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 5, None, None), (None, "without an id", "en", "s", 5, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        found = [r["doc_id"] for r in out.collect()]
        assert None in found and set(found) <= {r["doc_id"] for r in docs.collect()}
        if name == "near_duplicates":
            assert 4 not in found and found.count(3) == 1 and {0, 1, 2, 6} <= set(found)
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_pipeline_keeps_one_of_rows_without_ids(spark, sf_dir):
    copy, other, own = ("tie of words that is long enough " + w for w in ("one", "two", "three"))
    texts = [(None, copy), (None, copy), (None, other * 3), (None, other * 3), (-5, copy), (-5, copy), (7, own * 5), (8, own * 5), (7, "another text of the same id"), (9, None), (9, None), (None, None), (None, None), (None, " "), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    out = pipeline.distinct(spark, docs, sf_dir)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left == sorted([(-5, copy), (None, other * 3), (7, own * 5), (7, "another text of the same id"), (9, None), (None, None), (None, None), (None, " "), (None, " ")], key=str)
