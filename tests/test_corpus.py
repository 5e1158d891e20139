"""A corpus as builds that belong together."""

import pytest
from pyspark.sql import functions as F

from passagework.plans import corpus as P

CITE = "BNS-2023-0123456789ab-S{}"


@pytest.fixture(scope="module")
def parts(spark):
    chunks = spark.createDataFrame([(f"c{i}", CITE.format(i // 2), "BNS" if i < 4 else "BSA", f"words of chunk {i} and {'theft' if i % 2 else 'bail'}") for i in range(6)], "chunk_id string, citation_id string, act string, text string")
    citations = spark.createDataFrame([(CITE.format(i), "BNS" if i < 2 else "BSA", f"/s/{i}") for i in range(3)], "citation_id string, act string, json_pointer string")
    vectors = spark.createDataFrame([(f"c{i}", [float(i % 2), float(1 - i % 2)]) for i in range(6)], "chunk_id string, embedding array<double>")
    return chunks, citations, vectors


def test_published_loaded_and_checked(spark, tmp_path, parts):
    root = str(tmp_path / "corpus")
    made = P.Corpus.publish(root, *parts)
    assert made.check() == {"status": "passed", "build_id": made.build_id, "count": 6, "counts_by_act": {"BNS": 4, "BSA": 2}}
    again = P.Corpus.publish(root, *parts)
    assert again.build_id == made.build_id and P.Corpus.load(spark, root).chunks.count() == 6
    questions = spark.createDataFrame([(1, "theft")], "query_id int, text string")
    near = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert {r["doc_id"] for r in made.search(questions, near, 3).collect()} == {"c1", "c3", "c5"}
    assert {r["doc_id"] for r in made.search(questions, near, 2, act="BSA").collect()} == {"c5", "c4"}
    changed = parts[0].withColumn("text", F.when(F.col("chunk_id") == "c2", "other words").otherwise(F.col("text")))
    newer = P.Corpus.publish(root, changed, *parts[1:])
    assert newer.build_id != made.build_id and newer.check()["count"] == 6
    row = F.when(F.col("chunk_id") == "c1", "x").otherwise(F.col("text"))
    changed.withColumn("text", row).write.mode("overwrite").parquet(f"{root}/chunks/builds/{newer.build_id}/chunks")
    with pytest.raises(ValueError, match="is not what was published"):
        P.Corpus.load(spark, root).check()


@pytest.mark.parametrize(
    ("which", "change", "fault"),
    [
        (0, lambda t: t.unionByName(t.limit(1)), "chunk ids that are not unique"),
        (1, lambda t: t.where("citation_id <> 'BNS-2023-0123456789ab-S1'"), "chunks without a citation"),
        (1, lambda t: t.withColumn("act", F.lit("BNS")), "chunks without a citation of their act"),
        (2, lambda t: t.where("chunk_id <> 'c3'"), "chunks and vectors differ"),
        (2, lambda t: t.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), "not of length 1"),
    ],
)
def test_faults_are_errors(spark, tmp_path, parts, which, change, fault):
    tables = list(parts)
    tables[which] = change(tables[which])
    with pytest.raises(ValueError, match=fault):
        P.Corpus.publish(str(tmp_path / "c"), *tables).check()


def test_citation_view(spark):
    hits = spark.createDataFrame([("a", "BNS", 1)], "citation_id string, act string, extra int")
    assert hits.select(P.citation_view(hits).alias("c")).first()["c"].asDict() == {"citation_id": "a", "act": "BNS", "header": None, "chunk_id": None}
