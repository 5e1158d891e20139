"""Checks and reports over artifacts, on small inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from passagework.functions.text import prompt
from passagework.operators import artifacts as A


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_joins_that_must_match(spark):
    left = spark.createDataFrame([("/a", 1), ("/b", 2)], "p string, n int")
    right = spark.createDataFrame([("/a", "x"), ("/b", "y"), ("/c", "z")], "p string, c string")
    assert rows(A.must_match(left, right, ["p"]), "n", "c") == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="without a match"):
        A.must_match(left, right.where("p <> '/a'"), ["p"])
    with pytest.raises(ValueError, match="not unique"):
        A.must_match(left, right.unionByName(right), ["p"])


def test_provenance_and_counts(spark):
    report = lambda h, n: spark.createDataFrame([(h, n)], "corpus_sha256 string, n int")
    same = {"bm25": report("x", 1), "dense": report("x", 1)}
    assert A.provenance_faults(same, ["corpus_sha256", "n"]).count() == 0
    found = A.provenance_faults({**same, "chunks": report(None, 1)}, ["corpus_sha256", "n"]).collect()
    assert [(r["field"], [tuple(v) for v in r["values"]]) for r in found] == [("corpus_sha256", [("bm25", "x"), ("chunks", "null"), ("dense", "x")])]
    acts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "act string")
    assert rows(A.count_faults(acts.where("act IS NOT NULL"), "act", {"a": 2, "b": 3, "c": 1}), "act", "n", "expected") == [("b", 1, 3), ("c", 0, 1)]
    assert rows(A.manifest_counts(acts, ["act"]), "field", "value", "n") == [("act", "a", 2), ("act", "b", 1), ("act", "null", 1)]
    assert A.count_faults(acts.where("false"), "act", {}).count() == 0


def test_reports(spark):
    results = spark.createDataFrame([("2", "late"), ("1", None), ("0", "bad")], "id string, error string")
    assert [r["id"] for r in A.failures(results).collect()] == ["0", "2"]
    pages = spark.createDataFrame([("s", 3), ("s", 1), ("s", 3)], "section string, page int")
    assert A.distinct_values(pages, ["section"], "page", "pages").first()["pages"] == [1, 3]
    chunks = spark.createDataFrame([("ab", 500), ("c", 3)], "text string, token_count int")
    assert rows(A.chunk_report(chunks, "token_count", 480), "n_chunks", "max_tokens", "above_target", "chars") == [(2, 500, 1, 3)]
    table = spark.createDataFrame([("t", 1, 0.0, 10.0), ("t", 2, 9.0, 20.0), ("t", 3, 17.0, 30.0)], "t string, i int, top double, bottom double")
    assert rows(A.row_overlaps(table, ["t"], ["i"], "top", "bottom"), "i", "before") == [(3, 20.0)]


def test_vectors(spark):
    table = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id int, embedding array<double>")
    assert rows(A.vectors_by_id(table, spark.createDataFrame([(2,), (2,), (9,)], "vec_id int")), "vec_id") == [(2,)]
    texts = spark.createDataFrame([("a", "xy"), ("b", None)], "chunk_id string, text string")
    assert rows(A.embedded(texts, lambda ts: [[len(t), 1] for t in ts], prefix="query: "), "chunk_id", "embedding") == [("a", [9.0, 1.0]), ("b", None)]
    with pytest.raises(Exception, match="another number"):
        A.embedded(texts, lambda ts: []).collect()


def test_json(spark):
    assert one(spark, A.json_without(F.lit('{"row_id": 1, "a": [{"row_id": 2, "b": "ü"}]}'), ["row_id"])) == '{"a":[{"b":"ü"}]}'
    assert one(spark, A.json_without(F.lit(None).cast("string"), ["x"])) is None
    cases = (
        ('{"a": [1, 2]}', '{"a": [1, 3]}', "$.a[1]: different value"), ("1", "1.0", "$: different types"), ('{"a": 1}', '{"b": 1}', "$: different keys"), ("[1]", "[2, 2]", "$: different list lengths"),
        ('{"a": {"b": []}}', '{"a": {"b": {}}}', "$.a.b: different types"), ('{"a": null}', '{"a": null}', None), ("true", "1", "$: different types"), ('{"x": {"y": 1}, "a": 2}', '{"a": 3, "x": {"z": 1}}', "$.x: different keys"),
    )
    for a, b, want in cases:
        assert one(spark, A.first_difference(F.lit(a), F.lit(b))) == want


def test_times_and_keys(spark):
    good = [one(spark, A.zoned_timestamp(F.lit(t)).cast("string")) for t in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+05:30")]
    assert good == ["2024-01-02 03:04:05", "2024-01-01 21:34:05.5"]
    assert all(one(spark, A.zoned_timestamp(F.lit(t))) is None for t in ("2024-01-02T03:04:05", "2024-01-02", "2024-13-02T03:04:05Z", "x"))
    assert one(spark, A.prompt_key(F.lit("s"), F.lit("ü"))) == hashlib.sha256("s\nü".encode()).hexdigest()


def test_answers(spark):
    cited = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (1, None, 5), (2, "a", 1)], "q int, citation_id string, at int")
    retrieved = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (2, "b")], "q int, citation_id string")
    known = spark.createDataFrame([("c",), ("a",), ("a",)], "citation_id string")
    assert rows(A.kept_citations(cited, retrieved, known, ["q"], "citation_id", ["at"]), "q", "citation_id", "position") == [(1, "a", 1), (1, "c", 2)]
    hits = spark.createDataFrame([(1, "q?", "b", "two", 2), (1, "q?", "a", "one", 1)], "query_id int, query string, citation_id string, text string, rank int")
    assert A.answered(hits, prompt).first()["answer"] == "Question: q?\n\nContext:\n[a] one\n\n[b] two"
