"""The retriever over texts, the answer call, and checks of citations."""

import json
import math

import pytest
from pyspark.sql import functions as F

from passagework.operators import bm25, metrics, verify
from passagework.operators.rerank import overlap_scorer
from passagework.plans import answers as A

CITE = "BNS-2023-0123456789ab-S{}"
PASSAGES = [(1, CITE.format(1), "Theft is taking property. Cows eat grass."), (2, CITE.format(2), "Robbery is theft with force."), (3, CITE.format(3), "Bail may be granted."), (4, "SCHEDULE-4", "Theft of a form.")]


def encoder():
    """Vectors by the letters of a text; a function that workers get by value."""

    def encode(texts):
        out = []
        for t in texts:
            assert t.startswith(A.QUERY_PREFIX)
            v = [float(t[len(A.QUERY_PREFIX) :].lower().count(c)) for c in "tbr"]
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return encode


encode = encoder()


def tables(spark):
    passages = spark.createDataFrame(PASSAGES, "doc_id long, citation_id string, text string")
    vectors = spark.createDataFrame([(i, [float(i == 1), float(i == 3), float(i == 2)], "A" if i < 3 else "B") for i in (1, 2, 3)], "vec_id long, embedding array<double>, act string")
    return passages, vectors


def test_questions_are_encoded_once_and_checked(spark):
    _, vectors = tables(spark)
    asked = spark.createDataFrame([(1, "  ttt ", None), (2, "bbb", "A"), (3, " ", None), (4, None, "A")], "query_id long, text string, act string")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in A.dense_search(vectors, asked, encode, 2, act="act").collect()}
    assert got[1, 1] in (1, 2) and {v for (q, _), v in got.items() if q == 2} == {1, 2} and {q for q, _ in got} == {1, 2}
    assert {r["query_id"] for r in A.dense_search(vectors, asked.drop("act"), encode, 1).collect()} == {1, 2}
    with pytest.raises(Exception, match="more than 5 tokens"):
        A.query_vectors(asked, encode, limit=5)
    for bad in ([2.0, 0.0, 0.0], [float("nan"), 0.0, 0.0]):
        with pytest.raises(Exception, match="not of length 1"):
            A.query_vectors(asked, lambda texts, v=bad: [v for _ in texts])


def model(query, passages):
    """A step that cites the first passage, what it was told to, and the first again; some questions break it."""
    claims = F.concat(F.array(passages[0]["citation_id"]), F.filter(F.split(F.regexp_extract(query, "cite (.*)", 1), " "), lambda c: c != ""), F.array(passages[0]["citation_id"]))
    answer = F.to_json(F.struct(F.concat(F.lit("By "), passages[0]["text"]).alias("answer"), claims.alias("citations"), F.lit(0.5).alias("confidence"), F.lit("scenario").alias("query_type")))
    return F.when(query.contains("offline"), F.lit(None).cast("string")).when(query.contains("garble"), "no object").otherwise(F.concat(F.lit("Sure: "), answer))


def test_answers_are_checked(spark):
    other = CITE.format(9)
    texts = ["theft", f"robbery cite {CITE.format(1)} {other} x", "offline", "garble", " ", None, "nothing found", "form cite SCHEDULE-4"]
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    hits = spark.createDataFrame([(i, c, t, r) for i in (0, 1, 2, 3, 4, 7) for r, (_, c, t) in enumerate(PASSAGES, 1)] + [(0, CITE.format(1), "again", 9)], "query_id long, citation_id string, text string, rank int")
    known = spark.createDataFrame([(c,) for _, c, _ in PASSAGES if c != CITE.format(2)], "citation_id string")
    got = {r["query_id"]: r.asDict() for r in A.answers_from_hits(questions, hits, model, known).collect()}
    assert set(got) == set(range(8))
    assert got[0]["answer"] == "By " + PASSAGES[0][2] and got[0]["citations"] == [CITE.format(1)] and got[0]["citations_valid"] and got[0]["retrieved"] == [c for _, c, _ in PASSAGES]
    assert (got[1]["citations"], got[1]["flags"], got[1]["citations_valid"]) == ([CITE.format(1)], [other, "x"], False)
    assert (got[2]["error"], got[3]["error"], got[2]["answer"], got[3]["citations_valid"]) == (A.UNAVAILABLE, A.PARSE_ERROR, None, None) and got[3]["retrieved"]
    for i in (4, 5, 6):
        assert (got[i]["answer"], got[i]["error"], got[i]["retrieved"], got[i]["citations_valid"]) == (None, None, [], None)
    assert (got[7]["citations"], got[7]["flags"], got[7]["citations_valid"]) == ([CITE.format(1)], [], False)  # retrieved, but no section's citation
    free = {r["query_id"]: r for r in A.answers_from_hits(questions, hits, model).collect()}
    assert free[0]["citations_valid"] and not free[7]["citations_valid"]
    audit = A.audit_rows(A.answers_from_hits(questions, hits, model), F.lit("2024-01-01").cast("timestamp"))
    assert {r["query_id"]: r["status"] for r in audit.collect()} == {i: "failed" if i in (2, 3) else "completed" for i in range(8)}


def test_whole_call(spark):
    passages, vectors = tables(spark)
    questions = spark.createDataFrame([(1, "Theft is taking property?"), (2, " "), (3, "bail")], "query_id long, text string")
    index = bm25.build_index(passages)
    got = {r["query_id"]: r for r in A.answer_questions(questions, index, vectors, passages, encode, overlap_scorer(), model, k=2).collect()}
    assert set(got) == {1, 2, 3} and got[2]["answer"] is None and len(got[1]["retrieved"]) == 2
    assert got[1]["answer"].startswith("By Theft is taking property.") and "Cows" not in got[1]["answer"] and got[3]["retrieved"][0] == CITE.format(3)


def test_citations_with_reasons(spark):
    cited = spark.createDataFrame([(1, CITE.format(1), 1), (1, "odd", 2), (1, CITE.format(1), 3), (1, CITE.format(7), 4), (2, None, 1)], "q int, citation_id string, at int")
    known = spark.createDataFrame([(CITE.format(1),)], "citation_id string")
    got = [(r["q"], r["citation_id"], r["position"], r["reason"]) for r in verify.checked_citations(cited, known, ["q"], ["at"]).orderBy("q", "position").collect()]
    assert got == [(1, CITE.format(1), 1, None), (1, "odd", 2, "malformed"), (1, CITE.format(7), 3, "not found"), (2, None, 1, "malformed")]
    assert verify.resolved(cited.where("at IN (1, 3) AND q = 1"), known).count() == 2
    for condition, why in (("at = 2", "odd is malformed"), ("at = 4", "S7 is not found")):
        with pytest.raises(Exception, match=why):
            verify.resolved(cited.where(condition), known).collect()


def test_run_gate():
    gate = metrics.run_gate
    assert gate(10, 0, 0.9) == gate(10, 3, None) == gate(0, 0, None) == gate(10, 1, 0.9, at_least=0.8) == 0
    assert gate(10, 10, 0.9) == gate(10, 1, 0.9, strict=True) == gate(10, 0, None, at_least=0.8) == 2 and gate(10, 0, 0.7, at_least=0.8) == 1
    assert json.dumps(gate(1, 0, 0.5, at_least=0.5)) == "0"
