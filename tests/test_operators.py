"""Operators on small inputs with numbers worked out by hand."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from passagework.functions import hashing, jsontext, text, vectors
from passagework.operators import bm25, chunking, dense, fusion, metrics, quota, rerank, structure, validation, verify
from passagework.operators.ranking import distributed_rank, percentiles
from passagework.operators.sampling import strided_sample
from passagework.sources import files, publish


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_references(spark):
    df = spark.createDataFrame([("Section 359(1) (a) of état’s o'clock",), (None,), ("",)], "text string")
    native, exact = (df.select(text.tokenize(F.col("text"), exact=e).alias("t")).collect() for e in (False, True))
    assert native[0]["t"] == ["section", "359", "1", "a", "of", "état's", "o'clock", "359(1)", "359(1)(a)"] == exact[0]["t"]
    assert native[1]["t"] == native[2]["t"] == exact[1]["t"] == []
    assert one(spark, text.tokenize(F.lit("STRASSE ﬁn Straße"), exact=True)) == ["strasse", "fin", "strasse"]


def test_sentences(spark):
    spans = one(spark, text.sentence_spans(F.lit("Alpha sentence. Beta sentence. Gamma sentence.")))
    assert [(s["char_start"], s["char_end"]) for s in spans] == [(0, 15), (16, 30), (31, 46)]
    assert one(spark, text.sentence_spans(F.lit(" \n "))) == []
    assert [s["text"] for s in one(spark, text.sentence_spans(F.lit("e.g. this stays.  “Quoted” cut! 5 too")))] == ["e.g. this stays.", "“Quoted” cut!", "5 too"]


def test_string_functions(spark):
    assert one(spark, text.compact(F.lit(" a b\tc "))) == "abc"
    assert one(spark, text.normalize_line(F.lit(" a \t b "))) == "a b"
    assert one(spark, text.next_label(F.lit("num"), F.lit("9"))) == "10"
    assert one(spark, text.next_label(F.lit("alpha"), F.lit("z"))) == "aa"
    assert one(spark, text.next_label(F.lit("roman"), F.lit("ix"))) == "x"
    assert one(spark, text.next_label(F.lit("roman"), F.lit("xxx"))) is None
    assert one(spark, text.alpha_value(F.lit("aa"))) == 27 and one(spark, text.roman_value(F.lit("xiv"))) == 14
    assert one(spark, text.section_heading(F.lit("BNS"), F.lit("5"), F.lit("(a)"), F.lit("Title"), F.lit(""), F.lit("Of Things"))) == "BNS § 5(a) | Title | Of Things"
    assert one(spark, text.is_citation(F.lit("BNS-2023-0123456789ab-S103")))
    assert not one(spark, text.is_citation(F.lit("BNSS-2023-0123456789ab-S359-SS1-T1-R001")))
    assert one(spark, text.same_characters(F.lit("listen"), F.lit("silent")))
    assert one(spark, text.row_text(F.array(F.lit("a  b"), F.lit("c")), F.array(F.lit("1"), F.lit("2")))) == "a b: 1\nc: 2"


def test_hashes(spark):
    namespace = uuid.UUID(hashing.POINT_NAMESPACE)
    for name in ("chunk-1", "ä", ""):
        assert one(spark, hashing.uuid5(F.lit(name))) == str(uuid.uuid5(namespace, name))
    import hashlib
    import json

    data = {"b": "ü\n\"x\"", "a": 7, "c": None}
    want = hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, hashing.data_hash({"b": F.lit(data["b"]), "a": F.lit(7), "c": F.lit(None).cast("string")})) == want


def test_json_text(spark):
    cases = {
        '{"a": 1}': '{"a":1}', 'Sure:\n```json\n{"a": {"b": 2}}\n```': '{"a":{"b":2}}', 'use {braces} then {"a": "}"} end': '{"a":"}"}', "none": None, "[1]": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", jsontext.extract_object(F.col("t")).alias("o")).collect()
    assert {r["t"]: r["o"] for r in rows} == cases
    answers = {
        '{"answer": "x", "citations": [], "confidence": 0.5, "query_type": "scenario", "more": 1}': None,
        '{"answer": " ", "citations": [], "confidence": 0.5, "query_type": "scenario"}': "answer", '{"answer": "x", "confidence": 0.5, "query_type": "scenario"}': "citations",
        '{"answer": "x", "citations": [], "confidence": 2, "query_type": "scenario"}': "confidence", '{"answer": "x", "citations": [], "confidence": 1, "query_type": "odd"}': "query_type", "no": "no JSON object",
    }
    df = spark.createDataFrame([(k,) for k in answers], "t string").withColumn("raw", jsontext.extract_object(F.col("t"))).withColumn("p", F.from_json("raw", jsontext.ANSWER_SCHEMA))
    assert dict(values(df.withColumn("v", jsontext.violation(F.col("raw"), F.col("p"))), "t", "v")) == answers
    assert one(spark, jsontext.json_pointer_parts(F.lit("/a~1b/~0c/3"))) == ["a/b", "~c", "3"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vectors.norm(a)) == 5 and one(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert not one(spark, vectors.is_finite(F.array(F.lit(1.0), F.lit(float("nan"))))) and one(spark, vectors.all_close(a, a))


def test_fusion(spark):
    rows = [(1, i, "dense", r) for r, i in enumerate("abc", 1)] + [(1, i, "sparse", r) for r, i in enumerate("cad", 1)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id string, source string, rank int")
    fused = values(fusion.reciprocal_rank_fusion(hits, 10).orderBy("rank"), "doc_id", "rrf_score", "sources")
    assert [f[0] for f in fused] == list("acbd")
    assert fused[0][1] == pytest.approx(1 / 61 + 1 / 62) and fused[2][1] == pytest.approx(1 / 62)
    assert [f[2] for f in fused] == ["dense,sparse", "dense,sparse", "dense", "sparse"]
    tie = spark.createDataFrame([(1, "b", "dense", 1), (1, "a", "sparse", 1)], hits.schema)
    assert [f[0] for f in values(fusion.reciprocal_rank_fusion(tie, 10).orderBy("rank"), "doc_id")] == ["a", "b"]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common"), (4, None), (5, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "rare"), (2, "common"), (3, " "), (4, "absent")], "query_id int, text string")
    index = bm25.build_index(docs)
    found = bm25.search(index, bm25.query_terms(queries), 5).collect()
    assert {r["query_id"] for r in found} == {1, 2} and {r["doc_id"] for r in found if r["query_id"] == 2} == {1, 2, 3}
    assert index.stats.first()["n_docs"] == 5 and index.stats.first()["avgdl"] == 1.0
    common = [r["idf"] for r in index.terms.collect() if r["term"] == "common"][0]
    assert common == pytest.approx(0.25 * index.stats.first()["average_idf"])
    assert bm25.search(bm25.build_index(docs.where("false")), bm25.query_terms(queries), 5).count() == 0


def test_bm25_published_and_filtered(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "Straße eins", "BNS", "1"), (2, "strasse zwei", "BSA", "2"), (3, "ﬁn de la rue", "BNS", "2"), (3, "ﬁn de la rue", "BNS", "2")], "doc_id int, text string, act string, section string").withColumn("kind", F.lit("section"))
    asked = bm25.query_terms(spark.createDataFrame([(1, "STRASSE"), (2, "fin")], "query_id int, text string"))
    root = str(tmp_path / "bm25")
    built = bm25.build_index(docs)
    index = bm25.index_of(docs, root)
    bm25.check_round_trip(built, index, asked)
    build = bm25.corpus_build(docs)
    assert build == bm25.corpus_build(docs.repartition(3)) != bm25.corpus_build(docs.limit(2)) and publish.current_build(spark, root) == (0, build)
    assert index.stats.first()["n_docs"] == 4 and {r["doc_id"] for r in bm25.search(index, asked, 5).collect() if r["query_id"] == 1} == {1, 2}
    only = lambda **where: {r["doc_id"] for r in bm25.search(index, asked, 5, eligible=bm25.eligible_documents(docs, **where)).collect()}
    assert only(act=" bns ") == {1, 3} and only(act="BSA") == {2} and only(act="BNS", section="2") == {3} and only(act="BNS", section=" 1 ") == {1} and only(kind="form") == set() and only() == {1, 2, 3}
    with pytest.raises(ValueError, match="unknown act"):
        bm25.eligible_documents(docs, act="IPC")
    with pytest.raises(ValueError, match="needs an act"):
        bm25.eligible_documents(docs, section="2")
    assert bm25.load_index(spark, root, verify=True).stats.first() == index.stats.first()
    few = bm25.search(index, asked, 5)
    assert "In(term, [" in few._jdf.queryExecution().toString() and few.exceptAll(bm25.search(built, asked, 5)).isEmpty()
    monkeypatch.setattr(bm25, "FEW_TERMS", 1)
    many = bm25.search(index, asked, 5)
    assert "In(term, [" not in many._jdf.queryExecution().toString() and many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
    with pytest.raises(ValueError):
        bm25.check_round_trip(built, bm25.build_index(docs.where("doc_id = 1")), asked)
    with pytest.raises(FileNotFoundError):
        bm25.load_index(spark, root, "v0-none")
    terms = bm25.index_of(docs, str(tmp_path / "other"), snapshot="s1").terms.withColumn("idf", F.when(F.col("term") == "zwei", 9.0).otherwise(F.col("idf")))
    terms.write.parquet(str(tmp_path / "changed"))
    n_terms = terms.count()
    spark.read.parquet(str(tmp_path / "changed")).write.mode("overwrite").parquet(f"{tmp_path}/other/builds/v{bm25.INDEX_VERSION}-s1/terms")
    assert bm25.index_of(docs, str(tmp_path / "other"), snapshot="s1").terms.count() == n_terms
    with pytest.raises(ValueError, match="not what was published: .'terms'"):
        bm25.load_index(spark, str(tmp_path / "other"), verify=True)
    index.terms.limit(1).write.mode("overwrite").parquet(str(tmp_path / "terms"))
    spark.read.parquet(str(tmp_path / "terms")).write.mode("append").parquet(f"{root}/builds/{build}/terms")
    with pytest.raises(ValueError, match="manifest"):
        bm25.load_index(spark, root)


def test_dense_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int").repartition(4)
    asked = table.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    want = {}
    for q in range(0, 120, 4):
        scores = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(120) if i != q and i % 3 == q % 3)
        want[q] = [i for _, i in scores[:3]]
    for sent in (8_000_000, 60):
        monkeypatch.setattr(dense, "SENT_NUMBERS", sent)
        got = {}
        for r in dense.nearest(table, asked, 3, filters=("label",)).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == want
    assert dense.nearest(table, asked.where("false"), 3).count() == dense.nearest(table.where("false"), asked, 3).count() == 0


def test_failed_questions_count_with_zeros(spark):
    hits = spark.createDataFrame([(1, "a", 1)], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert sorted(values(metrics.ranked_metrics(hits, gold, (1,), asked), "query_id", "precision", "recall")) == [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]


def test_question_checks(spark):
    ok = dict(query="What?", act=None, category="c", provenance="p", gold_citation_ids=["x"], needs_legal_review=False)
    rows = [dict(ok, id="1", query="Wo ist die STRASSE"), dict(ok, id="2", query=" wo  ist die straße"), dict(ok, id="3", query=" "), dict(ok, id="3", query="b", category="d"), dict(ok, id="4", query="c", gold_citation_ids=["y", "y"]), dict(ok, id="5", query="d", act="B")]
    schema = "id string, query string, act string, category string, provenance string, gold_citation_ids array<string>, needs_legal_review boolean"
    citations = spark.createDataFrame([("x", "A")], "citation_id string, act string")
    found = set(values(validation.question_violations(spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema), citations, ["c"], ["p"]), "id", "violation"))
    assert found == {("1", "repeated query"), ("2", "repeated query"), ("3", "blank query"), ("3", "repeated id"), ("3", "category"), ("4", "repeated gold"), ("4", "unknown gold"), ("5", "gold of another act")}


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from passagework.sources.scratch import scratch_root

    unset = SimpleNamespace(get=lambda name, default=None: default)
    for master, fails in (("local[4]", False), ("local", False), ("spark://host:7077", True), ("local-cluster[2,1,1024]", True)):
        session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master=master))
        if fails:
            with pytest.raises(ValueError, match="checkpoint"):
                scratch_root(session)
        else:
            assert scratch_root(session)


def test_dense(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [1.0, 0.1])], "vec_id int, embedding array<double>")
    asked = table.where("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    assert [r[0] for r in values(dense.nearest(table, asked, 2).orderBy("rank"), "vec_id")] == [2, 6]
    assert [r[0] for r in values(dense.nearest(table, asked, 1, exclude_self=False), "vec_id")] == [1]


def test_metrics(spark):
    got, gold = F.array(*map(F.lit, "caab")), F.array(F.lit("a"), F.lit("b"))
    assert [one(spark, metrics.precision_at(got, gold, k)) for k in (1, 2, 3, 4)] == pytest.approx([0, 0.5, 1 / 3, 0.5])
    assert [one(spark, metrics.recall_at(got, gold, k)) for k in (1, 2, 3, 4)] == [0, 0.5, 0.5, 1]
    assert one(spark, metrics.recall_at(got, F.array().cast("array<string>"), 3)) == 0
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            metrics.require_k(bad)
    assert (metrics.gate(0.857), metrics.gate(0.8), metrics.gate(None)) == (0, 1, 2)
    hits = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3)], "query_id int, id string, rank int")
    gold_rows = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, id string")
    assert sorted(values(metrics.ranked_metrics(hits, gold_rows, (1, 3)), "k", "precision", "recall")) == [(1, 0.0, 0.0), (3, 0.333333, 0.5)]
    answers = spark.createDataFrame([("a", ["f"], True), ("", [], False), ("b", [], None), (None, ["f"], False)], "answer string, flags array<string>, valid boolean")
    rate = answers.agg(metrics.hallucination_rate(F.col("flags"), F.col("valid"), F.col("answer")).alias("r")).first()["r"]
    assert rate == pytest.approx(200 / 3)


def test_percentiles_and_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in (30.0, 0.0, 20.0, 10.0)] + [("b", None), ("c", 5.0)], "g string, v double")
    rows = {r["g"]: r for r in percentiles(df, ["g"], "v", [25, 50, 95, 99]).collect()}
    assert [rows["a"][f"p{p}"] for p in (25, 50, 95, 99)] == pytest.approx([7.5, 15, 28.5, 29.7])
    assert rows["c"]["p99"] == 5 and "b" not in rows
    many = spark.range(1000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).alias("v"))
    ranked = distributed_rank(many, ["g"], ["v"]).toPandas().sort_values(["g", "v"])
    assert (ranked["rank"] == ranked.groupby("g").cumcount() + 1).all()


def test_rerank_and_compress(spark):
    scores = {"Alpha sentence.": 0.9, "Beta sentence.": -1.0, "Gamma sentence.": 0.4}

    def scorer(_, passage):
        return F.coalesce(*(F.when(passage == k, F.lit(v)) for k, v in scores.items()), F.lit(-2.0))

    hits = spark.createDataFrame([(1, "q", 1, " ".join(scores)), (1, "q", 2, "Beta sentence. Delta here. Delta here."), (1, "q", 3, "  ")], "query_id int, query string, doc_id int, text string")
    rows = {r["doc_id"]: r for r in rerank.compress(hits, scorer).collect()}
    assert rows[1]["compressed_text"] == "Alpha sentence. Gamma sentence." and rows[1]["compression_mode"] == "extractive"
    assert rows[2]["compressed_text"] == "Beta sentence." and rows[2]["low_confidence"]
    assert rows[3]["compression_mode"] == "skipped" and rows[3]["compressed_text"] == ""
    fused = spark.createDataFrame([(1, "q", i, t, i) for i, t in enumerate(["Beta sentence.", " ", "Alpha sentence.", "x", "y"], 1)], "query_id int, query string, doc_id int, text string, rank int")
    assert [r[0] for r in values(rerank.rerank(fused, 5, scorer, cut=4).orderBy("rank"), "doc_id")] == [3, 1, 4]


def test_verification(spark):
    cited = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c")], "q int, citation_id string")
    got = spark.createDataFrame([(1, "a"), (2, "x"), (1, None)], "q int, citation_id string")
    assert values(verify.grounded(cited, got, ["q", "citation_id"]), "citation_id") == [("a",)]
    assert sorted(values(verify.grounding_summary(cited, got, ["q"], "citation_id"), "q", "n_cited", "n_grounded", "grounding_ratio")) == [(1, 2, 1, 0.5), (2, 1, 0, 0.0)]
    seen = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3)], "q int, v string, at int")
    assert values(verify.first_seen(seen, ["q"], "v", ["at"]).orderBy("position"), "v", "at") == [("b", 1), ("a", 2)]


def test_structure(spark):
    rows = spark.createDataFrame([("g", 1, 3), ("g", 3, 5), ("g", 8, 9), ("g", 8, 12), ("h", 0, 1)], "g string, start int, end int")
    merged = structure.merge_intervals(rows, ["g"])
    assert sorted(values(merged, "g", "start", "end", "n")) == [("g", 1, 5, 2), ("g", 8, 12, 2), ("h", 0, 1, 1)]
    assert values(structure.interval_gaps(merged, ["g"]), "start", "end") == [(5, 8)]
    total = spark.createDataFrame([("g", 0, 20), ("h", 0, 1)], "g string, start int, end int")
    assert sorted(values(structure.subtract_intervals(total, rows, ["g"]), "g", "start", "end")) == [("g", 0, 1), ("g", 5, 8), ("g", 12, 20)]
    spans = spark.createDataFrame([(1, 0, 3, 5), (1, 3, 5, 5), (2, 0, 2, 5), (2, 3, 5, 5), (3, 0, 4, 5)], "d int, char_start int, char_end int, n int")
    assert sorted(values(structure.coverage_faults(spans, ["d"], "n"), "d", "fault")) == [(2, "gap"), (3, "end")]
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, at int")
    right = spark.createDataFrame([(1, 6, "x"), (1, 10, "y")], "k int, at int, v string")
    assert sorted(values(structure.as_of(left, right, ["k"], "at", ["v"]), "k", "at", "v"), key=str) == [(1, 10, "y"), (1, 5, None), (2, 1, None)]
    assert one(spark, structure.nearest_boundary(F.lit(10.0), [0, 11.5, 40])) == 1
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string")
    assert sorted(values(structure.descendants(edges), "ancestor", "descendant", "depth"))[:3] == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    with pytest.raises(ValueError):
        structure.descendants(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"))


def test_quota(spark):
    at = dt.datetime(2024, 1, 1, 23, 30)
    offsets = [0, 10, 20, 3599, 3600, 3601, 7300, 20000]
    rows = [(1, i, at + dt.timedelta(seconds=s)) for i, s in enumerate(offsets)] + [(None, 99, at)]
    got = quota.quota_decisions(spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp").where("user_id IS NOT NULL"), 2).orderBy("event_id")
    assert values(got, "request_no", "allowed") == [(1, True), (2, True), (3, False), (4, False), (1, True), (2, True), (1, True), (1, True)]
    assert [r[0] for r in values(got, "retry_after")][:4] == [None, None, 3580, 1]


def test_chunking():
    passage = " ".join(f"w{i}." if i % 17 == 0 else f"w{i}" for i in range(1300))
    spans = chunking.split_passage(passage, "head of it", chunking.whitespace_tokens)
    assert "".join(passage[a:b] for a, b in spans) == passage
    assert all(len(chunking.whitespace_tokens(passage[a:b])) + 3 + 2 <= 480 for a, b in spans)
    assert all(passage[:b].rstrip().endswith(".") for _, b in spans[:-1])
    with pytest.raises(ValueError):
        chunking.split_passage("text", "p " * 475, chunking.whitespace_tokens)
    assert chunking.split_passage("", "p", chunking.whitespace_tokens) == []
    # room is what the limit leaves after the prefix and twice the special tokens
    words = " ".join(["w"] * 100)
    assert [b - a for a, b in chunking.split_passage(words, "p", chunking.whitespace_tokens, limit=40)] == [69, 70, 60]
    with pytest.raises(ValueError):
        chunking.split_passage(words, "p " * 30, chunking.whitespace_tokens, limit=40)
    assert len(chunking.split_passage(words, "p " * 29, chunking.whitespace_tokens, limit=40)) == 14
    broken = " ".join(["w"] * 31) + ".\n\n" + " ".join(["w"] * 40)
    assert chunking.split_passage(broken, "p", chunking.whitespace_tokens, limit=60)[0] == (0, 64)

    def merging(text):
        """Pairs of letters are one token, so a cut may add a token."""
        return [m.span() for m in re.finditer("..?", text)]

    spans = chunking.split_passage("a" * 301, "b", merging, limit=50)
    assert "".join("a" * (b - a) for a, b in spans) == "a" * 301 and all(len(merging("b" + "a" * (b - a))) + 2 <= 50 for a, b in spans)


def test_token_limit(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    assert [r["n"] for r in df.select(chunking.token_limited(F.col("text")).alias("n")).collect()] == [5, None, 2]
    with pytest.raises(Exception, match="more than 4"):
        df.select(chunking.token_limited(F.col("text"), limit=4)).collect()


def test_sampling_and_validation(spark):
    pool = spark.range(10).select(F.lit("a").alias("g"), "id")
    assert [r[0] for r in values(strided_sample(pool, ["g"], "id", seed=3, stride=7, per_group=4).orderBy("sample_index"), "id")] == [3, 0, 7, 4]
    with pytest.raises(ValueError):
        strided_sample(pool, ["g"], "id", seed=0, stride=5, per_group=2)
    with pytest.raises(ValueError):
        validation.require_empty(validation.duplicates(pool, ["g"]), "repeated")
    with pytest.raises(Exception, match="too large"):
        validation.checked(pool, F.col("id") < 5, "too large").count()
    a, b = spark.createDataFrame([(1, "x", None)], "k int, v string, w int"), spark.createDataFrame([(1, "y", None)], "k int, v string, w int")
    assert values(validation.row_differences(a, b, "k"), "field") == [("v",)]
    more = b.unionByName(spark.createDataFrame([(2, "y", None)], a.schema))
    assert sorted(values(validation.row_differences(a, more, "k"), "k", "field")) == [(1, "v"), (2, "missing left")]
    markers = [("n", i, m) for i, m in enumerate(["(1)", "(1A)", "(2)"])] + [("r", i, m) for i, m in enumerate(["(i)", "(ii)", "(iii)"])] + [("x", i, m) for i, m in enumerate(["(1)", "(2)", "(1)"])]
    faults = validation.marker_faults(spark.createDataFrame(markers + [("y", 0, None)], "g string, i int, m string"), ["g"], "i", "m")
    assert values(faults, "g", "fault") == [("x", "not a run")]


def test_sources_and_sinks(spark, tmp_path):
    root = str(tmp_path / "index")
    first, second = spark.range(3), spark.range(5)
    publish.publish_build(first, root, "one")
    publish.publish_build(second, root, "two")
    publish.publish_build(second, root, "two")
    assert publish.read_current(spark, root).count() == 5 and publish.current_build(spark, root) == (1, "two")
    with pytest.raises(ValueError):
        publish.write_report({}, tmp_path / "data" / "x.json", tmp_path)
    publish.write_report({"b": 1, "a": "ü"}, tmp_path / "x.json", tmp_path)
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "ü",\n  "b": 1\n}\n'
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    lines = spark.createDataFrame([(1, "1", 100.0, 792.0), (1, "1", 735.0, 792.0)], "page int, text string, y double, height double")
    assert values(files.remove_folios(lines), "y") == [(100.0,)]
    assert (publish.audit_status({}, None), publish.audit_status(None, "x")) == ("completed", "failed")
    with pytest.raises(ValueError):
        publish.audit_status(None, " ")
