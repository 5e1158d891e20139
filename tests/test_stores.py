"""JSON of any depth, clustered tables, updates, chains of builds, the citation map and the benchmark loader."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from passagework.functions import jsontree
from passagework.operators import citation_map as C
from passagework.operators import datasets as D
from passagework.sources import publish, updates


def leaves_of(value, at=""):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves_of(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves_of(v, f"{at}/{i}")]
    return [(at, value)]


def random_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind > 5:
        return {rng.choice(["a", "b/c", "~d", "1", "", "e'f", 'g"h', "ü"]): random_json(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else rng.choice([1, -2.5, "x", 'q"\\', True, False, None, "", 10**15])


def test_leaves_and_pointers(spark):
    rng = random.Random(6)
    values = [random_json(rng) for _ in range(60)] + [{}, [], 5, None, "s"]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, None)], "id int, j string")
    got = {}
    for r in jsontree.json_leaves(rows, ["id"], "j").collect():
        got.setdefault(r["id"], []).append((r["pointer"], json.loads(r["value"]), r["kind"]))
    assert 99 not in got
    for i, v in enumerate(values):
        assert sorted(((p, x) for p, x, _ in got[i]), key=str) == sorted(leaves_of(v), key=str)
    kinds = {type(x): k for found in got.values() for _, x, k in found}
    assert kinds == {dict: "object", list: "array", str: "string", int: "number", float: "number", bool: "boolean", type(None): "null"}
    asked = [(i, json.dumps(v), p, x) for i, v in enumerate(values) for p, x in leaves_of(v)] + [(1, "[1]", "/1", ...), (1, "[1]", "/01", ...), (1, "1", "/a", ...), (1, None, "", ...), (1, "{}", None, ...), (1, '{"a": {"b": [1, 2]}}', "/a", {"b": [1, 2]})]
    table = spark.createDataFrame([(n, j, p) for n, (_, j, p, _) in enumerate(asked)], "n int, j string, p string")
    found = {r["n"]: r["found"] for r in jsontree.json_at(table, "j", "p").collect()}
    for n, (_, _, p, want) in enumerate(asked):
        assert (found[n] is None) if want is ... else json.loads(found[n]) == want, (p, want)
    with pytest.raises(Exception, match="not a pointer"):
        jsontree.json_at(table.withColumn("p", F.lit("a")), "j", "p").collect()


def test_clustered_tables_skip_what_a_read_does_not_need(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("act"), F.md5(F.col("id").cast("string")).alias("key"))
    path = str(tmp_path / "t")
    updates.write_clustered(rows, path, "act", ["key"])
    point = updates.read_point(spark, path, {"act": "a", "key": rows.where("doc_id = 33").first()["key"]})
    plan = point._jdf.queryExecution().toString()
    assert point.count() == 1 and "PartitionFilters: [isnotnull(act" in plan and "EqualTo(key" in plan
    assert updates.read_point(spark, path, {"act": "c"}).count() == 0
    assert spark.read.parquet(path).count() == 5000
    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(glob.glob(f"{path}/act=a/*.parquet")[0]).metadata
    stats = meta.row_group(0).column(1).statistics
    assert meta.row_group(0).column(1).path_in_schema == "key" and stats.min < stats.max


def test_updates_rewrite_touched_files_only(spark, tmp_path):
    root = str(tmp_path / "users")
    rows = spark.range(400).select("id", (F.col("id") % 7).alias("org"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("note"))
    updates.create_table(rows.repartitionByRange(8, "id"), root)
    with pytest.raises(FileExistsError):
        updates.create_table(rows, root)
    before = {r["path"] for r in updates.table_files(spark, root).collect()}
    old = updates.read_versioned(spark, root)
    few = spark.createDataFrame([(3,), (5,), (3,), (None,), (1000,)], "id long")
    assert updates.update_where(spark, root, few, {"active": F.lit(False), "note": F.concat(F.lit("org "), "org")}) == 1
    after = {r["path"] for r in updates.table_files(spark, root).collect()}
    assert len(before & after) == 7 and len(before - after) == 1
    now = {r["id"]: r for r in updates.read_versioned(spark, root).collect()}
    assert len(now) == 400 and not now[3]["active"] and now[5]["note"] == "org 5" and now[4]["active"] and sum(not r["active"] for r in now.values()) == 2
    assert old.where("NOT active").count() == 0  # a reader of the old version keeps it
    assert updates.update_where(spark, root, few.where("id = 1000"), {"active": F.lit(True)}) == 0
    assert updates.update_where(spark, root, spark.createDataFrame([(2,)], "org long"), {"org": F.lit(50)}) >= 7
    assert updates.read_versioned(spark, root).where("org = 50").count() == 57 and updates.read_versioned(spark, root).count() == 400


def test_digests_see_content_alone(spark):
    rows = spark.createDataFrame([(1, "a", [1, None]), (2, None, None), (2, None, None), (None, "b", [])], "i int, s string, l array<int>")
    one = updates.table_digest(rows)
    assert one == updates.table_digest(rows.repartition(3).select("l", "s", "i"))
    others = [rows.distinct(), rows.withColumn("i", F.col("i").cast("long")), rows.withColumnRenamed("s", "t"), rows.withColumn("s", F.coalesce("s", F.lit(""))), rows.withColumn("l", F.when(F.size("l") > 0, F.col("l"))), rows.limit(0)]
    digests = [json.dumps(updates.table_digest(o)) for o in others]
    assert len({json.dumps(one), *digests}) == 7
    swapped = [updates.table_digest(spark.createDataFrame([v], "a string, b string")) for v in (("x", None), (None, "x"))]
    assert swapped[0] != swapped[1]


def test_chain_of_builds(spark, tmp_path):
    chunks, vectors = str(tmp_path / "chunks"), str(tmp_path / "vectors")
    rows = spark.range(20).select(F.col("id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text"))
    updates.publish_chained({"chunks": rows}, chunks, "c1", about={"source_sha256": "x"})
    updates.publish_chained({"vectors": rows.select("chunk_id"), "norms": rows.select(F.lit(1.0).alias("n"))}, vectors, "v1", (chunks, "c1"))
    assert [m["build_id"] for m in updates.verified_chain(spark, vectors)] == ["v1", "c1"]
    part = f"{chunks}/builds/c1/chunks"
    changed = rows.withColumn("text", F.when(F.col("chunk_id") == 7, "text 8").otherwise(F.col("text")))
    changed.write.mode("overwrite").parquet(part)
    with pytest.raises(ValueError, match="chunks of build c1 is not what was published"):
        updates.verified_chain(spark, vectors)
    rows.write.mode("overwrite").parquet(part)
    assert len(updates.verified_chain(spark, vectors)) == 2
    text = spark.read.parquet(f"{chunks}/builds/c1/manifest").first()["manifest"]
    spark.createDataFrame([(text.replace('"x"', '"y"'),)], "manifest string").write.mode("overwrite").parquet(f"{chunks}/builds/c1/manifest")
    with pytest.raises(ValueError, match="c1 is not the one that v1 was made from"):
        updates.verified_chain(spark, vectors)


def test_snapshots_are_named_without_reading(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    one = publish.snapshot_id(spark, path)
    assert one == publish.snapshot_id(spark, path)
    spark.range(1).write.mode("append").parquet(path)
    assert publish.snapshot_id(spark, path) != one


def test_citation_map(spark):
    sections = spark.createDataFrame([("k1", "BNS", "BNS-2023-aaaaaaaaaaaa-S1", "1", "/s/0"), ("k2", "BNS", "BNS-2023-aaaaaaaaaaaa-S2", "2", "/s/1")], "k string, act string, citation_id string, section_number string, json_pointer string")
    lines = spark.createDataFrame([("k1", 2, 5.0, 10.0, 50.0, 20.0), ("k1", 2, 4.004, 30.0, 40.0, 41.239), ("k1", 1, 0.0, 0.0, 1.0, 1.0)], "k string, page int, x0 double, y0 double, x1 double, y1 double")
    rows = spark.createDataFrame([("BNS", "BNS-2023-aaaaaaaaaaaa", n, 7) for n in (1, 12, 1234)], "act string, prefix string, row_ordinal int, page int")
    forms = spark.createDataFrame([("BNS", "BNS-2023-aaaaaaaaaaaa", i, str(i + 1), p) for i, p in enumerate((220, 222, 222, 225))], "act string, prefix string, nth int, form_number string, page int")
    notes = spark.createDataFrame([("BNS", "BNS-2023-aaaaaaaaaaaa", "SCH1-NOTES", "/n", 3, "text")], "act string, prefix string, label string, json_pointer string, page int, text string")
    sources = spark.createDataFrame([("BNS", "Bns.pdf", "a" * 64)], "act string, document_name string, source_sha256 string")
    parts = [C.section_entries(sections, lines, ["k"]), C.row_entries(rows, "table_row", F.lit("S359-SS1-T1"), F.concat(F.lit("/r/"), "row_ordinal"), F.col("page"), parent=F.lit("BNS-2023-aaaaaaaaaaaa-S2"), subsection=F.lit("(1)")), C.form_entries(forms, 230), C.note_entries(notes)]
    got = {r["citation_id"].removeprefix("BNS-2023-aaaaaaaaaaaa-"): r for r in C.citation_map(parts, sources).collect()}
    assert got["S1"]["source_pages"] == [1, 2] and [tuple(r["bbox"]) for r in got["S1"]["section_regions"]] == [(0.0, 0.0, 1.0, 1.0), (4.0, 10.0, 50.0, 41.24)]
    assert got["S2"]["source_pages"] == [] and got["S1"]["document_name"] == "Bns.pdf" and got["S1"]["row_ordinal"] is None
    assert {"S359-SS1-T1-R001", "S359-SS1-T1-R012", "S359-SS1-T1-R1234"} <= set(got) and got["S359-SS1-T1-R012"]["parent_citation_id"].endswith("S2") and got["S359-SS1-T1-R012"]["subsection_id"] == "(1)"
    assert [got[f"SCH2-FORM{i}"]["source_pages"] for i in (1, 2, 3, 4)] == [[220, 221], [222], [222, 223, 224], list(range(225, 231))]
    assert (got["SCH1-NOTES"]["char_start"], got["SCH1-NOTES"]["char_end"]) == (0, 4)
    entries = C.citation_map(parts, sources)
    assert {(r["kind"], r["n"], r["expected"]) for r in C.counts_differ(entries, {"section": 2, "table_row": 4, "schedule": 1, "form": 4}).collect()} == {("table_row", 3, 4), ("schedule", 0, 1), ("schedule_notes", 1, 0)}
    with pytest.raises(ValueError, match="not unique"):
        C.citation_map([*parts, C.note_entries(notes)], sources)
    with pytest.raises(ValueError, match="without a source"):
        C.citation_map(parts, sources.where("false"))


def benchmark(spark):
    sections = [(a, f"{a}-{i:03}", f"Title {i}.", f"/{a}/{i}") for a in ("BNS", "BNSS", "BSA") for i in range(13)]
    table = spark.createDataFrame(sections, "act string, citation_id string, title string, json_pointer string")
    made = [tuple(r) for r in D.regenerated(table, seed=3, per_act=8, stride=5).collect()]
    cross = [(f"x{i}", f"Across {i}?", None, "cross_act", [f"BNS-00{i}", f"BSA-00{i}"], "generated_candidate", None, True) for i in range(5)]
    scenes = [(f"s{i}", f"Scene {i}?", "BNS", "scenario", ["BNS-001"], "generated_candidate", None, True) for i in range(4)]
    seeds = [(f"g{i}", f"Procedure {i}?", "BNSS", "procedural", ["BNSS-002"], "gold_retrieval", None, False) for i in range(3)]
    rows = made + cross + scenes + seeds
    manifest = {
        "version": "v2", "total_questions": len(rows), "categories": {"direct_lookup": 24, "cross_act": 5, "scenario": 4, "procedural": 3}, "acts": {"BNS": 12, "BNSS": 11, "BSA": 8, "null": 5},
        "generated_at": "2024-01-02T03:04:05Z", "corpus_sha256": "c" * 64, "seed": 3, "generator": {"per_act": 8, "stride": 5},
    }
    schema = "id string, query string, act string, category string, gold_citation_ids array<string>, provenance string, json_pointer string, needs_legal_review boolean"
    return rows, schema, manifest, table


def test_benchmark_fits_its_manifest(spark):
    rows, schema, manifest, sections = benchmark(spark)
    questions, hashes = spark.createDataFrame(rows, schema), {"corpus_sha256": "c" * 64}
    assert D.load_benchmark(questions, sections, manifest, hashes, sections).count() == 36
    assert [r["id"] for r in D.selected(questions, act="BNS", category="scenario", limit=2).collect()] == ["s0", "s1"] and D.selected(questions).count() == 36
    broken = {
        "version": {"version": "v1"}, "total_questions": {"total_questions": 35}, "categories": {"categories": {"direct_lookup": 36}}, "acts": {"acts": {**manifest["acts"], "null": 4}},
        "generated_at": {"generated_at": "2024-01-02T03:04:05"}, "corpus_sha256": {"corpus_sha256": "d" * 64}, "questions made from sections": {"seed": 4},
    }
    for fault, change in broken.items():
        assert D.manifest_faults(questions, {**copy.deepcopy(manifest), **change}, hashes, sections) == [fault]
    with pytest.raises(ValueError, match="doesn't fit: ..too few"):
        D.load_benchmark(questions.limit(5), sections, manifest, hashes)
    with pytest.raises(ValueError, match="coprime|stride"):
        D.regenerated(sections, seed=0, per_act=2, stride=26)


def test_rules_between_fields(spark):
    rows, schema, _, sections = benchmark(spark)
    by_id = {r[0]: list(r) for r in rows}
    changes = [("x0", 2, "BNS", "cross-act with one act"), ("x1", 4, ["BNS-001"], "cross-act with one act"), ("s0", 5, "gold_retrieval", "not marked as a candidate"), ("x2", 7, False, "candidate without review"), ("g0", 2, None, "procedural without its act")]
    first = rows[0][0]
    changes += [(first, 6, None, "made from a section, but without pointer"), (rows[1][0], 6, "/none", "pointer of another citation"), (rows[2][0], 3, "scenario", "made from a section, but no single lookup")]
    for key, at, value, _ in changes:
        by_id[key][at] = value
    found = {(r["id"], r["violation"]) for r in D.rule_violations(spark.createDataFrame([tuple(r) for r in by_id.values()], schema), sections).collect()}
    assert {(k, v) for k, _, _, v in changes} <= found and found - {(k, v) for k, _, _, v in changes} <= {(rows[2][0], "not marked as a candidate")}
