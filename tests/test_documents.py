"""Checks of parsed documents and of a vector index."""

import pytest
from pyspark.sql import functions as F

from passagework.functions.hashing import uuid5
from passagework.operators import documents as D

LINES = "k string, seq int, text string"


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_headings_end_within_seven_lines(spark):
    rows = [("a", 1, "12.— Short title"), ("a", 2, "goes on.—First words"), ("a", 3, "and — more"), ("b", 5, "3. One––"), ("b", 9, "Body")]
    rows += [("c", i, "4. Long" if i == 1 else "on") for i in range(1, 7)] + [("c", 7, "end -- text")]
    got = {r["k"]: (r["number"], r["title"], r["body"]) for r in D.headed(spark.createDataFrame(rows, LINES), ["k"]).collect()}
    assert got == {"a": ("12", "Short title goes on.", "First words\nand — more"), "b": ("3", "One", "Body"), "c": ("4", "Long on on on on on end", "text")}
    late = [("d", i, "5. Long" if i == 1 else "on") for i in range(1, 8)] + [("d", 8, "end — text")]
    with pytest.raises(Exception, match="no end: d"):
        D.headed(spark.createDataFrame(late, LINES), ["k"]).collect()
    with pytest.raises(Exception, match="no section number: e"):
        D.headed(spark.createDataFrame([("e", 1, "No — number")], LINES), ["k"]).collect()


def test_children_fit_their_parents(spark):
    edges = [("s", "", None, None, "One two three four", ""), ("s", "/1", "", "1", "One\n two", ""), ("s", "/2", "", "a1", "three", ""), ("s", "/3", "", "1", "five", ""), ("s", "/1/a", "/1", "a", "o ne", None), ("s", "/4", "/gone", "b", "x", ""), ("t", "/1", "", "1", "One", "")]
    found = D.child_faults(spark.createDataFrame(edges, "k string, node_id string, parent_id string, label string, text string, residual_text string"), ["k"])
    assert pairs(found, "k", "node_id", "fault") == [("s", "/1", "repeated label"), ("s", "/1/a", "missing text"), ("s", "/2", "label"), ("s", "/3", "not in its parent"), ("s", "/3", "repeated label"), ("s", "/4", "not in its parent"), ("t", "/1", "not in its parent")]


def test_bodies_hold_their_lines(spark):
    lines = spark.createDataFrame([("a", 1, "1.—Theft of"), ("a", 2, "things.—Who ever"), ("b", 1, "2. Bail—May be"), ("c", 1, "3. Other—x")], LINES)
    sections = spark.createDataFrame([("a", "1", "Theft of things.", "Whoever"), ("b", "2", "Bail", "May not be"), ("c", "3", "Title", "x"), ("d", "4", "None", "")], "k string, number string, title string, text string")
    assert pairs(D.body_faults(sections, lines, ["k"]), "k", "fault") == [("b", "text"), ("c", "title"), ("d", "lines")]


def test_table_pages_hold_their_characters(spark):
    lines = spark.createDataFrame([(1, "ab c"), (1, "d"), (2, "xy"), (3, "z"), (4, "w")], "page int, text string")
    rows = spark.createDataFrame([(1, ["d", "b"]), (1, ["a c", ""]), (2, ["x", "x"]), (3, ["z"]), (5, ["q", ""])], "page int, cells array<string>")
    assert pairs(D.table_faults(rows, lines, 2), "page", "fault") == [(2, "content"), (3, "width"), (4, "content"), (5, "content")]


def test_counts_of_parts(spark):
    found = spark.createDataFrame([("A", "I", None), ("A", "I", "Of x"), ("A", "II", "Of x"), ("B", "I", None)], "act string, chapter string, group_heading string")
    pages = spark.createDataFrame([("A",), ("A",), ("C",)], "act string")
    expected = spark.createDataFrame([("A", 2, 3, 2, 2), ("B", 1, 1, 1, 0)], "act string, pages int, sections int, chapters int, groups int")
    assert pairs(D.count_faults_of(found, pages, expected), "act", "what", "n", "expected") == [("B", "pages", 0, 1), ("C", "pages", 1, 0)]


def test_index_against_its_source(spark):
    source = spark.createDataFrame([("a", [3.0, 4.0], "x"), ("b", [1.0, 0.0], "x"), ("c", [1.0, 0.0], None), ("d", [float("nan"), 1.0], "x"), ("e", [0.0, 1.0], "x")], "chunk_id string, embedding array<double>, act string")
    points = spark.createDataFrame([("a", "a", [0.6, 0.8], "x"), ("b", "b", [0.0, 1.0], "y"), ("c", "z", [1.0, 0.0], None), ("d", "d", [0.0, 1.0], "x"), ("f", "f", [0.0, 1.0], "x")], "name string, chunk_id string, vector array<double>, act string")
    found = D.index_faults(source, points.withColumn("point_id", uuid5(F.col("name"))), ["act"])
    names = {r["p"]: r["n"] for r in spark.createDataFrame([(n,) for n in "abcdef"], "n string").select("n", uuid5(F.col("n")).alias("p")).collect()}
    got = sorted((names[r["point_id"]], r["fault"]) for r in found.collect())
    assert got == [("a", "length"), ("b", "payload: act"), ("b", "vector"), ("c", "another key"), ("d", "not finite"), ("e", "missing"), ("f", "unknown")]
