"""Chunks of trees, fragments in texts, and table rows."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import provisions as P
from passagework.operators import tree_chunks as TC
from passagework.operators.chunking import split_passage, whitespace_tokens
from passagework.operators.containment import CompactText, located
from passagework.operators.structure import coverage_faults

SEGMENTS = "act string, section string, ord long, above array<string>, text string"
NODES = "act string, section string, node_id string, heading string, kind string"
KEY = ["act", "section"]


def random_section(rng, name, depth=4):
    """Segments and headings of a random tree, in order."""
    segments, nodes = [], []

    def words(n):
        return " ".join(f"w{rng.randrange(1000)}" for _ in range(n)) + rng.choice(["\n", "\n\n", " "])

    def grow(path, level):
        nodes.append(("A", name, path[-1], f"A § {name} {path[-1]}", f"level{level}"))
        if rng.random() < 0.9 or level == depth:
            segments.append(("A", name, len(segments), list(path), words(rng.randrange(1, 40 if level == depth else 9))))
        for i in range(rng.randrange(0, 4) if level < depth else 0):
            grow((*path, f"{path[-1]}/{i}"), level + 1)
            if rng.random() < 0.2:
                segments.append(("A", name, len(segments), list(path), words(5)))

    grow(("",), 0)
    return segments, nodes


def expected(segments, nodes, limit):
    """Spans, kinds and contexts of one section, by walking down its tree."""
    head = {n[2]: (n[3], n[4]) for n in nodes}
    starts, at = [], 0
    for s in segments:
        starts.append(at)
        at += len(s[4])
    ends = [a + len(s[4]) for a, s in zip(starts, segments)]
    whole = "".join(s[4] for s in segments)
    out = []

    def emit(a, b, node, kind, context):
        prefix = head[node][0] + "\n" + "".join(c + "\n" for c in context)
        spans = split_passage(whole[a:b], prefix, whitespace_tokens, limit=limit)
        out.extend((node, kind, a + x, a + y, "\n".join(context), i + 1, len(spans)) for i, (x, y) in enumerate(spans))

    def walk(node, context):
        own = [i for i, s in enumerate(segments) if node in s[3]]
        if not own:
            return
        a, b = starts[own[0]], ends[own[-1]]
        prefix = head[node][0] + "\n" + "".join(c + "\n" for c in context)
        if len(whitespace_tokens(prefix + whole[a:b])) + 2 <= limit:
            out.append((node, head[node][1], a, b, "\n".join(context), 1, 1))
            return
        children = list(dict.fromkeys(s[3][s[3].index(node) + 1] for i, s in enumerate(segments) if i in own and s[3][-1] != node))
        first_child = next((i for i in own if segments[i][3][-1] != node), None)
        intro = "".join(segments[i][4] for i in own if segments[i][3][-1] == node and first_child is not None and i < first_child).strip()
        stretch = None
        for i in own:
            if segments[i][3][-1] == node:
                stretch = (stretch[0], ends[i]) if stretch and stretch[1] == starts[i] else (starts[i], ends[i])
                nxt = i + 1 if i + 1 < len(segments) else None
                if nxt is None or segments[nxt][3][-1] != node:
                    emit(*stretch, node, "residual" if children else head[node][1], context)
                    stretch = None
        for child in children:
            walk(child, [*context, intro] if intro else context)

    walk("", [])
    return out


def test_chunks_against_a_walk_down_the_tree(spark):
    rng = random.Random(5)
    sections = [random_section(rng, str(i)) for i in range(25)]
    segments = spark.createDataFrame([s for sec in sections for s in sec[0]], SEGMENTS)
    nodes = spark.createDataFrame([n for sec in sections for n in sec[1]], NODES)
    found = TC.tree_chunks(segments, nodes, KEY, limit=60).cache()
    got = sorted((r["section"], r["node_id"], r["kind"], r["char_start"], r["char_end"], r["parent_context"], r["fragment_index"], r["fragment_count"]) for r in found.collect())
    want = sorted((str(i), *row) for i, sec in enumerate(sections) if sec[0] for row in expected(*sec, 60))
    assert got == want
    texts = {str(i): "".join(s[4] for s in sec[0]) for i, sec in enumerate(sections)}
    for r in found.collect():
        assert r["text"] == texts[r["section"]][r["char_start"] : r["char_end"]]
        assert r["token_count"] == len(whitespace_tokens(r["embedding_text"])) + 2 <= 60
        assert r["embedding_text"].endswith(r["text"]) and r["embedding_text"].startswith(r["heading"])
        for span in r["context_spans"]:
            assert span["text"] == texts[r["section"]][span["char_start"] : span["char_end"]]
        assert r["context_refs"][-1] == r["node_id"]
    lengths = spark.createDataFrame([("A", k, len(v)) for k, v in texts.items()], "act string, section string, n long")
    assert coverage_faults(found.join(lengths, KEY), KEY, "n").count() == 0


def test_long_leaf_is_split_and_a_long_prefix_is_an_error(spark):
    segments = spark.createDataFrame([("A", "1", 0, [""], "Intro words here. "), ("A", "1", 1, ["", "/a"], "word. " * 200)], SEGMENTS)
    nodes = spark.createDataFrame([("A", "1", "", "Section 1", "section"), ("A", "1", "/a", "Section 1(a)", "clause")], NODES)
    rows = TC.tree_chunks(segments, nodes, KEY, limit=60).orderBy("char_start").collect()
    assert [r["kind"] for r in rows][:2] == ["residual", "clause"] and rows[-1]["fragment_count"] == len(rows) - 1 > 3
    assert rows[1]["parent_context"] == "Intro words here." and rows[1]["embedding_text"].startswith("Section 1(a)\nIntro words here.\nword.")
    with pytest.raises(Exception, match="no room"):
        TC.tree_chunks(segments.withColumn("text", F.expr("repeat(text, 30)")), nodes, KEY, limit=60).collect()
    assert TC.tree_chunks(segments.where("false"), nodes, KEY).count() == 0


def test_provisions_are_cut_along_their_tree(spark):
    lines = [("Whoever acts " + "and acts " * 20, 60, 100), ("(1) first " + "rule " * 30, 80, 112), ("(a) one part", 100, 124), ("(b) another " + "part " * 40, 100, 136), ("(2) second rule", 80, 150)]
    rows = spark.createDataFrame([("A", "1", i, t, float(x), float(y)) for i, (t, x, y) in enumerate(lines)], "act string, section_number string, seq int, text string, x double, y double")
    key = ["act", "section_number"]
    segments = P.provision_segments(rows, key, indent=70).cache()
    nodes = P.provision_headings(segments, key, F.lit("Title"))
    chunks = TC.tree_chunks(segments, nodes, key, limit=127).orderBy("char_start").collect()
    assert [(r["node_id"], r["kind"]) for r in chunks] == [("", "residual"), ("/(1)", "num"), ("/(2)", "num")]
    assert chunks[1]["heading"] == "A § 1(1) | Title" and chunks[1]["text"].startswith("(1) first rule") and chunks[1]["parent_context"].startswith("Whoever acts")
    small = TC.tree_chunks(segments, nodes, key, limit=125).orderBy("char_start").collect()
    assert [(r["node_id"], r["kind"]) for r in small] == [("", "residual"), ("/(1)", "residual"), ("/(1)/(a)", "alpha"), ("/(1)/(b)", "alpha"), ("/(2)", "num")]
    whole = "".join(r["text"] for r in segments.orderBy("ord").collect())
    assert "".join(r["text"] for r in small) == "".join(r["text"] for r in chunks) == whole
    path = segments.where("ord = 2").select(TC.section_path(F.col("act"), F.col("section_number"), F.lit(None), F.col("above"), F.array(F.lit("section"), F.lit("subsection"), F.lit("clauses"))).alias("p")).first()["p"]
    assert path == {"act": "A", "section_number": "1", "subsection_id": "(1)", "clauses_id": "(a)"}


def test_tree_paths(spark):
    edges = spark.createDataFrame([("g", "a", None), ("g", "b", "a"), ("g", "c", "b"), ("h", "a", None), ("h", "c", "a")], "g string, node_id string, parent_id string")
    assert {(r["g"], r["node_id"]): r["above"] for r in TC.tree_paths(edges, ["g"]).collect()} == {("g", "a"): ["a"], ("g", "b"): ["a", "b"], ("g", "c"): ["a", "b", "c"], ("h", "a"): ["a"], ("h", "c"): ["a", "c"]}
    for bad in ([("g", "a", "b"), ("g", "b", "a")], [("g", "a", "missing")], [("g", "a", None), ("g", "b", "a"), ("g", "b", "a")]):
        with pytest.raises(ValueError, match="no forest"):
            TC.tree_paths(spark.createDataFrame(bad, "g string, node_id string, parent_id string"), ["g"])


def test_table_rows_stay_whole(spark):
    rows = spark.createDataFrame([("r1", "Head", ["Offence\nname", "By"], ["Theft", None], 1), ("r2", "Head", ["Offence\nname", "By"], ["Hurt", "x"], 2)], "row_id string, heading string, columns array<string>, cells array<string>, row_ordinal int")
    got = TC.row_chunks(rows, ["row_id"], context=F.array(F.lit("Table of offences"))).orderBy("row_id").collect()
    assert got[0]["text"] == "Offence name: Theft\nBy: " and got[1]["embedding_text"] == "Head | Row 2\nTable of offences\nOffence name: Hurt\nBy: x"
    assert got[1]["token_count"] == len(got[1]["embedding_text"].split()) + 2
    with pytest.raises(Exception, match="more than 5"):
        TC.row_chunks(rows, ["row_id"], limit=5).collect()
    with pytest.raises(Exception, match="columns and cells differ"):
        TC.row_chunks(rows.withColumn("cells", F.array(F.lit("x"))), ["row_id"]).collect()


def test_compact_text_maps_places_back():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab é\n\t ") for _ in range(rng.randrange(0, 40)))
        kept = [i for i, c in enumerate(text) if not c.isspace()]
        found = CompactText(text)
        assert found.compact == "".join(text[i] for i in kept) and [found.place(i) for i in range(len(kept))] == kept


def test_fragments_are_located_in_order(spark):
    parents = spark.createDataFrame([(1, "One  two\none two three"), (2, None), (4, "abc")], "doc long, text string")
    parts = spark.createDataFrame([(1, 0, "one"), (1, 1, "t wo"), (1, 2, "one two"), (1, 3, " \n"), (1, 4, None), (1, 5, "three"), (2, 0, "x"), (3, 0, "y"), (4, 0, "b"), (4, 1, "a")], "doc long, nth int, fragment string")
    got = {(r["doc"], r["nth"]): (r["char_start"], r["char_end"]) for r in located(parents, parts, ["doc"], "nth").collect()}
    none = (None, None)
    # the first "one" is looked for as it is written, so it is the second line's; "one two" isn't behind it any more
    assert got == {(1, 0): (9, 12), (1, 1): (13, 16), (1, 2): none, (1, 3): none, (1, 4): none, (1, 5): (17, 22), (2, 0): none, (3, 0): none, (4, 0): (1, 2), (4, 1): none}
    with pytest.raises(Exception, match="not in its text"):
        located(parents, parts, ["doc"], "nth", missing="error").collect()
    assert located(parents, parts.where("false"), ["doc"], "nth").count() == 0
