"""Scans with a state, nearest rows, glyphs, positions and tables over pages."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators import glyphs, nearest, page_tables, positions, scans
from passagework.sources.scratch import scratch_root


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def anchors_of(values, width):
    out, anchor = [], None
    for v in values:
        anchor = v if anchor is None or v >= anchor + width else anchor
        out.append(anchor)
    return out


def test_anchor_tables_chain_like_the_whole():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        width, kind = rng.choice([1, 3, 10]), T.LongType()
        values = sorted(rng.randrange(60) for _ in range(rng.randrange(1, 40)))
        cuts = sorted(rng.randrange(len(values) + 1) for _ in range(rng.randrange(4)))
        rule, state, out = scans.Anchors(width, kind), None, []
        for a, b in zip([0, *cuts], [*cuts, len(values)]):
            if a == b:
                continue
            part = np.array(values[a:b])
            mine, behind = rule.decide(part, state)
            assert rule.after(*rule.table(part), state) == behind
            out += mine.tolist()
            state = behind
        assert out == anchors_of(values, width)


def test_turn_tables_chain_like_the_whole():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        values = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 30))]
        cut = rng.randrange(1, len(values) + 1)
        rule, state, out = scans.Turns(1), None, []
        for part in (values[:cut], values[cut:]):
            if part:
                mine, behind = rule.decide(np.array(part), state)
                assert rule.after(*rule.table(np.array(part)), state) == behind
                out += mine.tolist()
                state = behind
        wanted, want = 1, []
        for v in values:
            want.append(v == wanted)
            wanted += v == wanted
        assert out == want


def test_hot_group_over_many_parts(spark, many_parts):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(3000), i) for i in range(1500)] + [("equal", 7, i) for i in range(500)] + [(rng.choice([None, "a", "b"]), rng.randrange(50), i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = scans.anchored(df, ["g"], ["v", "id"], 10).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted(((r["v"], r["id"], r["anchor"]) for r in got if r["g"] == g))
        assert [a for *_, a in mine] == anchors_of([v for v, *_ in mine], 10)
    turns = scans.next_in_turn(df.select("g", "id", (F.col("v") % 40).alias("n")), ["g"], ["id"], "n", first=0).where("g = 'hot' AND accepted").orderBy("id").collect()
    wanted = 0
    for _, v, _ in sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[2]):
        wanted += v % 40 == wanted
    assert [r["n"] for r in turns] == list(range(wanted)) and wanted > 5
    assert scans.anchored(df.where("false"), ["g"], ["v", "id"], 10).count() == 0


def test_nearest_against_all_pairs(spark, many_parts):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), round(rng.random() * 50, 1)) for i in range(300)]
    look = [(rng.choice("ac"), round(rng.random() * 50, 1), 100 + i) for i in range(60)]
    got = nearest.nearest_within(spark.createDataFrame(rows, "id int, g string, v double"), spark.createDataFrame(look, "g string, v double, x int"), ["g"], "v", ["x"], 1.0)
    for r in got.collect():
        near = sorted((abs(r["v"] - v), v, -x) for g, v, x in look if g == r["g"] and abs(r["v"] - v) < 1.0)
        assert (r["near_v"], r["x"]) == ((near[0][1], -near[0][2]) if near else (None, None))


def test_words_from_glyphs(spark, many_parts):
    rows, want = [], []
    for page, lines in ((1, ["Two words", "  left  apart "]), (2, ["x"])):
        for n, line in enumerate(lines):
            for i, c in enumerate(line):
                rows.append((page, 100 * n + i, c, 6.0 * i, 6.0, 20.0 * n + (i % 2) * 1.5))
    rows += [(3, i, c, x, 5.0, 0.0) for i, (c, x) in enumerate([("a", 0.0), ("b", 5.0), ("c", 11.6), ("d", 16.0)])]
    df = spark.createDataFrame(rows, "page int, seq int, c string, x double, width double, y double")
    got = [(r["page"], r["y"], r["word_no"], r["x"], r["text"]) for r in glyphs.glyph_words(df, ["page"]).orderBy("page", "y", "word_no").collect()]
    want = [(1, 0.0, 1, 0.0, "Two"), (1, 0.0, 2, 24.0, "words"), (1, 20.0, 1, 12.0, "left"), (1, 20.0, 2, 48.0, "apart"), (2, 0.0, 1, 0.0, "x"), (3, 0.0, 1, 0.0, "ab"), (3, 0.0, 2, 11.6, "cd")]
    assert got == want
    assert glyphs.glyph_words(df.where("false"), ["page"]).count() == 0


def plain_words(glyphs, tolerance=2.0, gap=0.3):
    """``page, y, word_no, x, right, text`` by plain Python."""
    out, line_of = [], {}
    for page in {g[0] for g in glyphs}:
        base = None
        for g in sorted((g for g in glyphs if g[0] == page), key=lambda g: (g[5], g[1])):
            base = g[5] if base is None or g[5] >= base + tolerance else base
            line_of.setdefault((page, base), []).append(g)
    for (page, y), line in line_of.items():
        words, before = [], None
        for g in sorted(line, key=lambda g: (g[3], g[1])):
            if g[2].strip():
                if before is None or not words or not before[2].strip() or g[3] > before[3] + before[4] * (1 + gap):
                    words.append([])
                words[-1].append(g)
            before = g
        out += [(page, y, n, w[0][3], max(g[3] + g[4] for g in w), "".join(g[2] for g in w)) for n, w in enumerate(words, 1)]
    return sorted(out, key=lambda w: (w[0] is not None, w))


def random_glyphs(pages, n, seed):
    rng = random.Random(seed)
    rows = [(page, 3 * i - 50, rng.choice("abç😀   "), float(rng.randrange(300)) / 4 - 9, rng.choice([0.5, 1.0, 1.25]), rng.randrange(40) / 3 - 2) for page in pages for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1_000_000, 100, 5])
def test_words_of_whole_and_of_spread_pages(spark, many_parts, monkeypatch, most):
    monkeypatch.setattr(glyphs, "PAGE_GLYPHS", most)
    monkeypatch.setattr(glyphs, "GLYPHS_AT_ONCE", 150)
    rows = [*random_glyphs(["a", "", None], 90, 1), *random_glyphs(["hot"], 400, 2)]
    df = spark.createDataFrame(rows, "page string, seq int, c string, x double, width double, y double").repartition(5)
    got = sorted((tuple(r[c] for c in ("page", "y", "word_no", "x", "right", "text")) for r in glyphs.glyph_words(df, ["page"]).collect()), key=lambda w: (w[0] is not None, w))
    assert got == plain_words(rows) and None in {w[0] for w in got}


def test_glyphs_travel_packed(spark):
    """A glyph takes about a byte on the way, and none is written; glyphs without a place go with the spread pages."""
    lines = spark.range(300).select(F.col("id").alias("page"), F.posexplode(F.split(F.concat_ws(" ", *(F.sha2((F.col("id") * 5 + k).cast("string"), 256) for k in range(5))), "")).alias("i", "c"))
    df = lines.select("page", F.col("i").alias("seq"), "c", (F.col("i") * 5.0).alias("x"), F.lit(5.0).alias("width"), (F.col("i") % 3 * 0.4).alias("y"))
    before = set(os.listdir(scratch_root(spark)))
    got = glyphs.glyph_words(df, ["page"])
    assert got.count() == 1500 and got.where("length(text) <> 64 OR y <> 0 OR right <> x + 320").isEmpty()
    written = [os.path.join(d, f) for x in set(os.listdir(scratch_root(spark))) - before for d, _, names in os.walk(os.path.join(scratch_root(spark), x)) for f in names if f.endswith(".parquet")]
    assert sum(map(os.path.getsize, written)) < 20_000
    words = np.array([range(324), *([k * 5.0 for k in range(324)] for _ in range(3))])
    numbers = np.concatenate([words[:1].astype(np.uint64), words[1:].view(np.uint64)])
    text = np.frombuffer(b"0123456789abcdef" * 20 + b"ghij", np.uint8)
    data = glyphs.packed_glyphs(numbers, np.arange(324) % 65 == 64, np.ones(324, np.int64), text)
    assert len(data) < 324 and all((x == y).all() for x, y in zip(glyphs.unpacked_glyphs(data), (numbers, np.arange(324) % 65 == 64, np.ones(324), text), strict=True))
    odd = df.where("page < 2").withColumn("x", F.when((F.col("page") == 1) & (F.col("seq") == 7), None).otherwise(F.col("x")))
    assert glyphs.glyph_words(odd, ["page"]).groupBy("page").agg(F.min("text")).count() == 2


def test_zip_by_position(spark, many_parts):
    left = spark.createDataFrame([(i * 7 % 101, f"l{i}") for i in range(100)], "k int, a string")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(100)], "o int, b string")
    got = positions.zipped(left, right, ["k"], ["o"]).orderBy("position").collect()
    assert [r["o"] for r in got] == list(range(100)) and [r["k"] for r in got] == sorted(i * 7 % 101 for i in range(100))
    with pytest.raises(Exception, match="different lengths"):
        positions.zipped(left, right.where("o < 99"), ["k"], ["o"]).collect()
    with pytest.raises(ValueError, match="both sides"):
        positions.zipped(left, left, ["k"], ["k"])


WORDS = "page int, line int, seq int, x double, y double, text string"


def test_table_uses_glyph_columns(spark):
    layouts = page_tables.layout_table(spark, [(1, 3, [72, 220, 380]), (2, 2, [80, 240, 400])])
    words = [(1, 0, 0, 72.0, 100.0, "Alpha"), (1, 0, 1, 220.0, 100.0, "12(1)"), (1, 0, 2, 380.0, 100.0, "First"), (1, 0, 3, 405.0, 100.0, "person"), (1, 1, 0, 72.0, 145.0, "Beta"), (1, 1, 1, 218.5, 145.0, "13"), (1, 1, 2, 380.0, 145.0, "Second person")]
    got = page_tables.page_rows(spark.createDataFrame(words, WORDS), layouts).orderBy("row").collect()
    assert [r["cells"] for r in got] == [["Alpha", "12(1)", "First person"], ["Beta", "13", "Second person"]]
    more = [*words, (2, 0, 0, 80.0, 50.0, "1"), (2, 0, 1, 240.0, 50.0, "2"), (2, 0, 2, 400.0, 50.0, "3"), (2, 1, 0, 250.0, 60.0, "overleaf"), (2, 2, 0, 79.0, 90.0, "Gamma"), (2, 2, 1, 250.0, 90.0, "x"), (3, 0, 0, 72.0, 10.0, "Delta")]
    rows = page_tables.page_rows(spark.createDataFrame(more, WORDS), layouts)
    joined = page_tables.joined_rows(rows).orderBy("row").collect()
    assert [(r["row"], r["page"], r["cells"]) for r in joined] == [(1, 1, ["Alpha", "12(1)", "First person"]), (2, 1, ["Beta", "13\noverleaf", "Second person"]), (3, 2, ["Gamma", "x", ""]), (4, 3, ["Delta", "", ""])]
    with pytest.raises(Exception, match="no layout for page 9"):
        page_tables.page_rows(spark.createDataFrame([(9, 0, 0, 1.0, 1.0, "x")], WORDS), layouts).collect()


def test_layouts_are_ranges_of_any_number_of_pages(spark, many_parts):
    layouts = page_tables.layout_table(spark, [(0, 9, [72, 220]), (10, 2**31 - 1, [90, 240, 400]), (8, 11, [60]), (200_000, 200_000, [50, 30]), (7, 6, [1])])
    held = [(r["page"], r["last"], r["starts"]) for r in layouts.orderBy("page").collect()]
    assert held == [(0, 7, [72, 220]), (8, 9, [60]), (10, 11, [60]), (12, 199_999, [90, 240, 400]), (200_000, 200_000, [30, 50]), (200_001, 2**31 - 1, [90, 240, 400])]
    pages = {0: 2, 7: 2, 9: 1, 11: 1, 12: 3, 150_000: 3, 200_000: 2, 2**31 - 1: 3}
    words = spark.createDataFrame([(page, 0, 0, 100.0, 10.0, "x") for page in pages], WORDS)
    assert {r["page"]: len(r["cells"]) for r in page_tables.page_rows(words, layouts).collect()} == pages
    short = page_tables.layout_table(spark, [(1, 3, [72]), (6, 7, [72])])
    assert [r["page"] for r in page_tables.page_starts(spark.range(10).select(F.col("id").cast("int").alias("page")), short).orderBy("page").collect()] == [1, 2, 3, 6, 7]
    with pytest.raises(Exception, match="no layout for page 9"):
        page_tables.page_rows(words.where("page IN (7, 9)"), short).collect()
    assert page_tables.layout_table(spark, []).count() == 0


def test_region_predicates(spark):
    spans = "array<struct<text:string,size:double>>"
    lines = spark.createDataFrame([(1, 1, 700.0, [("12345678", 8.0), ("9", 12.0)]), (2, 1, 700.0, [("1234567", 8.0), ("89", 12.0)]), (3, 1, 600.0, [("all", 8.0)]), (4, 2, 700.0, [("all", 8.0)]), (5, 1, 700.0, []), (6, 1, 700.0, None)], f"id int, page int, y double, spans {spans}")
    found = page_tables.footnote_lines(lines, page=F.lit(1), top=F.lit(690.0))
    assert [r["id"] for r in found.collect()] == [1]
    bands = [(1, 100, 650), (1, 600, 701), (2, 0, 700)]
    assert [r["b"] for r in lines.orderBy("id").select(page_tables.in_bands(F.col("page"), F.col("y"), bands).alias("b")).collect()] == [1, 1, 0, None, 1, 1]
    heads = spark.createDataFrame([("Of theft", 130.0, "BNS"), ("Of theft", 110.0, "BNS"), ("A.—Bail", 200.0, "BNSS"), ("A.—Bail", 200.0, "BNS"), ("Of theft", 130.0, None), (None, 130.0, "BNS")], "t string, x double, act string")
    fits = page_tables.is_group_heading(F.col("t"), F.col("x"), F.col("act"), {"BNS": r"^Of |^of abetment$", "BNSS": r"^[A-E]\.[—–]"})
    assert [r["f"] for r in heads.select(fits.alias("f")).collect()] == [True, False, True, False, False, False]
