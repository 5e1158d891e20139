"""Checks of parsed documents against their lines, and of a vector index against what was put into it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passagework.functions.hashing import uuid5
from passagework.functions.text import compact, same_characters
from passagework.functions.vectors import all_close, is_finite, norm
from passagework.operators.validation import duplicates

# How a section's number, the dash behind its title and a provision's label look, and how many lines a title has at most.
NUMBER, DASH, LABEL, TITLE_LINES = r"^(\d+)\.\s*[—–]*\s*", r"\s*(?:—|––|–|--)+\s*", r"^\((?:\d+|[A-Za-z]+)\)$", 7


def headed(lines: DataFrame, group: Sequence[str]) -> DataFrame:
    """Group columns, ``number, title, body`` of sections from their lines (``seq, text``).

    The title ends at the first dash of the first seven lines; what follows on that line and the lines below are the body.
    A section whose first line has no number, and one without a dash in time, are errors.
    """
    keys = list(group)
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("seq"))
    numbered = lines.select(*keys, "seq", "text", nth.alias("nth")).withColumn("text", F.when(F.col("nth") == 1, F.regexp_replace("text", NUMBER, "")).otherwise(F.col("text")))
    first = lines.groupBy(*keys).agg(F.min_by("text", "seq").alias("_first"))
    ends = numbered.where((F.col("nth") <= TITLE_LINES) & F.col("text").rlike(DASH)).groupBy(*keys).agg(F.min("nth").alias("_end"))
    found = first.join(ends, keys, "left")
    name = F.concat_ws(" ", *(F.col(k).cast("string") for k in keys))
    number = F.when(F.col("_first").rlike(NUMBER), F.regexp_extract("_first", NUMBER, 1)).otherwise(F.raise_error(F.concat(F.lit("no section number: "), name)).cast("string"))
    end = F.when(F.col("_end").isNull(), F.raise_error(F.concat(F.lit("the title has no end: "), name)).cast("int")).otherwise(F.col("_end"))
    placed = numbered.join(found.select(*keys, number.alias("number"), end.alias("_end")), keys)
    here, parts = F.col("nth") == F.col("_end"), F.split("text", DASH, 2)
    title = F.when(F.col("nth") < F.col("_end"), F.col("text")).when(here, parts[0])
    body = F.when(F.col("nth") > F.col("_end"), F.col("text")).when(here & (parts[1] != ""), parts[1])
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("nth", c.alias("t"))))), lambda x: x["t"]), sep)
    return placed.groupBy(*keys, "number").agg(joined(title, " ").alias("title"), joined(body, "\n").alias("body"))


def child_faults(edges: DataFrame, group: Sequence[str], *, label: Column | None = None) -> DataFrame:
    """Group columns, ``node_id, fault`` of provisions that don't fit their parent, from ``node_id, parent_id, label, text, residual_text``.

    Faults: ``repeated label`` among siblings, ``label`` of another form, ``missing text``, and ``not in its parent`` (white space aside).  All
    levels are checked by one join.  ``label`` gives labels in brackets; by default those of the edges are put into them.
    """
    keys = list(group)
    shown = label if label is not None else F.concat(F.lit("("), "label", F.lit(")"))
    below = edges.where("parent_id IS NOT NULL").select(*keys, "node_id", "parent_id", shown.alias("label"), "text", "residual_text")
    above = edges.select(*keys, F.col("node_id").alias("parent_id"), F.col("text").alias("whole"))
    again = duplicates(below, [*keys, "parent_id", "label"]).select(*keys, "parent_id", "label", F.lit(True).alias("again"))
    both = below.join(above, [*keys, "parent_id"], "left").join(again, [*keys, "parent_id", "label"], "left")
    held = F.coalesce(F.contains(compact(F.col("whole")), compact(F.col("text"))), F.lit(False))
    faults = F.array_compact(F.array(
        F.when(F.col("again"), F.lit("repeated label")), F.when(~F.coalesce(F.col("label").rlike(LABEL), F.lit(False)), F.lit("label")),
        F.when(F.col("text").isNull() | F.col("residual_text").isNull(), F.lit("missing text")).when(~held, F.lit("not in its parent")),
    ))
    return both.select(*keys, "node_id", F.explode(faults).alias("fault"))


def body_faults(sections: DataFrame, lines: DataFrame, group: Sequence[str]) -> DataFrame:
    """Group columns, ``fault``: sections (``number, title, text``) that don't hold exactly the characters of their lines (``seq, text``), white space aside.

    ``lines``: the section has none; ``title``: the lines don't begin with number and title; ``text``: what follows is another text.
    """
    keys = list(group)
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    source = lines.groupBy(*keys).agg(compact(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("_source"))
    both = sections.join(source, keys, "left")
    head = F.concat(F.col("number").cast("string"), F.lit("."))
    bare = F.regexp_replace(F.substr("_source", F.length(head) + 1), "^[—–]*", "")
    title = compact(F.col("title"))
    body = F.regexp_replace(F.substr(bare, F.length(title) + 1), "^[—–-]+", "")
    fault = (
        F.when(F.col("_source").isNull(), "lines").when(~(F.startswith(F.col("_source"), head) & F.startswith(bare, title)), "title")
        .when(body != compact(F.col("text")), "text")
    )
    return both.select(*keys, fault.alias("fault")).where("fault IS NOT NULL")


def table_faults(rows: DataFrame, lines: DataFrame, width: int, page: str = "page") -> DataFrame:
    """``page, fault`` of table pages whose rows (``cells``) don't hold the characters of their lines (``text``) or haven't ``width`` cells.

    Order and white space don't count.  A page without rows or without lines is ``content`` as well.
    """
    chars = lambda c: compact(F.array_join(F.collect_list(c), ""))
    given = lines.groupBy(page).agg(chars(F.col("text")).alias("_given"))
    read = rows.groupBy(page).agg(chars(F.array_join("cells", "")).alias("_read"), F.bool_or(F.size("cells") != width).alias("_wide"))
    both = given.join(read, page, "full")
    same = F.coalesce(same_characters(F.col("_given"), F.col("_read")), F.lit(False))
    faults = F.array_compact(F.array(F.when(~same, F.lit("content")), F.when(F.col("_wide"), F.lit("width"))))
    return both.select(page, F.explode(faults).alias("fault"))


def count_faults_of(found: DataFrame, pages: DataFrame, expected: DataFrame, act: str = "act") -> DataFrame:
    """``act, what, n, expected`` of acts whose pages, sections, chapters or group headings are not as many as expected.

    ``found``: ``act, chapter, group_heading`` for each section; ``pages``: ``act`` for each page; ``expected``: ``act, pages, sections, chapters, groups``.
    """
    counts = found.groupBy(act).agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("chapter").alias("chapters"), F.count_distinct("chapter", "group_heading").alias("groups"))
    have = counts.join(pages.groupBy(act).agg(F.count(F.lit(1)).alias("pages")), act, "full")
    names = ("pages", "sections", "chapters", "groups")
    both = have.select(act, *(F.col(n).alias(f"n_{n}") for n in names)).join(expected, act, "full")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias("n"), F.coalesce(n, F.lit(0)).cast("long").alias("expected")) for n in names)))
    return both.select(act, each.alias("c")).select(act, "c.*").where("n <> expected")


def index_faults(vectors: DataFrame, points: DataFrame, payload: Sequence[str], *, key: str = "chunk_id") -> DataFrame:
    """``point_id, fault`` of a vector index against what was put into it.

    ``vectors``: ``key, embedding`` and the ``payload`` columns; ``points``: ``point_id, key, vector`` and the same columns.  A point is stored under
    the uuid5 of its key, with its vector at length 1.  Faults: ``not finite`` and ``length`` of a source vector, ``missing`` and ``unknown``
    points, ``another key``, ``payload: <column>`` and ``vector``.
    """
    source = vectors.select(uuid5(F.col(key).cast("string")).alias("point_id"), F.col(key).alias("_key"), "embedding", *(F.col(c).alias(f"_{c}") for c in payload), F.lit(True).alias("_source"))
    both = source.join(points.select("point_id", key, "vector", *payload, F.lit(True).alias("_point")), "point_id", "full")
    unit = F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding")))
    there = F.col("_source").isNotNull() & F.col("_point").isNotNull()
    finite = F.coalesce(is_finite(F.col("embedding")), F.lit(False))
    faults = F.array_compact(F.array(
        F.when(F.col("_point").isNull(), F.lit("missing")), F.when(F.col("_source").isNull(), F.lit("unknown")), F.when(F.col("_source") & ~finite, F.lit("not finite")),
        F.when(F.col("_source") & finite & (F.abs(norm(F.col("embedding")) - 1) > 1e-5), F.lit("length")), F.when(there & ~F.col(key).eqNullSafe(F.col("_key")), F.lit("another key")),
        *(F.when(there & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"payload: {c}")) for c in payload),
        F.when(there & finite & ~F.coalesce(all_close(F.col("vector"), unit), F.lit(False)), F.lit("vector")),
    ))
    return both.select("point_id", F.explode(faults).alias("fault"))

