"""Tables that run over pages: columns by each page's layout, rows by where their cells begin, rows that go on overleaf."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passagework.operators.ordered import dealt, running
from passagework.operators.provisions import runs_from_first
from passagework.operators.structure import as_of

#: A word this far left of a column's start still belongs to it, and a row begins this much lower than the one before.
SLACK, DROP = 1.7, 2.0


def layout_table(spark: SparkSession, layouts: Sequence[tuple[int, int, Sequence[float]]]) -> DataFrame:
    """``page, last, starts`` of layouts ``(first page, last page, column starts)``; later ones replace earlier ones on their pages.

    A row is a range of pages, from ``page`` to ``last``, and ranges share no page, so a layout of any number of pages is few rows.
    """
    opens = sorted((first, i) for i, (first, last, _) in enumerate(layouts) if first <= last)
    edges = sorted({edge for first, last, _ in layouts if first <= last for edge in (first, last + 1)})
    ranges, held, n = [], [], 0
    for page, end in zip(edges, edges[1:], strict=False):
        while n < len(opens) and opens[n][0] <= page:
            heapq.heappush(held, -opens[n][1])
            n += 1
        while held and layouts[-held[0]][1] < page:
            heapq.heappop(held)
        if held:
            ranges.append((page, end - 1, [float(s) for s in sorted(layouts[-held[0]][2])]))
    return spark.createDataFrame(ranges, "page int, last int, starts array<double>")


def column_of(x: Column, starts: Column, slack: float = SLACK) -> Column:
    """0-based column of a place: the last one that starts at or before it, and the first for what lies before all."""
    return F.greatest(F.lit(0), F.size(F.filter(starts, lambda s: s - slack <= x)) - 1)


def page_starts(words: DataFrame, layouts: DataFrame) -> DataFrame:
    """``page, starts`` of the pages of ``words`` that a range of ``layouts`` holds: the last one that begins at or before the page, unless it ends before."""
    pages = words.where("page IS NOT NULL").select("page").distinct()
    return as_of(pages, layouts, [], "page", ["last", "starts"]).where("page <= last").select("page", "starts")


def page_rows(words: DataFrame, layouts: DataFrame, table: Sequence[str] = (), *, slack: float = SLACK, drop: float = DROP) -> DataFrame:
    """``table`` columns, ``page, row, cells`` of words (``table`` columns, ``page, line, seq, x, y, text``), with as many cells as the page's layout (see ``layout_table``) has columns.

    ``line`` and ``seq`` order the words of a page.  Words of one line and column are joined by a space, the lines of a
    cell by a line feed.  A row begins where the words come back to one of the first two columns from a later one,
    more than ``drop`` lower than the row's first word.  Rows that only number the columns are left out.
    A page without a layout is an error.  Rows are found in one Arrow batch for each page; a page is as large as paper.
    """
    key = [*table, "page"]
    laid = words.join(page_starts(words, layouts).withColumnRenamed("page", "_page"), F.col("page") == F.col("_page"), "left").drop("_page")
    starts = F.when(F.col("starts").isNull(), F.raise_error(F.concat(F.lit("no layout for page "), F.col("page").cast("string"))).cast("array<double>")).otherwise(F.col("starts"))
    placed = laid.withColumn("starts", starts).withColumn("column", column_of(F.col("x"), F.col("starts"), slack))
    own = W.partitionBy(*key).orderBy("line", "seq")
    begins = F.coalesce((F.col("line") != F.lag("line").over(own)) | (F.col("column") != F.lag("column").over(own)), F.lit(True))
    pieces = placed.withColumn("_begins", begins.cast("int")).withColumn("_piece", F.sum("_begins").over(own.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line", "seq", "text")))
    segments = pieces.groupBy(*key, F.col("_piece").alias("seq")).agg(
        F.first("column").alias("column"), F.first("y").alias("y"), F.size(F.first("starts")).alias("width"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")
    )
    numbered = runs_from_first(segments, key, "row", lambda first, before, now: now["column"] <= 1 and now["column"] < before["column"] and now["y"] > first["y"] + drop)
    held = F.array_sort(F.collect_list(F.struct("seq", "column", "text")))
    rows = numbered.groupBy(*key, "row").agg(held.alias("_held"), F.max("width").alias("width"))
    cell = lambda c: F.array_join(F.transform(F.filter("_held", lambda p: p["column"] == c), lambda p: p["text"]), "\n")
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), cell)
    return rows.select(*key, "row", cells.alias("cells")).withColumn("_numbers", F.transform(F.sequence(F.lit(1), F.size("cells")), lambda i: i.cast("string"))).where("cells <> _numbers").drop("_numbers")


def joined_rows(rows: DataFrame, table: Sequence[str] = ()) -> DataFrame:
    """``table`` columns, ``row, page, cells`` of whole rows, counted from 1 over all pages.

    A row whose first cell is empty at the top of a page goes on from the page before: its cells are added to those of
    that row, each on a new line.  ``page`` is where a row begins.  Tables of any number of pages are spread over tasks.
    """
    top = F.row_number().over(W.partitionBy(*table, "page").orderBy("row")) == 1
    one = rows.select(*table, F.lit(0).alias("_all"), "page", "row", "cells", (top & (F.trim(F.col("cells")[0]) == "")).alias("_goes_on"))
    group, order = [*table, "_all"], ["page", "row"]
    seen = running(dealt(one, group, order), group, order, {"_nth": ("sum", (~F.col("_goes_on")).cast("long"))})
    parts = F.array_sort(F.collect_list(F.struct("page", "row", "cells")))
    width = F.array_max(F.transform("_parts", lambda p: F.size(p["cells"])))
    cell = lambda i: F.array_join(F.filter(F.transform("_parts", lambda p: F.get(p["cells"], i)), lambda c: c.isNotNull() & (c != "")), "\n")
    whole = seen.groupBy(*table, "_nth").agg(parts.alias("_parts"))
    return whole.select(*table, F.greatest("_nth", F.lit(1)).alias("row"), F.col("_parts")[0]["page"].alias("page"), F.transform(F.sequence(F.lit(0), width - 1), cell).alias("cells"))


def small_share(spans: Column, size: float) -> Column:
    """Share of a line's characters that are set smaller than ``size``; spans are structs with ``text, size``, and a line without characters has none."""
    chars = lambda keep: F.aggregate(F.filter(spans, keep), F.lit(0), lambda n, s: n + F.length(s["text"]))
    return F.try_divide(chars(lambda s: s["size"] < size), chars(lambda s: F.lit(True)))


def footnote_lines(lines: DataFrame, *, page: Column, top: Column, size: float = 10.1, share: float = 0.8) -> DataFrame:
    """Lines (``page, y, spans``) below ``top`` of ``page`` that are small print: more than ``share`` of their characters are below ``size``."""
    return lines.where((F.col("page") == page) & (F.col("y") > top) & (F.coalesce(small_share(F.col("spans"), size), F.lit(0.0)) > share))


def in_bands(page: Column, y: Column, bands: Sequence[tuple[int, float, float]]) -> Column:
    """0-based number of the first band ``(page, top, bottom)`` that holds a place, its bottom left out; null in none."""
    found = F.lit(None).cast("int")
    for i, (p, top, bottom) in reversed(list(enumerate(bands))):
        found = F.when((page == p) & (y >= top) & (y < bottom), i).otherwise(found)
    return found


def is_group_heading(text: Column, x: Column, act: Column, patterns: dict[str, str], *, left: float = 120.0) -> Column:
    """Whether a line stands right of ``left`` and matches its act's pattern; acts without one have no group headings."""
    fits = F.lit(False)
    for name, pattern in patterns.items():
        fits = F.when(act == name, text.rlike(pattern)).otherwise(fits)
    return F.coalesce((x > left) & fits, F.lit(False))
