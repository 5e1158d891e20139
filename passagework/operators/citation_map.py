"""The citation map: one entry for each thing that can be cited, from the tables of a document's parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.ordered import running
from passagework.operators.ordered import dealt as ordered_parts
from passagework.operators.validation import duplicates, require_empty

REGION = "struct<page_number:int,bbox:array<double>>"
#: Columns of an entry that not every kind has, with their types.
OPTIONAL = {
    "section_number": "string", "subsection_id": "string", "source_pages": "array<int>", "section_regions": f"array<{REGION}>", "row_ordinal": "int",
    "parent_citation_id": "string", "char_start": "int", "char_end": "int",
}


def snapshot_prefix(act: Column, year: int, source_sha256: Column) -> Column:
    """``act-year-`` and twelve digits of the source's hash, with which ids of one snapshot begin."""
    return F.concat_ws("-", act, F.lit(str(year)), F.substring(source_sha256, 1, 12))


def pages_and_regions(lines: DataFrame, group: Sequence[str]) -> DataFrame:
    """Group columns, ``source_pages`` (sorted) and ``section_regions``: on each page the box around the group's lines (``page, x0, y0, x1, y1``).

    Boxes are rounded to two digits.
    """
    box = F.array(*(F.round(F.col(c).cast("double"), 2) for c in ("x0", "y0", "x1", "y1")))
    on_page = lines.groupBy(*group, "page").agg(*(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    regions = F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page_number"), box.alias("bbox"))))
    found = on_page.groupBy(*group).agg(regions.alias("section_regions"))
    return found.select(*group, F.transform("section_regions", lambda r: r["page_number"]).alias("source_pages"), "section_regions")


def section_entries(sections: DataFrame, lines: DataFrame, group: Sequence[str]) -> DataFrame:
    """Entries of sections (``group`` with ``citation_id, act, section_number, json_pointer``); a section without lines has no pages."""
    placed = pages_and_regions(lines, group)
    both = sections.join(placed, list(group), "left")
    none = F.array().cast("array<int>"), F.array().cast(f"array<{REGION}>")
    return both.select(
        "citation_id", "act", F.lit("section").alias("kind"), "json_pointer", F.col("section_number").cast("string").alias("section_number"),
        F.coalesce("source_pages", none[0]).alias("source_pages"), F.coalesce("section_regions", none[1]).alias("section_regions"),
    )


def row_entries(rows: DataFrame, kind: str, mark: Column, pointer: Column, page: Column, *, parent: Column | None = None, subsection: Column | None = None) -> DataFrame:
    """Entries of table rows (``act, prefix, row_ordinal``): id ``prefix-mark-R001``, with the page and the section that holds the table."""
    cid = F.concat(F.col("prefix"), F.lit("-"), mark, F.lit("-R"), F.lpad(F.col("row_ordinal").cast("string"), 3, "0"))
    # lpad cuts longer numbers
    cid = F.when(F.col("row_ordinal") > 999, F.concat(F.col("prefix"), F.lit("-"), mark, F.lit("-R"), F.col("row_ordinal").cast("string"))).otherwise(cid)
    extra = {"parent_citation_id": parent, "subsection_id": subsection}
    return rows.select(
        cid.alias("citation_id"), "act", F.lit(kind).alias("kind"), pointer.alias("json_pointer"), F.array(page.cast("int")).alias("source_pages"),
        F.col("row_ordinal").cast("int").alias("row_ordinal"), *(c.cast("string").alias(n) for n, c in extra.items() if c is not None),
    )


def form_entries(forms: DataFrame, last_page: int, group: str = "act") -> DataFrame:
    """Entries of forms (``act, prefix, nth`` from 0, ``form_number, page``): each has the pages from its own to the one before the next form begins.

    A form that shares its page with the next has that page alone.
    """
    turned = forms.withColumn("_back", -F.col("nth"))
    order = ["_back"]
    seen = running(ordered_parts(turned, [group], order), [group], order, {"_next": ("previous", F.struct("page"))})
    last = F.coalesce(F.col("_next.page") - 1, F.lit(last_page))
    return seen.select(
        F.concat_ws("-", "prefix", F.concat(F.lit("SCH2-FORM"), F.col("form_number").cast("string"))).alias("citation_id"), group, F.lit("form").alias("kind"),
        F.concat(F.lit("/forms/"), F.col("nth").cast("string")).alias("json_pointer"), F.sequence(F.col("page").cast("int"), F.greatest(last, F.col("page")).cast("int")).alias("source_pages"),
    )


def note_entries(notes: DataFrame) -> DataFrame:
    """Entries of texts that stand outside sections (``act, prefix, label, json_pointer, page, text``), with the place of their whole text."""
    return notes.select(
        F.concat_ws("-", "prefix", "label").alias("citation_id"), "act", F.lit("schedule_notes").alias("kind"), "json_pointer", F.array(F.col("page").cast("int")).alias("source_pages"),
        F.lit(0).alias("char_start"), F.length("text").alias("char_end"),
    )


def citation_map(parts: Sequence[DataFrame], sources: DataFrame) -> DataFrame:
    """All entries with ``document_name`` and ``source_sha256`` of their act (``sources``: one row each); what a kind hasn't is null.

    An id or a pointer that occurs twice, and an act without a source, are errors.
    """
    filled = [p.select("citation_id", "act", "kind", "json_pointer", *((F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items())) for p in parts]
    entries = filled[0]
    for more in filled[1:]:
        entries = entries.unionByName(more)
    require_empty(duplicates(entries, ["citation_id"]), "citation ids that are not unique")
    require_empty(duplicates(entries, ["act", "json_pointer"]), "pointers that are not unique")
    require_empty(entries.select("act").distinct().join(sources.select("act"), "act", "left_anti"), "acts without a source")
    return entries.join(F.broadcast(sources.select("act", "document_name", "source_sha256")), "act")


def counts_differ(entries: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """``kind, n, expected`` of kinds whose entries are not as many as expected; kinds that aren't expected count as 0."""
    wanted = entries.sparkSession.createDataFrame(list(expected.items()), "kind string, expected long")
    counted = entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    both = counted.join(wanted, "kind", "full").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("n <> expected")
