"""Chunks of provision trees: a provision that fits stays whole, another is replaced by its children.

A section is a list of segments in order, each a part of one node's own text; ``above`` names the nodes from the
section down to that node.  Whether a node fits depends on its own text and on what its ancestors say before their
first child, and not on how others are cut, so all nodes are judged side by side.  A node is a chunk if it fits and
none above it does; segments of nodes that don't fit are cut at paragraphs and sentences.  Chunks carry the
introductions of all nodes above them, with their places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators.chunking import MAX_TOKENS, SPECIAL_TOKENS, TARGET_TOKENS, Tokenizer, split_passage, token_limited, whitespace_tokens
from passagework.operators.ordered import dealt, running
from passagework.sources.scratch import save_scratch

SPAN = "struct<node_id:string,char_start:bigint,char_end:bigint,text:string>"


def tree_paths(edges: DataFrame, group: Sequence[str], *, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Group columns, ``node_id`` and ``above``: the nodes from a root (whose parent is null) down to each node.

    One join per level, each written.  A node that isn't below a root (its parent is missing, or it lies on a cycle)
    or has two places is an error.
    """
    edges = edges.select(*group, F.col(node).cast("string").alias("node_id"), F.col(parent).cast("string").alias("_parent"))
    level = save_scratch(edges.where("_parent IS NULL").select(*group, "node_id", F.array("node_id").alias("above")), "paths")
    below = edges.where("_parent IS NOT NULL")
    levels = [level]
    while not level.isEmpty():
        found = below.join(level.withColumnsRenamed({"node_id": "_parent"}), [*group, "_parent"])
        step = found.withColumn("above", F.concat("above", F.array("node_id"))).select(*group, "node_id", "above")
        level = save_scratch(step, "paths")
        levels.append(level)
    out = levels[0]
    for step in levels[1:-1]:
        out = out.unionByName(step)
    reached = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*group, "node_id").alias("d")).first()
    if reached["n"] != reached["d"] or reached["n"] != edges.count():
        raise ValueError("the edges are no forest: a parent is missing, a node has two places, or there is a cycle")
    return out


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def _counted(tokenizer: Tokenizer) -> Column:
    @F.arrow_udf(T.IntegerType())
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([len(tokenizer(t)) + SPECIAL_TOKENS for t in batch.to_pylist()], pa.int32())

    return count


def _joined(parts: Column, field: str = "text", sep: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p[field]), sep)


def _prefix(heading: Column, context: Column) -> Column:
    """A heading and the introductions above, a line each."""
    return F.concat(heading, F.lit("\n"), F.array_join(F.transform(context, lambda c: F.concat(c["text"], F.lit("\n"))), ""))


def _segments(segments: DataFrame, group: list[str]) -> DataFrame:
    """Segments with their places in the section, and the place where the stretch of segments of one node begins."""
    rows = segments.where(F.length("text") > 0).select(*group, "ord", "above", "text", F.element_at("above", -1).alias("node_id"), F.length("text").cast("long").alias("_size"))
    placed = running(dealt(rows, group, ["ord"]), group, ["ord"], {"char_end": ("sum", F.col("_size")), "_before": ("previous", F.struct("node_id"))})
    placed = save_scratch(placed.withColumn("char_start", F.col("char_end") - F.col("_size")), "segments")
    begins = F.when(F.col("_before").isNull() | (F.col("_before.node_id") != F.col("node_id")), F.col("char_start"))
    return running(placed, group, ["ord"], {"stretch": ("last", begins)}).select(*group, "ord", "above", "node_id", "text", "char_start", "char_end", "stretch", _words(F.col("text")).alias("n_words"))


def _nodes(segments: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Each node with its path, whether it has children, its context, and the depth from which on it and those above are small.

    No tokenizer has fewer tokens than words, so only nodes of up to ``limit`` words can fit and have their texts put together.
    """
    at_each = segments.select(*group, F.posexplode("above").alias("depth", "at_node"), "node_id", "ord", "n_words", "above")
    shape = at_each.groupBy(*group, F.col("at_node").alias("node_id")).agg(
        F.sum("n_words").alias("words"), F.min(F.when(F.col("node_id") != F.col("at_node"), F.col("ord"))).alias("first_child"),
        F.min(F.slice("above", 1, F.col("depth") + 1)).alias("path"),
    )
    shape = save_scratch(shape, "nodes")
    own = segments.join(shape.where("first_child IS NOT NULL").select(*group, "node_id", "first_child"), [*group, "node_id"]).where("ord < first_child")
    intro = own.groupBy(*group, "node_id").agg(_joined(F.collect_list(F.struct("ord", "text"))).alias("said"), F.min("char_start").alias("start"))
    bare = F.regexp_replace("said", r"^\s+|\s+$", "")
    start = F.col("start") + F.length("said") - F.length(F.regexp_replace("said", r"^\s+", ""))
    span = F.when(bare != "", F.struct("node_id", start.alias("char_start"), (start + F.length(bare)).alias("char_end"), bare.alias("text")).cast(SPAN))
    facts = shape.select(*group, "node_id", "words").join(intro.select(*group, "node_id", span.alias("span")), [*group, "node_id"], "left").withColumnRenamed("node_id", "over")
    ways = shape.select(*group, "node_id", F.size("path").alias("n"), F.posexplode("path").alias("at", "over"))
    seen = ways.join(facts, [*group, "over"]).groupBy(*group, "node_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when((F.col("at") < F.col("n") - 1) & F.col("span").isNotNull(), F.struct("at", "span")))), lambda x: x["span"]).alias("context"),
        F.min(F.when(F.col("words") <= limit, F.col("at"))).alias("small_from"),
    )
    return shape.join(seen, [*group, "node_id"])


def tree_chunks(segments: DataFrame, nodes: DataFrame, group: Sequence[str], *, tokenizer: Tokenizer = whitespace_tokens, limit: int = TARGET_TOKENS) -> DataFrame:
    """Chunks of sections, which tile them.

    ``segments``: group columns, ``ord`` (unique in a section), ``above`` (array of node ids, from the section to the
    node), ``text`` with the white space up to the next segment, so that a section's text is its segments' in order.
    ``nodes``: group columns, ``node_id``, ``heading``, ``kind``; a node without a row has an empty heading and the kind ``node``.

    Result: group columns, ``node_id, kind, context_refs, context_spans, heading, parent_context, text, embedding_text,
    token_count, char_start, char_end, fragment_index, fragment_count``.  ``kind`` is the node's, or ``residual`` for what
    a node that was replaced by its children says itself.  A prefix that leaves no room for text is an error.
    Group columns are never null; empty segments are left out.
    """
    group = list(group)
    keys = [*group, "node_id"]
    seg = save_scratch(_segments(segments, group), "segments")
    found = _nodes(seg, group, limit)
    named = nodes.select(*keys, F.col("heading").alias("_heading"), F.col("kind").alias("_kind"))
    known = found.join(named, keys, "left").select(
        *keys, "path", "small_from", F.col("first_child").isNotNull().alias("is_parent"), "context", F.coalesce("_heading", F.lit("")).alias("heading"), F.coalesce("_kind", F.lit("node")).alias("kind")
    )
    known = save_scratch(known, "tree")
    # texts of small nodes
    small = seg.join(known.where("small_from IS NOT NULL").select(*keys, "small_from"), keys)
    parts = small.select(*group, F.explode(F.slice("above", F.col("small_from") + 1, F.size("above"))).alias("node_id"), "ord", "text", "char_start", "char_end")
    texts = parts.groupBy(*keys).agg(_joined(F.collect_list(F.struct("ord", "text"))).alias("text"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    full = texts.join(known, keys).withColumn("prefix", _prefix(F.col("heading"), F.col("context")))
    judged = save_scratch(full.withColumn("token_count", _counted(tokenizer)(F.concat("prefix", "text"))), "judged")
    fits = judged.where(F.col("token_count") <= limit).select(*group, F.col("node_id").alias("over"))
    # the highest fitting node above each node
    ways = known.select(*keys, F.posexplode("path").alias("at", "over")).join(fits, [*group, "over"]).groupBy(*keys).agg(F.min("at").alias("chosen"))
    whole = judged.where(F.col("token_count") <= limit).join(ways, keys).where(F.col("chosen") == F.size("path") - 1)
    common = [*keys, "kind", F.col("path").alias("context_refs"), F.col("context").alias("context_spans"), "heading", F.array_join(F.transform("context", lambda c: c["text"]), "\n").alias("parent_context")]
    out = whole.select(*common, "text", F.concat("prefix", "text").alias("embedding_text"), "token_count", "char_start", "char_end", F.lit(1).alias("fragment_index"), F.lit(1).alias("fragment_count"))
    # what no fitting node holds
    rest = seg.join(ways.select(*keys), keys, "left_anti").groupBy(*keys, "stretch").agg(_joined(F.collect_list(F.struct("ord", "text"))).alias("body"))
    loose = rest.join(known, keys).withColumns({"kind": F.when(F.col("is_parent"), "residual").otherwise(F.col("kind")), "prefix": _prefix(F.col("heading"), F.col("context"))})

    @F.pandas_udf("array<struct<a:int,b:int,n:int>>")
    def cut(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, prefixes in frames:
            made = []
            for body, prefix in zip(bodies, prefixes, strict=True):
                made.append([{"a": a, "b": b, "n": len(tokenizer(prefix + body[a:b])) + SPECIAL_TOKENS} for a, b in split_passage(body, prefix, tokenizer, limit=limit)])
            yield pd.Series(made, bodies.index)

    spans = loose.withColumn("spans", cut("body", "prefix")).select("*", F.size("spans").alias("fragment_count"), F.posexplode("spans").alias("nth", "span"))
    text = F.substr("body", F.col("span.a") + 1, F.col("span.b") - F.col("span.a"))
    cut_up = spans.select(
        *common, text.alias("text"), F.concat("prefix", text).alias("embedding_text"), F.col("span.n").alias("token_count"), (F.col("stretch") + F.col("span.a")).alias("char_start"),
        (F.col("stretch") + F.col("span.b")).alias("char_end"), (F.col("nth") + 1).alias("fragment_index"), "fragment_count",
    )
    return out.unionByName(cut_up)


def row_display(columns: Column, cells: Column) -> Column:
    """A table row as lines ``label: cell``; other numbers of labels and cells are an error, and a null cell is empty."""
    lines = F.zip_with(columns, cells, lambda c, v: F.concat(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(": "), F.coalesce(v, F.lit(""))))
    return F.when(F.size(columns) != F.size(cells), F.raise_error(F.lit("the numbers of columns and cells differ"))).otherwise(F.array_join(lines, "\n"))


def row_chunks(rows: DataFrame, keep: Sequence[str], *, tokenizer: Tokenizer = whitespace_tokens, limit: int = MAX_TOKENS, context: Column | None = None) -> DataFrame:
    """Each table row as one chunk: the columns ``keep``, ``parent_context, text, embedding_text, token_count``.

    ``rows`` has ``heading``, ``columns`` (labels), ``cells`` (texts) and ``row_ordinal``; ``context`` gives the texts that stand above the table.
    Rows are never cut: one of more than ``limit`` tokens with its prefix is an error.
    """
    above = F.array_join(context if context is not None else F.array().cast("array<string>"), "\n")
    shown = rows.select(*keep, "row_ordinal", above.alias("parent_context"), row_display(F.col("columns"), F.col("cells")).alias("text"), F.concat("heading", F.lit(" | Row "), "row_ordinal", F.lit("\n")).alias("_head"))
    prefix = F.concat("_head", F.when(F.col("parent_context") != "", F.concat("parent_context", F.lit("\n"))).otherwise(""))
    whole = shown.withColumn("embedding_text", F.concat(prefix, "text")).drop("_head")
    return whole.withColumn("token_count", token_limited(F.col("embedding_text"), tokenizer, limit))


def section_path(act: Column, number: Column, chapter: Column, above: Column, kinds: Column) -> Column:
    """Map from ``act``, ``section_number``, ``chapter`` and the kinds of the nodes above to their values; what is null is left out.

    ``above`` are node ids ``/a/b`` from the section down, ``kinds`` their kinds; the value is an id's last part.
    """
    pairs = F.zip_with(kinds, above, lambda k, a: F.struct(F.concat(k, F.lit("_id")).alias("k"), F.element_at(F.split(a, "/"), -1).alias("v")))
    below = F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0)))
    fixed = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (("act", act), ("section_number", number), ("chapter", chapter))))
    return F.map_from_entries(F.filter(F.concat(fixed, below), lambda e: e["v"].isNotNull()))
