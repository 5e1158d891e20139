"""From glyphs to words: rows of characters with their places on a page.

Glyphs are many and small, so they are never written or dealt as rows: what a batch holds of a page travels packed,
in about as many bytes as its text, and a page is put together where all its parts arrive.  Pages of very many
glyphs, and those with missing or undefined places, are spread over tasks row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators.nearest import baselines
from passagework.operators.scans import Anchors
from passagework.operators.structure import runs
from passagework.sources.scratch import save_scratch

#: Two glyphs of one line that are further apart than this share of the first one's width are in different words.
GAP = 0.3
#: Glyphs of a page up to which one task puts it together, and of about how many pages at once.
PAGE_GLYPHS, GLYPHS_AT_ONCE = 1_000_000, 100_000
#: What a packed glyph has as numbers, and bytes of the head of a packed part.
NUMBERS, HEAD = ("seq", "y", "x", "width"), 12


def packed_glyphs(numbers: np.ndarray, space: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> bytes:
    """One part of a page: rows of ``NUMBERS`` as 64-bit words, whether glyphs are white space, and the bytes of their text.

    Of the words the steps are kept, byte plane by byte plane: along a line they hardly change, so they compress well.
    """
    steps = np.diff(numbers, axis=1, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(len(numbers), -1, 8).transpose(0, 2, 1)
    sizes = lengths.astype("<u4").view(np.uint8).reshape(-1, 4).T
    raw = b"".join([planes.tobytes(), sizes.tobytes(), np.packbits(space).tobytes(), text.tobytes()])
    return np.array([len(space), len(raw), len(text)], "<u4").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_glyphs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``packed_glyphs`` took."""
    n, size, chars = (int(v) for v in np.frombuffer(data, "<u4", 3))
    raw = np.frombuffer(pa.decompress(data[HEAD:], decompressed_size=size, codec="zstd"), np.uint8)
    k = len(NUMBERS)
    steps = np.ascontiguousarray(raw[: 8 * k * n].reshape(k, 8, n).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    lengths = np.ascontiguousarray(raw[8 * k * n : (8 * k + 4) * n].reshape(4, n).T).view("<u4")[:, 0]
    space = np.unpackbits(raw[(8 * k + 4) * n : size - chars], count=n).astype(bool)
    return np.cumsum(steps, axis=1, dtype=np.uint64), space, lengths.astype(np.int64), raw[size - chars :]


def _packed(batch: pa.RecordBatch, page: Sequence[str]) -> pa.RecordBatch:
    """The rows of a batch as one for each page in it."""
    n = batch.num_rows
    if not n:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in page), pa.array([], pa.binary())], [*page, "glyphs"])
    of_page = np.zeros(n, np.int64)
    for c in page:  # codes of the pages in this batch
        coded = batch.column(c).dictionary_encode(null_encoding="encode")
        of_page = np.unique(of_page * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1].astype(np.int64)
    order = np.argsort(of_page, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(of_page[order]) != 0])
    numbers = np.stack([batch.column(c).to_numpy()[order].view(np.uint64) for c in NUMBERS])
    space = batch.column("space").to_numpy(zero_copy_only=False)[order]
    chars = batch.column("c").cast(pa.string()).take(pa.array(order))
    offsets, text = _strings(chars)
    parts = [packed_glyphs(numbers[:, i:j], space[i:j], np.diff(offsets[i : j + 1]), text[offsets[i] : offsets[j]]) for i, j in zip(begins, [*begins[1:], n], strict=True)]
    firsts = pa.array(order[begins])
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(firsts) for c in page), pa.array(parts, pa.binary())], [*page, "glyphs"])


def _strings(values: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of strings that are never null."""
    _, offsets, text = values.buffers()
    at = np.frombuffer(offsets, np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    return at, np.frombuffer(text, np.uint8) if text is not None and text.size else np.zeros(0, np.uint8)


def _words(of_page: np.ndarray, parts: list[tuple], tolerance: float, gap: float) -> tuple[np.ndarray, list[pa.Array]]:
    """Page and ``y, word_no, x, right, text`` of the words of whole pages; ``of_page`` is each part's page, ascending."""
    numbers, space, lengths = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
    chars = pa.StringArray.from_buffers(len(space), pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.py_buffer(np.concatenate([p[3] for p in parts])))
    on = np.repeat(of_page, [len(p[1]) for p in parts])
    seq, (y, x, width) = numbers[0].view(np.int64), (v.view(np.float64) for v in numbers[1:])
    order = np.lexsort((seq, y, on))
    pages = np.r_[np.flatnonzero(np.r_[True, np.diff(on) != 0]), len(on)]  # parts come by page, so these bounds hold in every order
    rule = Anchors(tolerance, T.DoubleType())
    line = np.concatenate([rule.decide(y[order[i:j]], None)[0] for i, j in zip(pages, pages[1:], strict=False)]) + 0.0
    begins = np.r_[True, (line[1:] != line[:-1]) | (on[1:] != on[:-1])]
    of_line = np.cumsum(begins)
    order = order[np.lexsort((seq[order], x[order], of_line))]  # lines stay where they are
    x, space, right = x[order], space[order], x[order] + width[order]
    ends = x + width[order] * (1 + gap)
    begins[1:] |= (space[:-1] | (x[1:] > ends[:-1])) & ~space[1:]
    run, kept = np.cumsum(begins), np.flatnonzero(~space)
    if not len(kept):
        return np.zeros(0, np.int64), [pa.array([], t) for t in (pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.string())]
    word = np.flatnonzero(np.r_[True, np.diff(run[kept]) != 0])
    at = kept[word]
    nth = np.arange(len(word))
    first = np.maximum.accumulate(np.where(np.r_[True, np.diff(of_line[at]) != 0], nth, 0))
    offsets, text = _strings(chars.take(pa.array(order[kept])))
    texts = pa.StringArray.from_buffers(len(word), pa.py_buffer(offsets[np.r_[word, len(kept)]].astype(np.int32)), pa.py_buffer(text))
    return on[at], [pa.array(line[at]), pa.array(nth - first + 1), pa.array(np.minimum.reduceat(x[kept], word)), pa.array(np.maximum.reduceat(right[kept], word)), texts]


def _whole_pages(glyphs: DataFrame, page: Sequence[str], tolerance: float, gap: float) -> DataFrame:
    """Words of pages that one task can hold, whose glyphs (page columns, ``seq, y, x, width, c, space``) are never null."""
    kinds = [glyphs.schema[c] for c in page]
    schema = T.StructType([*kinds, *(T.StructField(c, t) for c, t in (("y", T.DoubleType()), ("word_no", T.LongType()), ("x", T.DoubleType()), ("right", T.DoubleType()), ("text", T.StringType())))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_packed(batch, page) for batch in batches)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, types, of_page, parts, n = [], None, [], [], 0

        def whole() -> pa.RecordBatch:
            on, columns = _words(np.array(of_page), parts, tolerance, gap)
            return pa.RecordBatch.from_arrays([*(pa.array(list(v), t).take(pa.array(on)) for v, t in zip(zip(*keys, strict=True), types, strict=True)), *columns], schema.names)

        for batch in batches:
            types = [batch.schema.field(c).type for c in page]
            for *key, data in zip(*(batch.column(c).to_pylist() for c in page), batch.column("glyphs").to_pylist(), strict=True):
                if not keys or key != keys[-1]:
                    if n >= GLYPHS_AT_ONCE:
                        yield whole()
                        keys, of_page, parts, n = [], [], [], 0
                    keys.append(key)
                of_page.append(len(keys) - 1)
                parts.append(unpacked_glyphs(data))
                n += len(parts[-1][1])
        if parts:
            yield whole()

    packed = glyphs.mapInArrow(pack, T.StructType([*kinds, T.StructField("glyphs", T.BinaryType())]))
    return packed.repartition(*page).sortWithinPartitions(*page).mapInArrow(words, schema)


def _same_page(left: str, right: str, page: Sequence[str]) -> Column:
    return reduce(and_, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in page))


def _spread_pages(glyphs: DataFrame, page: Sequence[str], tolerance: float, gap: float) -> DataFrame:
    """Words of pages of any size, whose glyphs are dealt by range row by row."""
    lines = baselines(glyphs, page, "y", ["seq"], tolerance, name="_line")
    order = ["x", "seq"]
    group = [*page, "_line"]
    cut = runs(
        lines.withColumn("_ends", F.col("x") + F.col("width") * (1 + gap)), group, order,
        (F.col("_before.space") | (F.col("x") > F.col("_before._ends"))) & ~F.col("space"), "_word", before=["space", "_ends"],
    )
    seen = cut.where("NOT space")
    parts = F.array_sort(F.collect_list(F.struct(*order, "c")))
    words = seen.groupBy(*group, "_word").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("text"))
    # a line's first word begins the first run only if no white space is before it
    first = words.groupBy(*group).agg(F.min("_word").alias("_first"))
    both = words.alias("w").join(first.alias("f"), _same_page("w", "f", group))
    return both.select(*(F.col(f"w.{c}") for c in page), F.col("w._line").alias("y"), (F.col("_word") - F.col("_first") + 1).alias("word_no"), "x", "right", "text")


def glyph_words(glyphs: DataFrame, page: Sequence[str], *, tolerance: float = 2.0, gap: float = GAP) -> DataFrame:
    """Page columns, ``y``, ``word_no``, ``x``, ``right``, ``text`` of the words of ``c, x, width, y`` glyphs with a unique ``seq`` on their page.

    Glyphs are put on lines by their heights (see ``baselines``), so a line is named by the ``y`` of its highest glyph.  Along a
    line a word ends at white space, and where the next glyph begins more than ``gap`` times the width of the glyph
    before behind its end.  A word's ``x`` is its first glyph's.  White space makes no words but ends them; words are
    numbered from 1 in their line.  Pages of up to ``PAGE_GLYPHS`` glyphs are put together whole, many at once; lines and
    pages of more are spread over tasks.  The glyphs are read twice, so they must come out alike each time.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    placed = glyphs.select(*page, "seq", number("y"), number("x"), number("width"), "c", F.col("c").rlike(r"^\s*$").alias("space"))
    whole_types = (T.IntegralType, T.StringType, T.BooleanType, T.DateType)
    if not page or not isinstance(placed.schema["seq"].dataType, T.IntegralType) or not all(isinstance(placed.schema[c].dataType, whole_types) for c in page):
        return _spread_pages(placed, page, tolerance, gap)
    odd = reduce(or_, (F.col(c).isNull() for c in ("seq", "y", "x", "width", "c"))) | F.isnan("y") | F.isnan("x") | F.isnan("width")
    apart = save_scratch(placed.groupBy(*page).agg(F.count(F.lit(1)).alias("n"), F.bool_or(odd).alias("odd")).where((F.col("n") > PAGE_GLYPHS) | F.col("odd")).select(*page), "pages-apart")
    if apart.isEmpty():
        return _whole_pages(placed.withColumn("seq", F.col("seq").cast("long")), page, tolerance, gap)
    same = _same_page("g", "a", page)
    whole = placed.alias("g").join(apart.alias("a"), same, "left_anti").withColumn("seq", F.col("seq").cast("long"))
    return _whole_pages(whole, page, tolerance, gap).unionByName(_spread_pages(placed.alias("g").join(apart.alias("a"), same, "left_semi"), page, tolerance, gap))
