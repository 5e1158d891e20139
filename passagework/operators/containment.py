"""Fragments found in the texts that hold them, whatever the white space of either."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s+")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class CompactText:
    """A text without white space, with the way back to its own places."""

    def __init__(self, text: str) -> None:
        self.compact, starts, ends, kept = _SPACE.sub("", text), [], [], 0
        at = 0
        for space in _SPACE.finditer(text):  # one entry for each stretch without white space
            if space.start() > at:
                starts.append(at)
                ends.append(kept)
                kept += space.start() - at
            at = space.end()
        starts.append(at)
        ends.append(kept)
        self._starts, self._kept = np.array(starts), np.array(ends)

    def place(self, at: int) -> int:
        """The text's place of the compact text's character ``at``."""
        i = int(np.searchsorted(self._kept, at, "right")) - 1
        return int(self._starts[i] + at - self._kept[i])

    def spans(self, fragments: Sequence[str | None]) -> list[tuple[int, int] | None]:
        """Places of the fragments, each looked for behind the one found before; none for those that aren't there or are blank."""
        out: list[tuple[int, int] | None] = []
        cursor = 0
        for fragment in fragments:
            wanted = _SPACE.sub("", fragment or "")
            at = self.compact.find(wanted, cursor) if wanted else -1
            if at < 0:
                out.append(None)
                continue
            cursor = at + len(wanted)
            out.append((self.place(at), self.place(cursor - 1) + 1))
        return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _located(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, lists in batches:
        out = []
        for text, fragments in zip(texts, lists, strict=True):
            found = CompactText(text.as_py() or "").spans(fragments.as_py() or ())
            out.append([None if s is None else {"start": s[0], "end": s[1]} for s in found])
        yield pa.array(out, _SPANS)


def located(parents: DataFrame, fragments: DataFrame, on: Sequence[str], order: str, *, text: str = "text", fragment: str = "fragment", missing: str = "null") -> DataFrame:
    """``fragments`` (``on``, ``order``, ``fragment``) with ``char_start, char_end`` in the text of their parent (``on``, ``text``).

    White space doesn't count, and a fragment is looked for behind the one before it in ``order``, so siblings with
    equal texts are told apart.  One that isn't found, is blank, or has no parent has nulls, or is an error if
    ``missing`` is ``error``.  A parent's fragments are one list; those that are found lie one behind another in its
    text, so the list is longer than the text only by fragments that aren't there.  Keys are never null, and a parent has one row.
    """
    keys = list(on)
    rows = fragments.select(*keys, F.col(order).alias("_order"), F.col(fragment).alias("_fragment"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_order", "_fragment"))).alias("_rows"))
    both = lists.join(parents.select(*keys, F.col(text).alias("_text")), keys, "left")
    found = both.select(*keys, "_rows", _located("_text", F.transform("_rows", lambda r: r["_fragment"])).alias("_spans"))
    each = found.select(*keys, F.explode(F.arrays_zip("_rows", "_spans")).alias("e"))
    start, end = F.col("e._spans.start"), F.col("e._spans.end")
    if missing == "error":
        start = F.when(start.isNull(), F.raise_error(F.concat(F.lit("a fragment is not in its text: "), F.substring(F.coalesce("e._rows._fragment", F.lit("null")), 1, 80))).cast("long")).otherwise(start)
    return each.select(*keys, F.col("e._rows._order").alias(order), F.col("e._rows._fragment").alias(fragment), start.alias("char_start"), end.alias("char_end"))
