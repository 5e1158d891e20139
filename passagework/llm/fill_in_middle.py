"""Fill-in-middle transformation by a piece table.

A document's text and the sentinels are buffers that never change.  A document is a list of descriptors (buffer,
start, length) over them: cutting splits a descriptor, an arrangement permutes descriptors, and the inverse
permutation restores the text.  Digests stream what descriptors name, part by part; only ``rendered`` makes a text.
Lengths and places count code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT, SENTINEL = 0, 1
#: Where the prefix, middle and suffix (0 to 2) and the sentinels <P>, <S> and <M> (3 to 5) stand in each form.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
SIGNS = {3: PREFIX, 4: SUFFIX, 5: MIDDLE}
#: Code points that are encoded for a digest at once, and rows that are handled at once.
STEP, ROWS_AT_ONCE = 1 << 20, 64


@dataclass(frozen=True)
class PieceTable:
    """``pieces`` are descriptors (buffer, start, length) over ``buffers``; a table never changes, its methods give new ones."""

    buffers: tuple[str, ...]
    pieces: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, text: str, *more: str) -> PieceTable:
        """The whole of ``text``, with further buffers beside it."""
        return cls((text, *more), ((0, 0, len(text)),))

    def cut(self, at: int) -> PieceTable:
        """The first descriptor that reaches place ``at`` is split there; a part may be empty."""
        end, out = 0, list(self.pieces)
        for i, (buffer, start, length) in enumerate(self.pieces):
            if at <= end + length:
                left = at - end
                out[i : i + 1] = [(buffer, start, left), (buffer, start + left, length - left)]
                return PieceTable(self.buffers, tuple(out))
            end += length
        raise ValueError("there is no such place")

    def and_all_of(self, buffer: int, parts: Sequence[str]) -> PieceTable:
        """With descriptors of ``parts``, which stand in a buffer, behind the others."""
        return PieceTable(self.buffers, (*self.pieces, *((buffer, self.buffers[buffer].index(p), len(p)) for p in parts)))

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def only(self, n: int) -> PieceTable:
        """The first ``n`` descriptors."""
        return PieceTable(self.buffers, self.pieces[:n])

    def parts(self, step: int) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            for at in range(start, start + length, step):
                yield self.buffers[buffer][at : min(start + length, at + step)]

    def rendered(self) -> str:
        return "".join(self.buffers[b][start : start + length] for b, start, length in self.pieces)

    def sha256(self) -> str:
        """Lower-case hex digest of the UTF-8 of the described text, which is never put together."""
        digest = hashlib.sha256()
        for part in self.parts(STEP):
            digest.update(part.encode())
        return digest.hexdigest()


def inverse(order: Sequence[int]) -> list[int]:
    return sorted(range(len(order)), key=order.__getitem__)


def draws(seed: str, doc_id: object) -> list[int]:
    """Four numbers of eight hex digits of the sha256 of ``seed:doc_id``; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def transformed(doc_id: object, text: str, seed: str, plain_from: int, spm_below: int) -> tuple[str, int, int, PieceTable]:
    """Form, the two cuts, and the table of the result."""
    whole, n = PieceTable.of(text, SENTINELS), len(text)
    one, two, third, fourth = draws(seed, doc_id)
    low, high = sorted((one % (n + 1), two % (n + 1)))
    if not text or third % 100 >= plain_from or any(s in text for s in SIGNS.values()):
        return "plain", 0, 0, whole
    form = "spm" if fourth % 100 < spm_below else "psm"
    return form, low, high, whole.cut(low).cut(high).and_all_of(SENTINEL, list(SIGNS.values())).arranged(ORDERS[form])


def restored(output: str, form: str) -> PieceTable:
    """The text that ``output`` was made from, as descriptors over ``output``.

    A text that holds a sentinel is plain, and no sentinel's beginning is another's end, so each is found where it was put.
    """
    table = PieceTable.of(output)
    if form == "plain":
        return table
    places = []
    for sign in (SIGNS[i] for i in ORDERS[form] if i in SIGNS):
        at = output.index(sign)
        places += [at, at + len(sign)]
    for at in places[1:]:
        table = table.cut(at)
    return table.arranged(inverse(ORDERS[form])).only(3)


_PIECE = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])


def fill_in_middle(docs: DataFrame, *, seed: str = "1", plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256`` of each row of ``docs``.

    ``form`` is plain, psm or spm; ``pieces`` describe ``output`` by the text (buffer 0) and the sentinels (1).  A document is
    left plain if it is empty, holds a sentinel or draws ``plain_from`` or more of 100.  Cuts and forms depend on the id and
    the number of code points only, so repeated rows have equal results and rows of one id with different texts are
    cut apart.  A null text is empty; a null id draws as an empty one; texts of any length are cut whole; extra
    columns are left out, whatever their names; an empty table has no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                made = [transformed(i, t, seed, plain_from, spm_below) for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)]
                columns = [
                    batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([m[0] for m in made]), pa.array([None if m[0] == "plain" else m[1] for m in made], pa.int64()),
                    pa.array([None if m[0] == "plain" else m[2] - m[1] for m in made], pa.int64()), pa.array([[dict(zip(("buffer", "start", "length"), p, strict=True)) for p in m[3].pieces] for m in made], pa.list_(_PIECE)),
                    pa.array([m[3].rendered() for m in made], pa.string()), pa.array([m[3].sha256() for m in made], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output string, output_sha256 string")


@F.arrow_udf(T.StringType())
def restored_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text that an output of a form was made from; null for nulls."""
    for outputs, forms in batches:
        yield pa.array([None if o is None or f is None else restored(o, f).rendered() for o, f in _pairs(outputs, forms)], pa.string())


@F.arrow_udf(T.StringType())
def restored_sha256(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Digest of the text that an output of a form was made from, which is streamed from the output; null for nulls."""
    for outputs, forms in batches:
        yield pa.array([None if o is None or f is None else restored(o, f).sha256() for o, f in _pairs(outputs, forms)], pa.string())


def _pairs(outputs: pa.Array, forms: pa.Array) -> Iterator[tuple[str | None, str | None]]:
    """Row by row, so that a batch's texts aren't all held twice."""
    return ((o.as_py(), f.as_py()) for o, f in zip(outputs, forms, strict=True))

