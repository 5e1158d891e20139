"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they would form: the best pair merges, its new neighbours join the
agenda, and stale entries are skipped.  No piece has a space mark after
another character, and none holds a line feed, so a text falls apart into
short chunks that merge independently; each distinct one is merged once per
worker.  Short chunks keep their agendas as rows of one array and merge side
by side.  In every Arrow batch the words met for the first time are checked
against the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.row_merger import RowMerger
from passagework.llm.sampling import chunked

SPACE = "▁"
#: Words that a worker remembers, and the longest that it does.
MEMO_WORDS, MEMO_LENGTH = 300_000, 48
#: Rows of a batch that are encoded and handed on at once.
ROWS_AT_ONCE = 250


class PieceEncoder:
    """Encoder for one model file; made once per worker."""

    def __init__(self, model_file: str) -> None:
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(lib.get_piece_size())
        plain = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in ids if lib.is_byte(i)}
        if len(self.bytes) != 256 or any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids):
            raise ValueError("a merge-type model with byte fallback whose pieces don't cross spaces is needed")
        self.memo: dict[str, bytes] = {}
        #: Words checked so far, and those for which the library had other ids (an error).
        self.checked = self.differing = 0
        self._lead = lib.encode("\n")
        self._single = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self._single[ord(piece)] = i
        # place of each piece in score order; pieces of equal scores, here runs of space marks, are left to merge()
        often = Counter(self.cost[p] for p in self.ids if len(p) > 1)
        tied = {p for p in self.ids if len(p) > 1 and often[self.cost[p]] > 1}
        order = sorted(self.ids.keys() - tied, key=self.cost.__getitem__)
        self._rows = all(p.strip(SPACE) == "" for p in tied) and lib.get_piece_size() < 1 << 20
        self._merger = RowMerger((self.ids[p[:k]], self.ids[p[k:]], self.ids[p], place) for place, p in enumerate(order) for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)

    def chunks(self, text: str) -> list[str]:
        """The text with its leading space mark, cut before each word and around line feeds."""
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk."""
        symbols, n, cost, agenda = list(chunk), len(chunk), self.cost, []
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for i in range(n - 1):
            if (c := cost.get(symbols[i] + symbols[i + 1])) is not None:
                agenda.append((c, i, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, size = heapq.heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (c := cost.get(symbols[left] + symbols[right])) is not None:
                    heapq.heappush(agenda, (c, left, len(symbols[left]) + len(symbols[right])))
            if (first := before[left]) >= 0 and (c := cost.get(symbols[first] + symbols[left])) is not None:
                heapq.heappush(agenda, (c, first, len(symbols[first]) + len(symbols[left])))
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                one = self.ids.get(symbol)
                ids += [one] if one is not None else [self.bytes[b] for b in symbol.encode()]
        return ids

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words met for the first time, as 32-bit numbers, checked against the library.

        A word stands for itself after a space mark, or, if it starts with a line feed, for itself as it is.
        """
        if not new:
            return {}
        spaced = [w for w in new if w[0] != "\n"]
        after = [w for w in new if w[0] == "\n"]
        out = dict(zip(spaced, self._merged([SPACE + w for w in spaced]), strict=True))
        feed = np.array(self._lead[-1:], np.int32).tobytes()
        out.update((w, feed + ids) for w, ids in zip(after, self._merged([w[1:] for w in after]), strict=True))
        # the library puts a space mark before its input, which belongs to the first kind of words only
        for words, lead in ((spaced, 0), (after, 1)):
            want = self.library.encode(words, num_threads=1)
            if lead:
                want = [w[lead:] for w in want]
            flat = np.fromiter(chain.from_iterable(want), np.int32)
            if b"".join([out[w] for w in words]) != flat.tobytes():
                expected = [np.array(w, np.int32).tobytes() for w in want]
                wrong = [w for w, e in zip(words, expected, strict=True) if out[w] != e]
                self.differing += len(wrong)
                raise ValueError(f"the library has other ids for {len(wrong)} words, such as {wrong[:1]!r:.80}")
        self.checked += len(new)
        return out

    def _merged(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk: short ones of known characters side by side, all others one by one."""
        if not chunks:
            return []
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        single = self._single[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        got = self._merger.merge(single, sizes, np.full(len(chunks), self._rows))
        return [np.array(self.merge(c), np.int32).tobytes() if ids is None else ids for c, ids in zip(chunks, got, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        cut = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        plain = [SPACE not in t and "" not in words for t, words in zip(texts, cut, strict=True)]
        known = self.memo
        if len(known) > MEMO_WORDS:
            known.clear()
        new = self.learn(list(set().union(*compress(cut, plain)) - known.keys()))
        known.update(new)
        out = [b"".join([known[w] for w in words]) if ok else self.one_by_one(text) for text, words, ok in zip(texts, cut, plain, strict=True)]
        for word in new:
            if len(word) > MEMO_LENGTH:
                del known[word]
        return out

    def one_by_one(self, text: str) -> bytes:
        """Ids of a text with runs of spaces, checked as a whole."""
        ids = [i for c in self.chunks(text) for i in self.merge(c)]
        want = self.library.encode(text)
        self.checked += 1
        if ids != want:
            self.differing += 1
            raise ValueError(f"the library has other ids for the text {text!r:.80}")
        return np.array(ids, np.int32).tobytes()


_CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_encoders: dict[str, PieceEncoder] = {}


def encoder_for(model_file: str) -> PieceEncoder:
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode_pieces(model_file: str, text: Column) -> Column:
    """Ids of whole texts, without begin and end ids; a null text is taken as empty and has no ids.

    ``model_file`` is opened on the executors, by a path that is valid there.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_for(model_file)
        for batch in batches:
            ids = [b for run in chunked(batch.to_pylist(), 1_000_000) for b in encoder.encode(run)]
            yield _lists(ids)

    return encode(text)


_libraries: dict[str, sentencepiece.SentencePieceProcessor] = {}


def library_for(model_file: str) -> sentencepiece.SentencePieceProcessor:
    if model_file not in _libraries:
        _libraries[model_file] = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return _libraries[model_file]


def decode_pieces(model_file: str, ids: Column) -> Column:
    """Text of a list of ids, by the library; null and empty lists give an empty text."""

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = library_for(model_file)
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 200):
                out += library.decode([x or [] for x in batch.slice(at, 200).to_pylist()])
            yield pa.array(out, pa.string())

    return decode(ids)


def encoded_and_decoded(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of each row, in one pass of small batches: what the two functions above give together.

    A null text is taken as empty; empty texts have no ids and an empty decoded text.  Texts of any length are encoded whole.
    The result depends on the text alone, so repeated rows, equal and null ids included, have one each and are alike.  An
    empty table gives no rows; extra columns are left out, whatever their names.  Ids that differ from the library's are an error.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids = [b for texts in chunked(batch.column("text").to_pylist(), 500_000) for b in encoder.encode(texts)]
                decoded = [encoder.library.decode(np.frombuffer(b, np.int32).tolist()) if b else "" for b in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
