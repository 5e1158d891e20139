"""Best-fit packing of tokenised documents by exact-complement hashing.

Packing is planned on counts of lengths, of which there are at most as many
as a sequence has tokens, however many documents there are.  Hash indexes of
single, pair and triple length sums give combinations that fill the gap left
by a length exactly; each is consumed as often as the counts allow.  What has
no exact complement is packed best-fit, longest first.  The plan says which
sequence and offset the n-th piece of a length gets, and Spark numbers the
pieces of each length in parallel.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from passagework.llm.sampling import chunked, give_back
from passagework.llm.word_tokens import SEGMENT, word_tokens_for
from passagework.sources.scratch import save_scratch

CAPACITY = 4096
#: Token that ends a document.
END_ID = 1
#: Pieces of one length that are numbered together; longer runs are split.
CELL_ROWS, LEAST_CELLS = 20_000, 16
#: Rows of a batch whose texts are held at once.
ROWS_AT_ONCE = 500

Pattern = tuple[tuple[int, ...], int]


class ComplementIndex:
    """Combinations of one, two or three available lengths by their sum.

    Counts only fall, so a sum once without a combination stays without, and a remembered pair is replaced
    only when one of its lengths has run out.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.no_triple: set[int] = set()
        self.possible = np.zeros(len(counts), bool)  # sums for which a pair has not been ruled out
        lengths = np.flatnonzero(counts)
        for a in lengths:
            sums = a + lengths[lengths <= a]
            self.possible[sums[sums < len(counts)]] = True

    def times(self, parts: tuple[int, ...]) -> int:
        """How often the counts allow the combination."""
        return min(int(self.counts[x]) // n for x, n in Counter(parts).items())

    def single(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if self.times((*beside, total)) else None

    def pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        if not self.possible[total]:
            return None
        held = self.pairs.get(total)
        if held and self.times((*beside, *held)):
            return held
        larger = np.arange(total - 1, (total - 1) // 2, -1)
        both = larger[(self.counts[larger] > 0) & (self.counts[total - larger] > 0)]
        for a in both.tolist():
            if self.times((a, total - a)):
                if self.times((*beside, a, total - a)):
                    self.pairs[total] = (a, total - a)
                    return self.pairs[total]
                continue
        if not any(self.times((a, total - a)) for a in both.tolist()):
            self.possible[total] = False
        return None

    def triple(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        if total in self.no_triple:
            return None
        first = np.arange(total - 2, (total - 1) // 3, -1)
        for a in first[(self.counts[first] > 0) & self.possible[total - first]].tolist():
            if self.times((*beside, a)) and (rest := self.pair(total - a, (*beside, a))):
                return (a, *rest)
        if len(beside) == 1:
            self.no_triple.add(total)
        return None


def exact_patterns(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Combinations of up to four lengths that fill a sequence exactly; ``counts`` is reduced by what they use."""
    index, out = ComplementIndex(counts), []
    for length in range(capacity, 0, -1):
        while counts[length]:
            gap, beside = capacity - length, (length,)
            parts = () if not gap else index.single(gap, beside) or index.pair(gap, beside) or index.triple(gap, beside)
            if parts is None:
                break
            pattern = (length, *parts)
            n = index.times(pattern)
            for x in pattern:
                counts[x] -= n
            out.append((pattern, n))
    return out


def best_fit_patterns(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: alike sequences take alike pieces together."""
    open_by_gap: dict[int, list[list]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, bool)
    full: list[Pattern] = []

    def put(pattern: tuple[int, ...], gap: int, n: int) -> None:
        if gap:
            open_by_gap[gap].append([pattern, n])
            gaps[gap] = True
        else:
            full.append((pattern, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(gaps[length:])
            if not len(fitting):
                each = capacity // length
                if left // each:
                    put((length,) * each, capacity - each * length, left // each)
                if left % each:
                    put((length,) * (left % each), capacity - left % each * length, 1)
                left = 0
                continue
            gap = length + int(fitting[0])
            group = open_by_gap[gap][-1]
            n = min(left, group[1])
            group[1] -= n
            left -= n
            if not group[1]:
                open_by_gap[gap].pop()
                gaps[gap] = bool(open_by_gap[gap])
            put((*group[0], length), gap - length, n)
    return full + [(p, n) for groups in open_by_gap.values() for p, n in groups]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of lengths, each with the number of sequences packed that way."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a length is out of range")
    table = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        table[length] = n
    return exact_patterns(table, capacity) + best_fit_patterns(table, capacity)


class Placement:
    """Sequence and offset of the n-th piece of a length."""

    def __init__(self, patterns: list[Pattern]) -> None:
        rows, used, sequence = [], Counter(), 0
        for lengths, n in patterns:
            at = 0
            for length in lengths:
                rows.append((length << 44 | used[length], sequence, at))
                used[length] += n
                at += length
            sequence += n
        rows.sort()
        self.n_sequences = sequence
        self.keys, self.sequences, self.offsets = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], [])))

    def of(self, length: np.ndarray, nth: np.ndarray) -> pd.DataFrame:
        key = length.astype(np.int64) << 44 | nth.astype(np.int64)
        at = np.searchsorted(self.keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": self.sequences[at] + (key - self.keys[at]), "offset": self.offsets[at]})


def token_bytes(tokenizer_file: str, text: Column) -> Column:
    """Ids of whole texts as little-endian 32-bit numbers; a null text is taken as empty."""

    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = word_tokens_for(tokenizer_file)
        for batch in batches:
            parts = []
            for at in range(0, len(batch), ROWS_AT_ONCE):
                texts = batch.slice(at, ROWS_AT_ONCE).to_pylist()
                parts.append(pa.array([b for run in chunked(texts, SEGMENT) for b in words.encode(run)], pa.binary()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
        words.memo.clear()
        give_back()

    return encode(text)


def token_pieces(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of all documents: the ids and ``end_id``, cut at every ``capacity`` ids.

    ``ids`` are little-endian 32-bit numbers.  Only documents of more than ``capacity`` ids have several pieces.
    """
    end = F.unhex(F.lit(end_id.to_bytes(4, "little").hex()))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.concat(token_bytes(tokenizer_file, F.col(text_col)), end).alias("all"))
    n = (F.octet_length("all") / 4).cast("long")
    cut = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(n - start, F.lit(capacity)).alias("length"), F.substring("all", (start * 4 + 1).cast("int"), F.lit(4 * capacity)).alias("ids"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` as the method finds.

    ``pieces`` has ``doc_id, piece, length`` and is scanned three times, so give a written table.
    """
    spark = pieces.sparkSession
    counts = dict(map(tuple, pieces.groupBy("length").agg(F.count(F.lit(1))).collect()))
    placement = Placement(plan_packing(counts, capacity))
    # one row per length: at most as many as the capacity
    cells = F.broadcast(spark.createDataFrame([(n, max(LEAST_CELLS, -(-c // CELL_ROWS))) for n, c in counts.items()], "length long, cells int"))
    spread = pieces.join(cells, "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.col("cells")).cast("int"))
    nth = F.row_number().over(W.partitionBy("length", "cell").orderBy("doc_id", "piece", *(c for c in ("ids_crc32",) if c in pieces.columns)))
    ahead = F.sum("n").over(W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    before = spread.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).select("length", "cell", F.coalesce(ahead, F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        return placement.of(length.to_numpy(), nth.to_numpy())

    numbered = spread.withColumn("nth", nth).join(before, ["length", "cell"])
    placed = numbered.withColumn("at", place("length", F.col("before") + F.col("nth") - 1))
    return placed.select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    Null and empty texts are one piece of the end id alone.  Rows with equal or null ids are packed each.
    Extra columns are ignored; an empty table gives no sequences.
    """
    pieces = token_pieces(docs, tokenizer_file, id_col=id_col, text_col=text_col, capacity=capacity)
    narrow = save_scratch(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pack-pieces")
    return pack_pieces(narrow, capacity)


def packed_sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence in one value, from ``token_pieces`` and their places."""
    held = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    return held.groupBy("sequence_id").agg(joined.alias("ids"))
