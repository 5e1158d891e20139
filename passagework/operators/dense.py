"""Exact nearest neighbours by cosine: few queries are sent to the vectors, which stay where they are; many meet them block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.ranking import top_k
from passagework.operators.validation import require

#: Query vectors that are sent at once hold so many numbers at most (64 MB).
SENT_NUMBERS = 8_000_000
#: Scores that are held at once.
SCORES_AT_ONCE = 4_000_000


def _unit_rows(values: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in values])
    length = np.sqrt((rows**2).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


class _Best:
    """The best ``k`` answers so far of the queries of one kind (vector length and filter values)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, decimals: int, exclude_self: bool) -> None:
        self.ids, self.rows, self.k, self.decimals, self.exclude_self = ids, rows, k, decimals, exclude_self
        self.held: pd.DataFrame | None = None

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take further vectors, sorted by id, into account."""
        step, new = max(1, SCORES_AT_ONCE // max(1, len(ids))), []
        for at in range(0, len(self.ids), step):
            asked = self.ids[at : at + step]
            score = np.round(self.rows[at : at + step] @ rows.T, self.decimals) + 0.0
            if self.exclude_self:
                score[asked[:, None] == ids[None]] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
            row = np.repeat(np.arange(len(asked)), order.shape[1])
            new.append(pd.DataFrame({"query_id": asked[row], "vec_id": ids[order.ravel()], "score": score[row, order.ravel()]}))
        every = pd.concat(new if self.held is None else [self.held, *new])
        every = every[np.isfinite(every["score"])].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        self.held = every.groupby("query_id", sort=False).head(self.k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, filters: tuple[str, ...] = (), exclude_self: bool = True, decimals: int = 6) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the best ``k`` vectors for each query.

    ``vectors`` and ``queries`` hold ``vec_id`` or ``query_id``, ``embedding``, and the ``filters`` columns, in
    which a query and its answers must agree.  Vectors that are null or of another length than the query's are
    never returned.  Up to ``SENT_NUMBERS`` numbers of queries are sent to the partitions of the vectors, and a partition
    returns its best ``k`` for each query, so no vector is shuffled or copied.  With more queries both sides are dealt
    in blocks of a bounded size, and each block of queries meets each block of vectors in a task of its own.  Scores
    are rounded before ranking, ties go to the smaller id.
    """
    require(k >= 1, "k must be positive")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    data = vectors.where(usable).select(F.col("vec_id").alias("id"), "embedding", *filters)
    asked = queries.where(usable).select(F.col("query_id").alias("id"), "embedding", *filters)
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["vec_id"]
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, score double"
    if _numbers(asked) <= SENT_NUMBERS:
        found = data.mapInPandas(_best_of(asked.toPandas(), filters, k, decimals, exclude_self), schema)
    else:
        found = _block_by_block(data, asked, filters, k, decimals, exclude_self, schema)
    order: list[Column] = [F.desc("score"), F.asc("vec_id")]
    return top_k(found, ["query_id"], order, k)


def _numbers(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]


def _dealt(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows in blocks of even numbers of rows, whatever their ids."""
    place = F.struct(F.spark_partition_id(), F.monotonically_increasing_id())
    return rows.withColumn("_block", F.pmod(F.xxhash64(place), F.lit(n_blocks)).cast("int"))


def _block_by_block(data: DataFrame, asked: DataFrame, filters: tuple[str, ...], k: int, decimals: int, exclude_self: bool, schema: str) -> DataFrame:
    """Best answers of each block of queries in each block of vectors, one task for each two; nothing goes through the driver.

    Blocks hold half of what is sent at once on average, so uneven ones are bounded too.
    """
    n_asked, n_data = (max(1, -(-2 * _numbers(rows) // SENT_NUMBERS)) for rows in (asked, data))
    copies = lambda rows, mine, n_mine, other, n_other: _dealt(rows, n_mine).withColumnRenamed("_block", mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    left, right = copies(asked, "_q", n_asked, "_v", n_data), copies(data, "_v", n_data, "_q", n_asked)

    def meet(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        best = list(_best_of(queries, filters, k, decimals, exclude_self)(iter([vectors]))) if len(queries) and len(vectors) else []
        return pd.concat(best) if best else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(meet, schema)


def _best_of(asked: pd.DataFrame, filters: tuple[str, ...], k: int, decimals: int, exclude_self: bool):
    """Function over a partition's vectors that yields the best answers there."""

    def by_kind(rows: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        rows = rows.assign(_dim=rows["embedding"].map(len))
        yield from rows.groupby(["_dim", *filters], sort=False)

    grouped = {kind: (rows["id"].to_numpy(), _unit_rows(rows["embedding"])) for kind, rows in by_kind(asked)} if len(asked) else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, _Best] = {}
        for batch in batches:
            for kind, rows in by_kind(batch) if len(batch) and grouped else ():
                if kind in grouped:
                    if kind not in best:
                        best[kind] = _Best(*grouped[kind], k, decimals, exclude_self)
                    rows = rows.sort_values("id")
                    best[kind].add(rows["id"].to_numpy(), _unit_rows(rows["embedding"]))
        yield from (b.held for b in best.values() if b.held is not None)

    return run
