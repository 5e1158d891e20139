"""Near-duplicate embeddings by an inverted file with product quantisation.

Coarse centroids cut the unit vectors into inverted lists.  A vector is kept
in its nearest list as one code per subspace of its residual.  A query looks
up squared distances from its own residual to all codewords once, and adds
them up by the codes of a list (asymmetric distances); what may be near enough
is compared exactly, by cosine in double precision.

A vector probes every list that can hold a neighbour: two vectors at distance
``r`` can lie in different cells only if both are within ``r`` of the bisector
of the two centroids.  A candidate's stored reconstruction error widens its
distance bound.  So neither step loses a pair; the quantiser decides the work,
not the result.

Equal vectors are one class from the start.  Lists are compared block against
block, and each block returns, per class, how many vectors it is linked with
and one edge of a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.components import connected_components, spanning_roots
from passagework.sources.scratch import save_scratch

#: Vectors that the quantiser is fitted on at most; every vector is indexed.
FIT_VECTORS = 20_000
#: Vectors per inverted list that the number of lists aims at, and its bounds.
LIST_ROWS, LEAST_LISTS, MOST_LISTS = 4000, 4, 1024
SUBSPACES, CODEWORDS = 8, 32
#: Rows of a list that are compared in one block.
BLOCK = 512
#: Rounding that the bounds allow for.
EPSILON = 1e-6


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids from a fixed start; a centroid without rows takes the row that is farthest from its own."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    rng = np.random.default_rng(7)
    centroids = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        distance = (centroids**2).sum(1) - 2 * rows @ centroids.T
        nearest = distance.argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=len(centroids))
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if not full.all():
            centroids[~full] = rows[np.argsort(-distance.min(1), kind="stable")[: (~full).sum()]]
    return centroids


@dataclass
class ProductQuantiser:
    """Coarse centroids of unit vectors, and codewords of the residuals in each subspace."""

    coarse: np.ndarray
    codewords: list[np.ndarray]

    @classmethod
    def fit(cls, rows: np.ndarray, n_lists: int) -> ProductQuantiser:
        coarse = k_means(rows, n_lists)
        residual = rows - coarse[cls._nearest(rows, coarse)]
        return cls(coarse, [k_means(part, CODEWORDS) for part in np.array_split(residual, min(SUBSPACES, rows.shape[1]), axis=1)])

    @staticmethod
    def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return ((centroids**2).sum(1) - 2 * rows @ centroids.T).argmin(1)

    def _parts(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rows, len(self.codewords), axis=1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and reconstruction error of unit vectors."""
        home = self._nearest(rows, self.coarse)
        parts = self._parts(rows - self.coarse[home])
        codes = np.stack([self._nearest(p, w) for p, w in zip(parts, self.codewords, strict=True)], 1).astype(np.uint8)
        error = sum(((p - w[c]) ** 2).sum(1) for p, w, c in zip(parts, self.codewords, codes.T, strict=True))
        return home, codes, np.sqrt(error)

    def probes(self, rows: np.ndarray, home: np.ndarray, radius: float) -> np.ndarray:
        """Which later lists may hold a vector within ``radius``, as a table of rows and lists."""
        distance = (rows**2).sum(1)[:, None] - 2 * rows @ self.coarse.T + (self.coarse**2).sum(1)
        gap = np.sqrt(np.maximum(0, (self.coarse**2).sum(1)[:, None] - 2 * self.coarse @ self.coarse.T + (self.coarse**2).sum(1)))
        own = distance[np.arange(len(rows)), home]
        near = distance - own[:, None] <= 2 * radius * gap[home] + EPSILON
        return near & (np.arange(len(self.coarse)) > home[:, None])

    def distances(self, rows: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the reconstructions of a list's codes, by table lookups."""
        total = np.zeros((len(rows), len(codes)))
        for part, words, code in zip(self._parts(rows - self.coarse[at]), self.codewords, codes.T, strict=True):
            table = (part**2).sum(1)[:, None] - 2 * part @ words.T + (words**2).sum(1)
            total += table[:, code]
        return np.maximum(total, 0)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, vector, digest`` of rows that can be linked: doubles as bytes, and a digest of label and vector.

    Left out are null labels and ids, and vectors that are null, empty, zero, or hold null or non-finite components.
    """
    label = vectors.schema["label"].dataType.simpleString()
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, rows, digests = [], [], [], []
            labels = batch.column("label").to_pylist()
            for i, value in enumerate(batch.column("embedding")):
                if labels[i] is None or not value.is_valid or value.values.null_count or not len(value.values):
                    continue
                row = np.array(value.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                if not np.isfinite(row).all() or not (scale := np.abs(row).max()):
                    continue
                keep.append(i)
                dims.append(len(row))
                digests.append(hashlib.blake2b(repr(labels[i]).encode() + b"\0" + row.tobytes(), digest_size=16).digest())
                row = row / scale
                rows.append((row / np.sqrt(row @ row)).tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(dims, pa.int32()), pa.array(rows, pa.binary()), pa.array(digests, pa.binary())],
                ["vec_id", "label", "dim", "vector", "digest"],
            )

    usable = vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return usable.mapInArrow(check, f"vec_id {kind}, label {label}, dim int, vector binary, digest binary")


def _matrix(values: list[bytes] | pd.Series) -> np.ndarray:
    data = b"".join(values)
    return np.frombuffer(data, np.float64).reshape(len(values), -1)


def fit_quantisers(classes: DataFrame, fit_vectors: int) -> dict[int, ProductQuantiser]:
    """A quantiser for each vector length among the ``fit_vectors`` classes with the smallest digests."""
    n = classes.count()
    n_lists = int(min(MOST_LISTS, max(LEAST_LISTS, 1 << max(0, n // LIST_ROWS).bit_length())))
    sample: dict[int, list[bytes]] = {}
    for row in classes.orderBy("digest").limit(fit_vectors).select("dim", "vector").collect():
        sample.setdefault(row["dim"], []).append(bytes(row["vector"]))
    return {dim: ProductQuantiser.fit(_matrix(rows), n_lists) for dim, rows in sample.items()}


def _quantiser(quantisers: dict[int, ProductQuantiser], dim: int) -> ProductQuantiser:
    """A vector length that the sample lacks has one list and one codeword, so all its pairs are compared."""
    return quantisers.get(dim) or ProductQuantiser(np.zeros((1, dim)), [np.zeros((1, dim))])


def embedding_duplicates(vectors: DataFrame, *, cosine: float = 0.98, fit_vectors: int = FIT_VECTORS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vec_id, embedding, label``.

    Vectors of one label and one length are linked if their cosine is at least ``cosine``.  ``n_links`` counts
    the other rows that a row is linked with, ``component_id`` is the smallest id reachable by links, and
    ``kept`` marks the row with that id.  A row that can't be linked (see ``unit_vectors``) stands alone; one
    with a null id has no component and is kept.  Rows that repeat an id count as rows of their own among the links.  Pairs at
    exactly ``cosine`` are linked.  Extra columns are ignored, and empty tables give empty results.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    radius = float(np.sqrt(2 - 2 * cosine)) + EPSILON
    units = save_scratch(unit_vectors(vectors), "vectors-unit")
    sizes = save_scratch(units.groupBy("digest").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("copies")), "vectors-classes")
    first = units.join(sizes.withColumnRenamed("class", "vec_id"), ["digest", "vec_id"]).dropDuplicates(["digest"])
    classes = save_scratch(first.select(F.col("vec_id").alias("class"), "label", "dim", "vector", "copies", "digest"), "vectors-firsts")
    quantisers = fit_quantisers(classes, fit_vectors)
    blocks = _linked_blocks(_index(classes, quantisers, radius), quantisers, cosine, radius)
    linked = save_scratch(blocks, "vectors-linked")
    components = connected_components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    per_class = linked.groupBy("class").agg(F.sum("links").alias("links")).join(components.withColumnRenamed("node", "class"), "class", "left")
    per_class = save_scratch(per_class, "vectors-components")
    of_row = units.select("vec_id", "digest").join(sizes, "digest").dropDuplicates(["vec_id", "digest"])
    found = of_row.join(per_class, "class", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.min(F.coalesce("component", "class")).alias("component")
    )
    component = F.coalesce("component", "vec_id")
    return vectors.select("vec_id").join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def _index(classes: DataFrame, quantisers: dict[int, ProductQuantiser], radius: float) -> DataFrame:
    """Members of each list with their codes, and the probes that visit it, dealt to pairs of blocks."""
    kind = dict(classes.dtypes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim", sort=False):
                quantiser = _quantiser(quantisers, dim)
                units = _matrix(rows["vector"])
                home, codes, error = quantiser.encode(units)
                rows = rows.drop(columns="digest").reset_index(drop=True)
                yield rows.assign(list=home, member=True, codes=[c.tobytes() for c in codes], error=error)
                at, lists = np.nonzero(quantiser.probes(units, home, radius))
                if len(at):
                    yield rows.iloc[at].assign(list=lists, member=False, codes=b"", error=0.0)

    columns = f"class {kind['class']}, label {kind['label']}, dim int, vector binary, copies long, list int, member boolean, codes binary, error double"
    placed = save_scratch(classes.mapInPandas(place, columns), "vectors-index")
    cell = ["label", "dim", "list"]
    counts = placed.groupBy(*cell).agg(F.count_if("member").alias("n"), F.count_if(~F.col("member")).alias("m"))
    # joined on a derived key, so that both sides are shuffled for it and the planner may split a large list
    key = F.struct(*cell)
    wide = placed.withColumn("_key", key).join(counts.select(key.alias("_key"), "n", "m"), "_key").drop("_key")
    n, m = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "m"))
    own = F.pmod(F.xxhash64("class"), F.greatest(F.lit(1), F.when(F.col("member"), n).otherwise(m))).cast("int")
    wide = wide.where("n > 0").withColumn("blocks", n).withColumn("probes", m).withColumn("own", own)
    # members meet members (i <= j) and probes (kind 1): each row is sent to every pair of blocks that it is in
    pair = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    me = F.col("own")
    with_members = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: pair(0, F.least(o, me), F.greatest(o, me), 0))
    with_probes = F.when(F.col("probes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("probes") - 1, F.lit(0))), lambda o: pair(1, me, o, 0)))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: pair(1, o, me, 1))
    to = F.when(F.col("member"), F.concat(with_members, F.coalesce(with_probes, F.filter(with_members, lambda x: F.lit(False))))).otherwise(as_probe)
    return wide.withColumn("to", F.explode(to)).select(*cell, "to.kind", "to.i", "to.j", "to.side", "own", "class", "vector", "copies", "codes", "error")


def _linked_blocks(dealt: DataFrame, quantisers: dict[int, ProductQuantiser], cosine: float, radius: float) -> DataFrame:
    """``class, root, links`` of each class with a link in a pair of blocks; ``root`` is the smallest class it reaches there."""
    kind = dict(dealt.dtypes)["class"]

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, dim, at, pairing, i, j = key
        quantiser = _quantiser(quantisers, int(dim))
        rows = rows.sort_values(["side", "own", "class"], ignore_index=True)
        probe = (rows["side"] == 1).to_numpy() if pairing else (rows["own"] == j).to_numpy()
        member = ~probe if pairing else (rows["own"] == i).to_numpy()
        q, y = np.flatnonzero(probe), np.flatnonzero(member)
        nothing = rows[["class"]].iloc[:0].assign(root=rows["class"].iloc[:0], links=np.zeros(0, np.int64))
        if not len(q) or not len(y):
            return nothing
        units = _matrix(rows["vector"])
        codes = np.frombuffer(b"".join(rows["codes"].iloc[y]), np.uint8).reshape(len(y), -1)
        reach = (radius + rows["error"].to_numpy()[y] + EPSILON) ** 2
        near = quantiser.distances(units[q], int(at), codes) <= reach
        if not pairing and i == j:
            near &= q[:, None] < y[None, :]
        some_q, some_y = near.any(1), near.any(0)
        q, y, near = q[some_q], y[some_y], near[np.ix_(some_q, some_y)]
        exact = near & (units[q] @ units[y].T >= cosine)
        a, b = np.nonzero(exact)
        if not len(a):
            return nothing
        a, b = q[a], y[b]
        copies = rows["copies"].to_numpy()
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        order = np.argsort(rows["class"].to_numpy(), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = order[spanning_roots(place[a], place[b], len(rows))[place]]
        held = np.flatnonzero(links > 0)
        return pd.DataFrame({"class": rows["class"].to_numpy()[held], "root": rows["class"].to_numpy()[root[held]], "links": links[held].astype(np.int64)})

    return dealt.groupBy("label", "dim", "list", "kind", "i", "j").applyInPandas(compare, f"class {kind}, root {kind}, links long")
