"""Near-duplicate documents by banded MinHash and odd sketches.

Each document is its set of distinct word shingles.  MinHash samples are
banded, and documents that agree in a band are candidates.  The samples are
also folded into a parity bitmap, an odd sketch: each sample flips one bit.
The bits in which two sketches differ estimate how many samples differ, and
candidates that can't reach the similarity are dropped.  What is left is
confirmed on the full sets.

Groups of thousands of copies never become all their pairs:

1. Documents with equal sets are one class from the start.
2. In each bucket of a band the sketches of all classes are compared.  Small
   buckets do so in a join; large ones are cut into blocks, and each pair of
   blocks is one task that returns a spanning forest of its candidates.
   Components of these candidates are families.
3. The full sets of a family meet.  A large family is cut into parts, and each
   part gets two of the family's members as well, so a family of copies is
   connected after every set was sent once.  Only where it still has several
   components do its parts meet each other.  A task compares the classes that
   are not yet linked, most similar first, and returns at most one link for
   each two components that it joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.components import connected_components, spanning_roots
from passagework.llm.sampling import give_back
from passagework.sources.scratch import save_scratch

#: A pair of similarity 0.8 agrees in no band with a chance of 3 in a million.
BANDS, BAND_ROWS = 24, 4
SAMPLES = BANDS * BAND_ROWS
SKETCH_WORDS = 4
SKETCH_BITS = 64 * SKETCH_WORDS
#: Candidates stay if their estimate is at most so many standard deviations of the samples below the similarity.
SLACK = 5.0
#: Buckets of up to so many members are joined with themselves; larger ones go block against block.
SMALL_BUCKET = 16
#: Members of a block of a bucket, and of a family with its full sets.
BUCKET_BLOCK, FAMILY_BLOCK = 512, 256
#: Small families that are confirmed together hold about so many members.
FAMILY_BATCH = 1000
#: Ids of up to so many candidates (8 MB) are sent to the scan of the texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
MEMO_WORDS = 150_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 2**32, SAMPLES, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, SAMPLES, np.uint64).astype(np.uint32)
_SALT = _rng.integers(0, 2**63, SAMPLES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit hash of a word, worked out once per task while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX2
    return x ^ x >> np.uint64(29)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, no words none.

    Words are runs of other characters than ASCII white space, with A-Z lower-cased.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, split), np.uint64, len(split))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """32-bit MinHash samples of a set that isn't empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (low[at : at + 4096, None] * _MULTIPLY + _ADD).min(0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = _mix(out * _MIX + rows[:, k])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap: every sample flips the bit that it hashes to."""
    at = _mix(samples.astype(np.uint64) * _MIX + _SALT) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8).view(np.uint64)


def most_differing_bits(similarity: float) -> int:
    """Differing bits up to which a pair may have the similarity."""
    least = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / SAMPLES)
    differing = 2 * SAMPLES * (1 - max(0.0, least))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS))))


def _binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def shingle_sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, s0..`` of each row of ``doc_id, text``; an empty set has no digest or bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, digests, bands, bits = [], [], [], []
                for text in batch.column("text").to_pylist():
                    shingles = shingle_hashes(text, words)
                    sizes.append(len(shingles))
                    if len(shingles):
                        samples = minhash(shingles)
                        digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(samples).view(np.int64))
                        bits.append(odd_sketch(samples).view(np.int64))
                    else:
                        digests.append(None)
                        bands.append(None)
                        bits.append(np.zeros(SKETCH_WORDS, np.int64))
                words_of = np.stack(bits, 1)
                columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), _binary(digests), pa.array(bands, pa.list_(pa.int64())), *(pa.array(w) for w in words_of)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", *_SKETCH])
        _words.clear()
        give_back()

    return docs.mapInArrow(sketch, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH))


_SKETCH = tuple(f"s{i}" for i in range(SKETCH_WORDS))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles``: the full set of each row of ``doc_id, text``, as the bytes of its sorted hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                values = [shingle_hashes(t, words).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _binary(values)], ["doc_id", "shingles"])
        _words.clear()
        give_back()

    return docs.mapInArrow(sets, f"doc_id {kind}, shingles binary")


def _differing_bits(left: str, right: str) -> Column:
    total = F.lit(0)
    for s in _SKETCH:
        total = total + F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}")))
    return total


def candidate_matrix(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows ``a`` and ``b`` may have the similarity by their sizes and sketches, and their differing bits."""
    sketch, n = np.ascontiguousarray(rows[list(_SKETCH)].to_numpy(np.int64)).view(np.uint64), rows["n_shingles"].to_numpy()
    bits = np.zeros((len(a), len(b)), np.int16)
    for k in range(SKETCH_WORDS):
        bits += np.bitwise_count(sketch[a, None, k] ^ sketch[None, b, k])
    low, high = np.minimum(n[a, None], n[None, b]), np.maximum(n[a, None], n[None, b])
    return (bits <= most_differing_bits(percent / 100)) & (100 * low >= percent * high), bits


def _sides(rows: pd.DataFrame, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a task; one block stands on both sides of its own task."""
    block = rows["block"].to_numpy()
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def candidate_forest(members: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that connect all pairs of a bucket that may have the similarity, with few edges per member."""
    kind = dict(members.dtypes)["doc_id"]
    buckets = members.select("doc_id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    columns = ["doc_id", "n_shingles", *_SKETCH]
    held = save_scratch(buckets.join(shared, "key").join(members.drop("bands"), "doc_id").select("key", "n", *columns), "near-buckets")
    few, many = held.where(F.col("n") <= SMALL_BUCKET), held.where(F.col("n") > SMALL_BUCKET)
    near = _differing_bits("x", "y") <= most_differing_bits(percent / 100)
    low, high = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (100 * low >= percent * high) & near
    pairs = few.alias("x").join(few.alias("y"), same).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))

    def forest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", ignore_index=True)
        a, b = _sides(rows, *key[1:])
        x, y = np.nonzero(candidate_matrix(rows, a, b, percent)[0])
        root = spanning_roots(a[x], b[y], len(rows))
        linked = np.flatnonzero(root != np.arange(len(rows)))
        ids = rows["doc_id"].to_numpy()
        return pd.DataFrame({"a": ids[root[linked]], "b": ids[linked]})

    dealt = _block_pairs(many.withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")))
    blocks = dealt.groupBy("key", "i", "j").applyInPandas(forest, f"a {kind}, b {kind}")
    return pairs.unionByName(blocks).distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows in each pair of blocks ``i <= j`` that they take part in; ``blocks`` is the number of a group's blocks."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "_with")).withColumn("j", F.greatest("block", "_with")).drop("_with", "blocks")


def confirmed_links(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of row numbers that link rows ``a`` with rows ``b`` on their full sets, one for each join of components.

    Rows of one ``component``, where that column is given, are connected already.

    The candidates of a row that it is not connected with yet are compared in order of their sketches, in
    growing runs; a pair that is connected by then needs no comparison.
    """
    may, bits = candidate_matrix(rows, a, b, percent)
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    root, out = np.arange(len(rows)) if "component" not in rows else pd.factorize(rows["component"])[0], []
    for x, row in enumerate(a):
        may[x] &= b != row
        run = 4
        while len(left := np.flatnonzero(may[x] & (root[b] != root[row]))):
            tried = left[np.argsort(bits[x, left], kind="stable")[:run]]
            may[x, tried] = False
            run *= 2
            own, others = sets[row], [sets[b[y]] for y in tried]
            sizes = np.array([len(o) for o in others])
            flat = np.concatenate(others)
            held = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(held, np.cumsum(sizes) - sizes, dtype=np.int64)
            for y in tried[100 * both >= percent * (len(own) + sizes - both)]:
                if root[b[y]] != root[row]:
                    out.append((row, b[y]))
                    root[root == root[b[y]]] = root[row]
    return out


def _linked(rows: pd.DataFrame, found: list[tuple[int, int]]) -> pd.DataFrame:
    ids = rows["doc_id"].to_numpy()
    return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, columns=["a", "b"])


def family_components(families: DataFrame, members: DataFrame, docs: DataFrame, words: int, percent: int, links: DataFrame | None) -> DataFrame:
    """``node, component`` by links on the full sets within each family of ``node, component``, and by further ``links``."""
    kind = dict(members.dtypes)["doc_id"]
    schema = f"a {kind}, b {kind}"
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    count = families.count()
    of = families.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "n", "low", "high")
    of = save_scratch(of.join(members.drop("bands"), "doc_id"), "near-families")

    def with_sets(rows: DataFrame) -> DataFrame:
        ids = rows.select("doc_id")
        wanted = docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        return rows.join(shingle_sets(wanted, words), "doc_id")

    full, small = with_sets(of), F.col("n") <= FAMILY_BLOCK
    # small families share a task; a large one is cut into parts that get its first and last member as well
    together = full.where(small).withColumn("batch", F.pmod(F.xxhash64("family"), F.lit(max(1, count // FAMILY_BATCH))))
    parts = F.ceil(F.col("n") / FAMILY_BLOCK).cast("int")
    own = F.array(F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    every = F.sequence(F.lit(0), parts - 1)
    apart = full.where(~small).withColumn("part", F.explode(F.when(F.col("doc_id").isin(F.col("low"), F.col("high")), every).otherwise(own)))

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([part(family) for _, family in rows.groupby("family", sort=False)])

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        rows = rows.assign(first=[i not in (low, high) for i in rows["doc_id"]]).sort_values(["first", "doc_id"], ignore_index=True)
        all_rows = np.arange(len(rows))
        return _linked(rows, confirmed_links(rows, all_rows, all_rows, percent))

    found = together.groupBy("batch").applyInPandas(batch, schema).unionByName(apart.groupBy("family", "part").applyInPandas(part, schema))
    found = save_scratch(found if links is None else found.unionByName(links), "near-links")
    components = save_scratch(connected_components(found), "near-components")
    if of.where(~small).isEmpty():
        return components
    # large families that are not connected by now: their parts meet each other
    placed = of.where(~small).join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = save_scratch(placed, "near-placed")
    mixed = placed.groupBy("family").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("family")
    rest = save_scratch(placed.join(mixed, "family", "left_semi"), "near-mixed")
    if rest.isEmpty():
        return components

    def blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", ignore_index=True)
        return _linked(rows, confirmed_links(rows, *_sides(rows, *key[1:]), percent))

    dealt = _block_pairs(with_sets(rest).withColumn("blocks", parts)).where("i < j")
    more = dealt.groupBy("family", "i", "j").applyInPandas(blocks, schema)
    return save_scratch(connected_components(save_scratch(found.unionByName(more), "near-links")), "near-components")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets.  ``component_id`` is the
    smallest id reachable by links, and ``kept`` marks the document with that id.  ``percent`` is at least 80.

    A document without words (null, empty, white space) is linked with nothing.  Rows with equal ids are one
    document that is linked as any of its texts is, so they have one component.  A row with a null id has no
    component and is kept.
    Extra columns are ignored, and an empty table gives an empty result.
    """
    if not 80 <= percent <= 100 or words < 1:
        raise ValueError("percent must be 80 to 100 and words positive")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketches = save_scratch(shingle_sketches(docs, words), "near-sketches")
    classes = save_scratch(sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class")), "near-classes")
    first = sketches.join(classes.withColumnRenamed("class", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    members = save_scratch(first.drop("digest"), "near-members")
    placed = save_scratch(sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").drop("digest"), "near-placed")
    # ids with several rows, and the links that their texts make between classes
    several = placed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    several = save_scratch(placed.where("class IS NOT NULL").join(several, "doc_id", "left_semi").select("doc_id", "class").distinct(), "near-several")
    links = several.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    families = save_scratch(connected_components(candidate_forest(members, percent)), "near-candidates")
    components = family_components(families, members, docs, words, percent, links)
    found = placed.join(components.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    of_id = several.join(components.withColumnRenamed("node", "class"), "class", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "class")).alias("of_id"))
    component = F.coalesce("of_id", "component", "doc_id")
    return found.join(of_id, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
