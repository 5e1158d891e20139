"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots that never change.  A small,
versioned map says which shard holds each slot; rebalancing and growing edit
the map and move whole slots, so no record is hashed anew.  Bytes are
aggregated per slot, and the map keeps the bytes of the shards near equal.

Built-in functions only; no Python code runs on the executors.  What reaches
the driver is one row per virtual slot, however large the input.
"""

from __future__ import annotations

import bisect
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passagework.sources.scratch import save_scratch

#: Fixed for the life of a data set: records never change their slot, unless a slot is split (the map says which are).
VIRTUAL_SLOTS = 4096
#: Parts in which the rows of a slot are numbered.
CELLS = 64
MAP_SCHEMA = "version int, virtual_slot int, shard int, split boolean, n_shards int, writer string"


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot in one version, ``shards[slot]``, and the slots whose records are spread by id."""

    version: int
    n_shards: int
    shards: tuple[int, ...] = field(repr=False)
    split: tuple[int, ...] = field(default=(), repr=False)

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = VIRTUAL_SLOTS) -> SlotMap:
        """Version 1: slots dealt round."""
        if not 0 < n_shards <= n_slots:
            raise ValueError("there must be at least one shard and no more shards than slots")
        return cls(1, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        total = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            total[shard] += slot_bytes[slot]
        return total

    def rebalanced(self, slot_bytes: list[int]) -> SlotMap:
        """Next version: single slots move from the fullest to the emptiest shard while that evens the two.

        The slot nearest to half the gap moves, so each move about halves the gap and few slots change place.
        """
        if len(slot_bytes) != len(self.shards):
            raise ValueError("one byte count per slot is needed")
        shards, loads = list(self.shards), self.loads(slot_bytes)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(shards):
            if slot_bytes[slot]:
                held[shard].append((slot_bytes[slot], slot))
        for slots in held:
            slots.sort()
        while True:
            full, empty = max(range(self.n_shards), key=lambda i: (loads[i], i)), min(range(self.n_shards), key=lambda i: (loads[i], i))
            gap, slots = loads[full] - loads[empty], held[full]
            at = bisect.bisect_left(slots, (gap / 2, -1))
            near = [i for i in (at - 1, at) if 0 <= i < len(slots) and slots[i][0] < gap]
            if not near:
                return SlotMap(self.version + 1, self.n_shards, tuple(shards), self.split)
            size, slot = moved = slots.pop(min(near, key=lambda i: abs(slots[i][0] - gap / 2)))
            bisect.insort(held[empty], moved)
            loads[full], loads[empty], shards[slot] = loads[full] - size, loads[empty] + size, empty

    def grown(self, slot_bytes: list[int]) -> SlotMap:
        """Next version with one more shard, which takes slots from the fullest shards and gives none."""
        new, shards = self.n_shards, list(self.shards)
        loads = self.loads(slot_bytes)
        target, taken = sum(loads) / (new + 1), 0
        for slot in sorted(range(len(shards)), key=lambda i: (-slot_bytes[i], i)):
            size = slot_bytes[slot]
            if taken + size <= target and loads[shards[slot]] - size >= target:
                loads[shards[slot]] -= size
                taken, shards[slot] = taken + size, new
        return SlotMap(self.version + 1, new + 1, tuple(shards), self.split)

    def to_df(self, spark: SparkSession) -> DataFrame:
        writer = uuid.uuid4().hex
        return spark.createDataFrame([(self.version, i, s, i in self.split, self.n_shards, writer) for i, s in enumerate(self.shards)], MAP_SCHEMA)


def save_slot_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version to the map table at ``path``; older versions stay readable.

    Two writers at once may both append a version; the older file counts, and the other writer gets an error.
    """
    slot_map.to_df(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    if load_slot_map(spark, path, slot_map.version) != slot_map:
        raise RuntimeError(f"another writer stored version {slot_map.version} of the slot map; run again to edit that one")


def load_slot_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the stored map, the newest by default; of a version that several writers appended the one whose file is older."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    mine = table.where(F.col("version") == version)
    writer = mine.agg(F.min(F.struct(F.col("_metadata.file_modification_time").alias("at"), "writer")).alias("first")).first()["first"]
    writer = writer["writer"] if writer else None
    rows = mine.where(F.col("writer") == writer).select("virtual_slot", "shard", "split", "n_shards").collect()
    shards = {slot: shard for slot, shard, *_ in rows}
    if not shards or len(rows) != len(shards) or sorted(shards) != list(range(len(shards))):
        raise ValueError(f"version {version} of the slot map is missing or incomplete")
    return SlotMap(version, rows[0]["n_shards"], tuple(shards[i] for i in range(len(shards))), tuple(sorted(slot for slot, _, cut, _ in rows if cut)))


def stored_slot_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest version at ``path``, null if nothing is stored there."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return load_slot_map(spark, path)


def virtual_slot(key: Column, n_slots: int = VIRTUAL_SLOTS) -> Column:
    """Slot of a record key; a null key has a slot like any other."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", n_slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> DataFrame:
    """Deal all rows to shards of near equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``, one row
    per input row.  ``size`` is the UTF-8 bytes of the text (null: none) plus 1.  ``slot`` is the place in
    the shard, gapless from 0.  The law is ``bytes``: the map depends on all sizes, so ``grown_shard`` is null.

    Records are hashed by their text, so equal texts share a virtual slot and a shard.  A slot with more bytes
    than half a shard's share is split: its records are hashed by id as well, which spreads a group of copies
    that is too large for even shards.  Where that leaves a slot too large, since rows repeat with equal or null ids,
    its split records are dealt by their place in the table; which of them goes where is left open.  Null and empty
    texts count as equal.  Repeated rows take a place each,
    an empty table gives an empty result, and extra columns are ignored.  With ``map_path`` the versions of the
    map are stored there with the split slots; later calls load the newest, edit it and add a version if it changed.
    A stored map of fewer shards is grown.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    # ids and lengths only: the texts are read once and never shuffled
    narrow = save_scratch(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), virtual_slot(F.coalesce(text, F.lit("")), n_slots).alias("virtual_slot"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-sizes",
    )
    slot_bytes, slot_rows = _slot_sums(narrow, n_slots)
    stored = stored_slot_map(spark, map_path) if map_path else None
    if stored and (len(stored.shards) != n_slots or stored.n_shards > n_shards):
        raise ValueError("the stored map has other slots or more shards")
    large = {i for i, b in enumerate(slot_bytes) if 2 * n_shards * b > sum(slot_bytes)}  # fewer than twice the shards
    split = sorted(large.union(stored.split if stored else ()))
    if split:
        spread = F.pmod(F.xxhash64("doc_id", "virtual_slot", "size"), F.lit(n_slots)).cast("int")
        cut = F.col("virtual_slot").isin(split)
        narrow = narrow.withColumns({"virtual_slot": F.when(cut, spread).otherwise(F.col("virtual_slot")), "_row": F.when(cut, F.col("_row"))})
        slot_bytes, slot_rows = _slot_sums(narrow, n_slots)
        full = [i for i, b in enumerate(slot_bytes) if 2 * n_shards * b > sum(slot_bytes)]
        if full:
            narrow = narrow.withColumn("_row", F.when(F.col("virtual_slot").isin(full), F.col("_row")))
            by_row = F.pmod(F.xxhash64("_row"), F.lit(n_slots)).cast("int")
            narrow = narrow.withColumn("virtual_slot", F.when(F.col("_row").isNotNull(), by_row).otherwise(F.col("virtual_slot")))
            slot_bytes, slot_rows = _slot_sums(narrow, n_slots)
        else:
            narrow = narrow.withColumn("_row", F.lit(None).cast("long"))
    else:
        narrow = narrow.withColumn("_row", F.lit(None).cast("long"))
    first = replace(stored or SlotMap.initial(n_shards, n_slots), split=tuple(split))
    final = first
    while final.n_shards < n_shards:
        final = final.grown(slot_bytes)
    final = replace(final.rebalanced(slot_bytes), version=first.version + 1)
    if stored and (final.shards, final.split, final.n_shards) == (stored.shards, stored.split, stored.n_shards):
        final = stored
    if map_path and not stored:
        save_slot_map(spark, first, map_path)
    if map_path and final is not stored:
        save_slot_map(spark, final, map_path)
    used, starts = [0] * n_shards, []
    for slot, shard in enumerate(final.shards):
        starts.append((slot, shard, used[shard]))
        used[shard] += slot_rows[slot]
    # one row per virtual slot: a size that doesn't grow with the input
    table = F.broadcast(spark.createDataFrame(starts, "virtual_slot int, shard int, start long"))
    # a slot's rows are numbered in cells, so that a large group of copies doesn't meet in one task
    cell = ["virtual_slot", "cell"]
    narrow = narrow.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "_row"), F.lit(CELLS)).cast("int"))
    ahead = F.sum("n").over(W.partitionBy("virtual_slot").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = narrow.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).select(*cell, F.coalesce(ahead, F.lit(0)).alias("ahead"))
    nth = F.row_number().over(W.partitionBy(*cell).orderBy("doc_id", "text_crc32", "size"))
    numbered = narrow.withColumn("nth", nth).join(cells, cell).join(table, "virtual_slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("ahead") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(final.version).alias("map_version"),
    )


def _slot_sums(narrow: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of every virtual slot."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    for slot, b, n in narrow.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        sizes[slot], rows[slot] = b, n
    return sizes, rows
