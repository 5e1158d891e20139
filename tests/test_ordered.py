"""Running values over groups that lie in several parts, against plain windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passagework.operators import ordered, structure, verify


@pytest.fixture
def many_parts(spark):
    """Small tables keep all their range partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def rows(many_parts):
    rng = random.Random(3)
    keys = [None if i % 40 == 0 else "hot" if i % 3 else f"k{i % 7}" for i in range(400)]
    return many_parts.createDataFrame([(k, rng.choice([None, *range(500)]), i, rng.choice([None, None, i])) for i, k in enumerate(keys)], "g string, at int, id int, v int").cache()


def same(got, want):
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_running_values_equal_plain_windows(rows):
    parts = ordered.dealt(rows, ["g"], ["at", "id"])
    assert parts.where("g = 'hot'").select(ordered.PART).distinct().count() > 1
    got = ordered.running(parts, ["g"], ["at", "id"], {"s": ("sum", F.col("id")), "m": ("max_before", F.col("v")), "p": ("previous", F.struct("v", "id")), "v": ("last", F.col("v"))})
    own = W.partitionBy("g").orderBy("at", "id")
    want = rows.select("g", "at", "id", F.sum("id").over(own.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.max("v").over(own.rowsBetween(W.unboundedPreceding, -1)).alias("m"),
                       F.lag(F.struct("v", "id")).over(own).alias("p"), F.last("v", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0)).alias("v"))
    same(got, want)


def test_structure_over_several_parts(rows):
    own = W.partitionBy("g").orderBy("at", "id")
    before = F.lag("at").over(own)
    starts = (F.row_number().over(own) == 1) | F.coalesce(F.col("at") > before + 3, F.lit(False))
    want = rows.withColumn("s", starts.cast("int")).withColumn("run", F.sum("s").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("s")
    same(structure.gap_runs(rows, ["g"], "at", ["at", "id"], F.lit(3)), want)

    spans = [(r["g"], r["at"], r["at"] + r["id"] % 9) for r in rows.collect() if r["at"] is not None]
    table = rows.sparkSession.createDataFrame(spans + spans[:50], "g string, start int, end int")
    merged: list[list] = []
    for g, start, end in sorted(spans + spans[:50], key=lambda s: (s[0] or "", s[1:])):
        if merged and merged[-1][0] == g and start <= merged[-1][2]:
            merged[-1][2:] = max(merged[-1][2], end), merged[-1][3] + 1
        else:
            merged.append([g, start, end, 1])
    found = structure.merge_intervals(table, ["g"])
    assert sorted(map(repr, map(list, found.collect()))) == sorted(map(repr, merged))
    gaps = [[a[0], a[2], b[1]] for a, b in zip(merged, merged[1:]) if a[0] == b[0]]
    assert sorted(map(repr, map(list, structure.interval_gaps(found, ["g"]).collect()))) == sorted(map(repr, gaps))


def test_first_seen_over_several_parts(rows):
    seen = rows.withColumn("v", F.col("id") % 60)
    once = seen.withColumn("n", F.row_number().over(W.partitionBy("g", "v").orderBy("at", "id"))).where("n = 1").drop("n")
    want = once.withColumn("position", F.row_number().over(W.partitionBy("g").orderBy("at", "id")).cast("long"))
    same(verify.first_seen(seen, ["g"], "v", ["at", "id"]), want)


def test_empty_table_and_unknown_kind(rows):
    none = rows.limit(0)
    assert structure.merge_intervals(none.select("g", F.col("at").alias("start"), F.col("id").alias("end")), ["g"]).count() == 0
    assert structure.sequence_gaps(none, ["g"], "at").count() == 0
    with pytest.raises(ValueError):
        ordered.running(none, ["g"], ["at"], {"x": ("median", F.col("v"))})
