"""Training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("passagework.llm")

import public_tokenizers  # noqa: E402

from passagework.llm import image_copies as image_copies_module  # noqa: E402
from passagework.llm import queries as Q  # noqa: E402
from passagework.llm.components import connected_components, spanning_roots  # noqa: E402
from passagework.llm.embedding_dups import ProductQuantiser, embedding_duplicates  # noqa: E402
from passagework.llm.image_copies import _resized, agreeing_corners, describe, image_copies, media_from_embeddings, packed, read_pgm, shared_keys, table_keys, unpacked, write_pgm  # noqa: E402
from passagework.llm.language_id import LanguageFilter, predict_language, train_language_id  # noqa: E402
from passagework.llm.near_duplicates import minhash, most_differing_bits, near_duplicates, odd_sketch, shingle_hashes  # noqa: E402
from passagework.llm.packing import best_fit_patterns, exact_patterns, pack_documents, packed_sequences, plan_packing, token_pieces  # noqa: E402
from passagework.llm.piece_codec import PieceEncoder, decode_pieces, encode_pieces, encoded_and_decoded  # noqa: E402
from passagework.llm.quality_crf import LineCrf, N_FEATURES, quality_score, train_quality  # noqa: E402
from passagework.llm.sharding import SlotMap, load_slot_map, save_slot_map, shard_documents  # noqa: E402
from passagework.llm.toxicity_mil import ToxicityModel, score_text, toxicity, train_toxicity  # noqa: E402
from passagework.llm.url_filter import UrlRule, filter_urls  # noqa: E402
from passagework.llm.word_tokens import WordTokens  # noqa: E402
from passagework.sources.scratch import scratch_root  # noqa: E402

LONG = "lorem ipsum dolor sit amet " * 4000
DOCS = "doc_id long, text string, lang string, Score double, `n` int, label int"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1.0, 2, 3) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long and repeated texts, a null id, and rows of one id."""
    return documents(spark, [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "A tie."), (6, "A tie."), (6, "A tie."), (7, "Ünïcode “quotes” 你好 😀\x00"), (None, "no id"), (8, "x" * 20000)])


# --- 1 URL filters


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else default


@pytest.mark.parametrize("inline", [256, 0])
def test_url_filter_against_brute_force(spark, inline):
    rules = [UrlRule.parse(*r) for r in [*Q.URL_RULES, ("block", "ads.example.org"), ("allow", "x-y.net/a.b/c+d"), ("block", "例え.jp/"), ("block", "例え")]]
    urls = [None, "", "no scheme", "http://", "http://COM/en/1", "https://a.com/en/", "https://acom/en/", "http://com/enx", "http://example.com/en/70?x#y", "http://example.com/en/6", "http://b.example.net/de/8",
            "http://b.example.net/de/9#", "http://example.org/es/?q=://net/de/", "ftp://ads.example.org", "ftp://ads.example.org:80/x", "http://x-y.net/a.b/c+d/e", "http://x-y.net/aab/c+d", "http://例え.jp/x", "http://a.例え", "http://n.net/de/\nx",
            "http://ads.example.org?x", "x" * 5000 + "://c.com/en/", "http://com/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumns({"host": F.lit("h"), "verdict": F.lit(1), "Rule": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, rules, inline_rules=inline).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert filter_urls(pages.where("false"), rules, inline_rules=inline).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, [], inline_rules=inline).collect()} == {"allow"}


def test_url_filter_tries_few_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = [UrlRule("block", f"host{i}.example.com", f"/p{i}/") for i in range(40)] + [UrlRule.parse(*r) for r in Q.URL_RULES]
    assert filter_urls(pages, rules).agg(F.max("n_tried")).first()[0] <= 5
    plan = filter_urls(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- 2 quality, 3 toxicity


def paths(crf, e):
    """Marginals by listing all label sequences."""
    n = len(e)
    weights = {}
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        weights[tuple(y)] = math.exp(crf.start[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(crf.transitions[y[i], y[i + 1]] for i in range(n - 1)))
    z = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]


def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    crf = LineCrf(rng.normal(size=N_FEATURES), rng.normal(size=2), rng.normal(size=(2, 2)), 0.5)
    lengths = np.array([3, 1, 6, 2])
    features = rng.normal(size=(lengths.sum(), N_FEATURES)).astype(np.float32)
    got, e, at = crf.marginals(features, lengths), crf.emissions(features), 0
    for n in lengths:
        assert got[at : at + n] == pytest.approx(paths(crf, e[at : at + n]))
        at += n


def test_quality_on_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = Q.op2_quality(spark, base).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97 and got["score"].between(0, 1).all()
    model = train_quality(docs, labels.where("false"))
    assert model.blank == 0.5 and docs.limit(5).select(quality_score(model, F.col("text"))).count() == 5


def test_quality_edges(spark, odd):
    crf = LineCrf(np.ones(N_FEATURES), np.zeros(2), np.eye(2), 0.7)
    rows = odd.select("doc_id", quality_score(crf, F.col("text")).alias("s")).collect()
    assert len(rows) == 10 and all(0 <= r["s"] <= 1 for r in rows)
    assert {r["s"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.7}
    assert odd.where("false").select(quality_score(crf, F.col("text"))).count() == 0


def test_toxicity_locates_sentences():
    model = ToxicityModel(-8.0, {"scum": 12.0, "mor-": 0.0, "moro-": 10.0}, 0.1)
    text = "All fine here. You scum! Nothing more.\nA moronic line"
    score, spans = score_text(model, text, 0.5)
    assert score > 0.9 and [text[s["start"] : s["end"]] for s in spans] == ["You scum!", "A moronic line"]
    each = [1 / (1 + math.exp(8)), 1 / (1 + math.exp(-4)), 1 / (1 + math.exp(8)), 1 / (1 + math.exp(-2))]
    assert score == pytest.approx(1 - math.prod(1 - p for p in each))
    assert score_text(model, None, 0.5) == score_text(model, " ?! \n", 0.5) == (0.0, [])


def test_toxicity_on_planted_documents(spark, odd):
    bad = ["vile", "rotten", "nasty"]
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 30))
        if i % 4 == 0:
            words[int(rng.integers(30))] = bad[i % 3]
        rows.append((i, " ".join(words[:15]) + ". " + " ".join(words[15:])))
        marks.append((i, int(i % 4 == 0)))
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = train_toxicity(docs, labels)
    got = docs.join(labels, "doc_id").select("toxic", toxicity(model, F.col("text")).alias("t")).toPandas()
    assert ((got["t"].map(lambda t: t["score"]) >= 0.5) == (got["toxic"] == 1)).mean() > 0.98
    one_kind = train_toxicity(docs, labels.where("toxic = 0"))
    assert odd.select(toxicity(one_kind, F.col("text")).alias("t")).where("t.score > 0.01").count() == 0


# --- 4 sharding


def test_sharding(spark, odd, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("ab"), (F.col("id") % 1500).cast("string")), (F.col("id") % 50).cast("int")).alias("text"), F.lit(9).alias("shard"))
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, "é"), (5000, None)], "doc_id long, text string").withColumn("shard", F.lit(1)))
    got = shard_documents(docs, 16, map_path=str(tmp_path / "map")).toPandas()
    texts = docs.toPandas()["text"].fillna("")
    assert len(got) == 3007 and got["size"].sum() == sum(len(t.encode()) + 1 for t in texts)
    per = got.groupby("shard")["size"].sum()
    assert sorted(per.index) == list(range(16)) and per.max() - per.min() <= 150
    for _, places in got.groupby("shard")["slot"]:
        assert sorted(places) == list(range(len(places)))
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1 and got.groupby("virtual_slot")["shard"].nunique().max() == 1
    assert collections.Counter(got["text_crc32"]) == collections.Counter(zlib.crc32(t.encode()) for t in texts)
    first, last = (load_slot_map(spark, str(tmp_path / "map"), v) for v in (1, None))
    assert (first.version, last.version) == (1, 2) and first == SlotMap.initial(16)
    assert shard_documents(odd, 4).count() == 10 and shard_documents(odd.where("false"), 4).count() == 0


def test_a_group_too_large_for_a_shard_is_spread(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text no "), F.col("id").cast("string"))).alias("text"))
    got = shard_documents(docs, 8).toPandas()
    per = got.groupby("shard")["size"].sum()
    assert per.max() - per.min() <= 20 and all(sorted(p) == list(range(len(p))) for _, p in got.groupby("shard")["slot"])


def test_repeated_rows_are_spread(spark):
    rows = [(None, "same")] * 4000 + [(7, "own")] * 1500 + [(i, f"text no {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shard_documents(docs, 16).toPandas()
    per = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and per.max() - per.min() <= 40 and all(sorted(p) == list(range(len(p))) for _, p in got.groupby("shard")["slot"])
    plain = got[got["text_crc32"].map(got["text_crc32"].value_counts()) == 1]
    again = shard_documents(docs.repartition(3), 16).toPandas().set_index("text_crc32")["virtual_slot"]
    assert (plain.set_index("text_crc32")["virtual_slot"] == again[plain["text_crc32"]]).all()


def test_sharding_query_on_its_whole_table(spark, sf_dir):
    got = Q.op4_sharding(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert sorted(got["doc_id"]) == sorted(docs.index) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    per = got.groupby("shard")["size"].sum()
    assert sorted(per.index) == list(range(16)) and per.max() / per.min() < 1.1
    assert all(sorted(p) == list(range(len(p))) for _, p in got.groupby("shard")["slot"])


def test_growing_a_slot_map(spark, tmp_path):
    sizes = [int(x) for x in np.random.default_rng(0).integers(0, 1000, 512)]
    old = SlotMap.initial(7, 512).rebalanced(sizes)
    new = old.grown(sizes)
    moved = [(a, b) for a, b in zip(old.shards, new.shards, strict=True) if a != b]
    assert moved and all(b == 7 for _, b in moved) and max(new.loads(sizes)) - min(new.loads(sizes)) < 1500
    save_slot_map(spark, new, str(tmp_path / "m"))
    assert load_slot_map(spark, str(tmp_path / "m")) == new
    assert old.rebalanced(sizes).shards == old.shards


def test_two_writers_of_one_slot_map(spark, tmp_path):
    path, first = str(tmp_path / "m"), SlotMap(1, 3, (0, 1, 0, 1))
    save_slot_map(spark, first, path)
    save_slot_map(spark, first, path)  # the same map twice is no conflict
    with pytest.raises(RuntimeError, match="another writer"):
        save_slot_map(spark, SlotMap(1, 3, (1, 1, 0, 0)), path)
    assert load_slot_map(spark, path) == first and first.n_shards == 3
    save_slot_map(spark, SlotMap(2, 5, (0, 1, 2, 2)), path)
    assert load_slot_map(spark, path) == SlotMap(2, 5, (0, 1, 2, 2)) and load_slot_map(spark, path, 1) == first


def test_stored_slot_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "m")
    # one text has most of the bytes
    docs = spark.createDataFrame([(i, "copy " * 50 if i < 300 else f"text {i} " * 5) for i in range(600)], "doc_id long, text string")
    columns = ["doc_id", "shard", "virtual_slot", "map_version"]
    one, two = (sorted(map(tuple, shard_documents(docs, 4, map_path=path).select(columns).collect())) for _ in range(2))
    stored = load_slot_map(spark, path)
    assert one == two and {r[3] for r in one} == {2} == {stored.version} and len(stored.split) == 1
    assert all(stored.shards[slot] == shard for _, shard, slot, _ in one)
    assert spark.read.parquet(path).count() == 2 * len(stored.shards)
    # the copies are few among the later rows, and their slots hold
    more = docs.unionByName(spark.createDataFrame([(1000 + i, f"more {i} " * 40) for i in range(3000)], docs.schema))
    slots = {r.doc_id: (r.virtual_slot, r.shard, r.map_version) for r in shard_documents(more, 4, map_path=path).collect()}
    new = load_slot_map(spark, path)
    assert all(slots[i][0] == slot for i, _, slot, _ in one) and new.split == stored.split
    assert new.version == 3 and all(new.shards[slot] == shard and v == 3 for slot, shard, v in slots.values())
    assert shard_documents(more, 5, map_path=path).select("shard").distinct().count() == 5 == load_slot_map(spark, path).n_shards
    with pytest.raises(ValueError):
        shard_documents(more, 4, map_path=path)


# --- 5 media


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=24).tolist(), 0) for i in range(40)] + [(41, None, 0), (42, [0.0] * 24, 1)], "vec_id long, embedding array<double>, label int")
    media = media_from_embeddings(vectors).cache()
    extra = media.where("media_id = 4").withColumn("media_id", F.lit(100_001).cast("long"))
    more = spark.createDataFrame([(900_001, b"junk", 0, "x"), (900_002, None, 0, "x"), (None, None, 0, "x"), (900_003, b"P5 1 1 255\n\x07", 0, "x")], media.schema)
    got = image_copies(media.unionByName(extra).unionByName(more).withColumn("kept", F.lit(1))).toPandas().set_index("media_id")
    crops = [i for i in got.index if i == i and i < 200 and i % 4]
    assert len(crops) == 8 and sum(got["component_id"][i] == i // 4 * 4 for i in crops) >= 7
    assert got["component_id"][100_001] == 4 and not got["kept"][100_001]
    assert all(got["component_id"][i] == i for i in (900_001, 900_002, 900_003)) and got["kept"].isna().sum() == 0
    originals = [4 * i for i in range(40)]
    assert all(got["component_id"][i] == i for i in originals)
    assert image_copies(media.where("false")).count() == 0


def test_image_descriptors_follow_turns():
    rng = np.random.default_rng(4)
    field = np.kron(rng.integers(0, 255, (12, 12)), np.ones((7, 7)))
    turned = agreeing_corners(*describe(field), *describe(np.rot90(field).copy()))
    assert turned >= 6 and agreeing_corners(*describe(field), *describe(np.kron(rng.integers(0, 255, (12, 12)), np.ones((7, 7))))) < 6
    assert len(describe(np.zeros((5, 5)))[0]) == len(describe(np.zeros((60, 60)))[0]) == 0 and write_pgm(np.zeros((2, 3))).startswith(b"P5 3 2 255\n")


def test_closest_descriptors_both_ways(monkeypatch):
    """Against plain comparisons of all bits, with ties, opposite descriptors, and in several pieces."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (40, 256), np.uint8)
    a = np.concatenate([base, base[:10], 1 - base[:3]])
    b = np.concatenate([base[5:] ^ (rng.random((35, 256)) < 0.12), 1 - base[:2], base[:8], base[:8]]).astype(np.uint8)
    far = (a[None] != b[:, None]).sum(2)
    want = [(int(far[i].argmin()), i) for i in range(len(b)) if far[i].min() <= image_copies_module.MOST_DIFFERING and far[:, far[i].argmin()].argmin() == i]
    words = [np.packbits(x, axis=1).view(np.uint64) for x in (a, b)]
    for at_once in (1024, 20):
        monkeypatch.setattr(image_copies_module, "CORNERS_AT_ONCE", at_once)
        got = image_copies_module._closest_both_ways(*words)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want and 20 < len(want) < len(b)
    one = np.zeros((1, 4), np.uint64)
    assert [x.tolist() for x in image_copies_module._closest_both_ways(one, ~one)] == [[], []]


def test_agreeing_corners_need_one_turn():
    """Ten matches on one shift agree, and none do where each has a turn of its own."""
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2**63, (10, 4)).astype(np.uint64)
    places = np.stack([*rng.uniform(10, 60, (2, 10)), np.ones(10), rng.uniform(-3.1, 3.1, 10)], 1)
    moved = places + [7.0, -5.0, 0.0, 0.0]
    assert agreeing_corners(places, bits, moved, bits) == 10
    turned = moved.copy()
    turned[:, 3] += np.arange(10) * 2 * np.pi / 10
    assert agreeing_corners(places, bits, turned, bits) == 0
    wrapped = moved + np.array([0, 0, 0, 2 * np.pi]) * (np.arange(10) % 3 - 1)[:, None]
    assert agreeing_corners(places, bits, wrapped, bits) == 10


def _drawn_field(rng, cells, side):
    """A smooth random image."""
    at = np.linspace(0, cells - 1.001, side)
    i, part = at.astype(int), at % 1
    grid = rng.normal(size=(cells, cells))
    rows = grid[i] * (1 - part)[:, None] + grid[i + 1] * part[:, None]
    return 127.5 + 110 * np.tanh(1.5 * (rows[:, i] * (1 - part) + rows[:, i + 1] * part))


def _copy_components(spark, images):
    media = spark.createDataFrame([(i, bytearray(write_pgm(grey))) for i, grey in images.items()], "media_id long, image binary")
    return {r.media_id: r.component_id for r in image_copies(media).collect()}


def test_image_copies_after_stronger_edits(spark):
    rng = np.random.default_rng(8)
    images = {}
    for n in range(12):
        grey = _drawn_field(rng, 19, 72)
        edits = [grey + rng.normal(0, 12, grey.shape), 60 + 0.4 * grey + rng.normal(0, 4, grey.shape), np.rot90(grey) + rng.normal(0, 8, grey.shape), _resized(grey, 1 / 0.85), grey[10:60, 10:46] + rng.normal(0, 4, (50, 36))]
        images.update({10 * n + k: image for k, image in enumerate([grey, *edits])})
    got = _copy_components(spark, images)
    assert {i: c for i, c in got.items() if c != i // 10 * 10} == {}


def test_image_copies_crops_of_large_images(spark):
    rng = np.random.default_rng(9)
    images = {}
    for n in range(3):
        # the strongest corners are in one part only
        grey = _drawn_field(rng, 70, 280)
        grey[:, 140:] = 127.5 + (grey[:, 140:] - 127.5) * 0.3
        images.update({10 * n: grey, 10 * n + 1: grey[140:, 140:], 10 * n + 2: grey[70:210, 70:210], 10 * n + 3: grey[200:250, 200:250]})
    got = _copy_components(spark, images)
    assert {i: c for i, c in got.items() if c != i // 10 * 10} == {}
    places = describe(images[0])[0]
    assert all(((places[:, 0] // 40 == i) & (places[:, 1] // 40 == j)).sum() >= 6 for i in range(1, 6) for j in range(1, 6))


def test_image_keys_travel_packed(spark):
    """Pairs counted from packed keys are those of all pairs of key sets, also where most buckets count as large."""
    rng = np.random.default_rng(12)
    for n, most in ((1, 2**40), (1000, 50), (1001, 2**12), (70_000, 2**32)):
        values = np.sort(rng.integers(0, most, n).astype(np.uint64))
        assert (unpacked(packed(values)) == values).all()
    base = [rng.normal(size=24) for _ in range(30)]
    near = [v + rng.normal(0, 0.03, 24) for v in base[:12] for _ in range(3)]
    media = media_from_embeddings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*base, *near])], "vec_id long, embedding array<double>")).cache()
    root = f"{scratch_root(spark)}"
    before = set(os.listdir(root))
    want = {r.media_id: r.component_id for r in image_copies(media).collect()}
    written = sum(os.path.getsize(os.path.join(d, f)) for x in set(os.listdir(root)) - before for d, _, names in os.walk(os.path.join(root, x)) for f in names if f.endswith(".parquet") and os.path.getsize(os.path.join(d, f)) > 10_000)
    assert written < 20_000 * len(want)  # corners once; neither keys nor pairs as rows
    assert len(set(want.values())) < len(want) - 12
    assert {r.media_id: r.component_id for r in image_copies(media, all_pairs=2).collect()} == want
    rows = sorted(media.collect(), key=lambda r: r.media_id)
    numbered = spark.createDataFrame([(k, r.image) for k, r in enumerate(rows)], "number long, image binary")
    keys = [set((table_keys(*describe(read_pgm(bytes(r.image)))).view(np.uint64) >> np.uint64(32)).tolist()) for r in rows]
    members = collections.Counter(k for x in keys for k in x)
    for all_pairs in (1024, 2):
        small = [{k for k in x if members[k] <= all_pairs} for x in keys]
        pairs = {(a, b): len(small[a] & small[b]) for a in range(len(rows)) for b in range(a + 1, len(rows))}
        for least in (3, 1):
            got = shared_keys(numbered, len(rows), 20_000_000, least, all_pairs).collect()
            assert {(r.a, r.b): min(r.n, 3) for r in got if r.key < 0} == {p: min(n, 3) for p, n in pairs.items() if n >= least}
            assert {(r.key, r.a) for r in got if r.key >= 0} == {(k, a) for a, x in enumerate(keys) for k in x if members[k] > all_pairs}


# --- 6 near-duplicates


def shingles(text, words):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    split = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(split[i : i + words]) for i in range(len(split) - words + 1)} if len(split) >= words else ({tuple(split)} if split else set())


def components_by_hand(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t in rows]
    index = collections.defaultdict(list)
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, s) in enumerate(sets):
        shared = collections.Counter(j for x in s for j in index[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(k)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = list(rng.choice(words, int(rng.integers(5, 120))))
        for _ in range(25 if base == 3 else 6):
            copy = list(text)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, "one two"), (len(rows) + 2, "One\vtwo "), (len(rows) + 3, "É two"), (len(rows) + 4, "é two")]
    got = {r["doc_id"]: r for r in near_duplicates(documents(spark, rows), words=4).collect()}
    want = components_by_hand(rows, 4, 80)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingles(t, 4)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_large_groups_go_block_by_block(spark, monkeypatch):
    from passagework.llm import near_duplicates as module

    for name, value in (("SMALL_BUCKET", 4), ("BUCKET_BLOCK", 16), ("FAMILY_BLOCK", 16), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows), words=4).collect()}
    assert got == components_by_hand(rows, 4, 80)


def test_large_families_of_several_components(spark, monkeypatch):
    from passagework.llm import near_duplicates as module

    for name, value in (("SMALL_BUCKET", 4), ("BUCKET_BLOCK", 16), ("FAMILY_BLOCK", 8)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(10)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 100)]
    rows = []
    for i in range(90):  # a chain of copies that drift apart, and copies of both ends
        copy = list(base)
        for at in range(min(i, 60)):
            copy[at] = f"x{at}"
        copy[60 + i % 40] = f"y{i}"
        rows.append((i * 7 % 90, " ".join(copy)))
    for count in (90, 24):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows[:count] + rows[-count:]), words=2).collect()}
        want = components_by_hand(list(dict(rows[:count] + rows[-count:]).items()), 2, 80)
        assert got == want
    assert len(set(want.values())) > 1


def test_rows_of_one_id_have_one_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, b), (5, a), (5, b), (9, a), (9, None), (20, c), (21, c), (21, None), (22, ""), (22, None), (30, a + " more"), (30, c)]
    got = collections.defaultdict(set)
    for r in near_duplicates(documents(spark, rows), words=4).collect():
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert got == {1: {(1, True)}, 5: {(1, False)}, 9: {(1, False)}, 20: {(1, False)}, 21: {(1, False)}, 22: {(22, True)}, 30: {(1, False)}}


def test_near_duplicate_edges(spark, odd):
    got = near_duplicates(odd.unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(40).cast("long")))).collect()
    of = collections.defaultdict(set)
    for r in got:
        of[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert len(got) == 11 and of[1] == {(1, True)} and of[2] == {(2, True)} and of[6] == {(5, False)} and of[40] == {(4, False)} and of[None] == {(None, True)}
    assert near_duplicates(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(odd, percent=70)


def test_odd_sketches_estimate_differences():
    rng = np.random.default_rng(2)
    for keep in (0.98, 0.9, 0.8):
        a = rng.integers(0, 2**63, 600).astype(np.uint64)
        b = np.concatenate([a[: int(600 * 2 * keep / (1 + keep))], rng.integers(0, 2**63, 600 - int(600 * 2 * keep / (1 + keep))).astype(np.uint64)])
        bits = int(np.bitwise_count(odd_sketch(minhash(np.unique(a))) ^ odd_sketch(minhash(np.unique(b)))).sum())
        assert bits <= most_differing_bits(0.8)
    assert len(shingle_hashes("a b c", 4)) == 1 and len(shingle_hashes("a b c d a b c d", 4)) == 4 and not len(shingle_hashes(" ", 4))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 201), (200, 202), (200, 203)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, **{i: 200 for i in range(200, 204)}}
    assert spanning_roots(np.array([3, 4]), np.array([4, 1]), 6).tolist() == [0, 1, 2, 1, 1, 5]


# --- 7 packing


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(0)
    for capacity in (12, 100):
        counts = collections.Counter(rng.integers(1, capacity + 1, 800).tolist())
        patterns = plan_packing(dict(counts), capacity)
        used = collections.Counter()
        for lengths, n in patterns:
            assert n > 0 and sum(lengths) <= capacity
            for x in lengths:
                used[x] += n
        least = -(-sum(k * n for k, n in counts.items()) // capacity)
        assert used == counts and least <= sum(n for _, n in patterns) <= 1.12 * least + 1
    table = np.zeros(11, np.int64)
    table[[7, 2, 1, 5, 10, 3]] = [2, 2, 2, 2, 3, 1]
    exact = exact_patterns(table, 10)
    assert all(sum(p) == 10 for p, _ in exact) and {p: n for p, n in exact}[10,] == 3 and {p: n for p, n in exact}[5, 5] == 1
    assert best_fit_patterns(np.array([0, 0, 5, 0, 0]), 4) in ([((2, 2), 2), ((2,), 1)], [((2,), 1), ((2, 2), 2)])
    with pytest.raises(ValueError):
        plan_packing({0: 1}, 10)


def test_packing(spark, odd):
    rows = [r["text"] for r in odd.collect()]
    path = Q.WORD_TOKENIZER
    packed = pack_documents(odd, path).cache()
    got = packed.toPandas()
    words = WordTokens(path)
    sizes = [len(words.whole(t or "")) // 4 + 1 for t in rows]
    assert got["length"].sum() == sum(sizes) and len(got) == sum(-(-n // 4096) for n in sizes) and got["sequence_id"].nunique() == -(-sum(sizes) // 4096)
    for _, places in got.sort_values("offset").groupby("sequence_id"):
        assert (places["offset"] == places["length"].cumsum() - places["length"]).all() and places["length"].sum() <= 4096
    assert pack_documents(odd.where("false"), path).count() == 0
    unique = odd.where("doc_id IN (1, 4, 5, 7)")
    one = pack_documents(unique, path).cache()
    sequences = packed_sequences(token_pieces(unique, path), one).collect()
    texts = {r["doc_id"]: words.whole(r["text"] or "") + b"\1\0\0\0" for r in unique.collect()}
    want = collections.defaultdict(list)
    for r in one.collect():
        want[r["sequence_id"]].append((r["offset"], texts[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]))
    assert {r["sequence_id"]: bytes(r["ids"]) for r in sequences} == {k: b"".join(b for _, b in sorted(v)) for k, v in want.items()}


ODD_TEXTS = ["", " ", "  a  b ", "a\n\nb \n c", "\n", "x\n", "\x00x\x85y\xa0z　w", "ﬁ İstanbul ΣΑΣ ς", "it's WE'LL 'sam <|endoftext|> </w> ²³¼½ª", "你好 😀 " * 5, "▁▁x▁", "x" * 3000, "ß ẞ ǅ ŉ \xad ᾈ", "don’t 123 4.5 a_b __", "\t\r\n\x0b\x0c\x1c tail ", "aa" * 200 + " b", "<s> <unk> <0x41>", "Hello, world. (x) naïve"]


def test_word_tokens_agree_with_the_library(spark, sf_dir):
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = WordTokens(Q.WORD_TOKENIZER)
    assert words.encode(texts) == [words.whole(t) for t in texts] == words.encode(texts)


def test_packing_query_against_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.WORD_TOKENIZER)
    got = Q.op7_packing(spark, sf_dir).toPandas().sort_values(["doc_id", "piece"])
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((r["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert list(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, places in got.sort_values("offset").groupby("sequence_id"):
        assert (places["offset"] == places["length"].cumsum() - places["length"]).all() and places["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


def test_words_of_segments_and_of_equal_hashes(monkeypatch):
    from passagework.llm import word_runs, word_tokens

    words = WordTokens(Q.WORD_TOKENIZER)
    texts = ["it's 'round the\nword's end " * 30, "plain words " * 100, "", "x" * 400 + " tail"]
    want = [words.whole(t) for t in texts]
    monkeypatch.setattr(word_tokens, "SEGMENT", 60)
    assert words.encode(texts) == want
    values = np.random.default_rng(0).integers(0, 2**63, (2, 8), np.int64).astype(np.uint64)
    values[0] = 0  # all first hashes are equal
    first, of = word_runs.Runs(values[:, [1, 2, 1, 3, 2]]).distinct(np.arange(5), np.arange(1, 6))
    assert [int(first[i]) for i in of] == [0, 1, 0, 3, 1]


# --- 8 languages


def test_language_filter_has_no_false_negatives():
    rng = np.random.default_rng(6)
    keys, masks = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 8, 5000).astype(np.uint64)
    model = LanguageFilter.build(["a", "b", "c"], keys, masks)
    assert (model.lookup(keys) & masks.astype(model.slots.dtype) == masks.astype(model.slots.dtype)).all()
    wrong = model.lookup(rng.integers(0, 2**63, 20000).astype(np.uint64))
    for i in range(3):
        assert abs((wrong >> i & 1).mean() - model.false_positives[i]) < 0.01


def test_language_id(spark, odd):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    got = Q.op8_language_id(spark, base).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    model = train_language_id(docs)
    rows = odd.unionByName(documents(spark, [(20, "123 ?!")])).select("doc_id", predict_language(model, F.col("text")).alias("p")).collect()
    assert {r["doc_id"] for r in rows if r["p"]["lang"] == "und"} == {1, 2, 3, 20} and all(r["p"]["score"] == 0 for r in rows if r["p"]["lang"] == "und")
    marks = documents(spark, [(30, "\u0301\u0302"), (31, "e\u0301 te\u0301 la maison")]).select("doc_id", predict_language(model, F.col("text")).alias("p")).collect()
    assert {r["doc_id"]: r["p"]["lang"] != "und" for r in marks} == {30: False, 31: True}
    nothing = train_language_id(docs.where("false"))
    assert docs.limit(3).select(predict_language(nothing, F.col("text")).alias("p")).where("p.lang = 'und'").count() == 3


def test_language_of_a_single_document(spark):
    english, french = "the cat and the dog went over to the old house near the river", "les enfants jouent dans le jardin avec leurs amis pendant que les parents parlent"
    docs = spark.createDataFrame([(i, english + f" {'abcdefgh'[i % 8]}", "en") for i in range(50)] + [(100, french, "fr")], "doc_id long, text string, lang string")
    model = train_language_id(docs, held_out=-1)
    asked = spark.createDataFrame([(1, "les parents jouent avec leurs enfants dans le jardin"), (2, "the old dog and the cat")], "doc_id long, text string")
    assert {r[0]: r[1]["lang"] for r in asked.select("doc_id", predict_language(model, F.col("text"))).collect()} == {1: "fr", 2: "en"}


def test_language_scores_against_ngram_sets(spark):
    """The filters give what sets of the same n-grams give, but for their false positives."""
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2}

    def ngrams(text):
        low = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        return [low[i : i + n] for n in (3, 4) for i in range(len(low) - n + 1) if " " not in low[i + 1 : i + n - 1]]

    per, n_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for i, r in texts.items():
        if i not in held:
            per[r["lang"]].update(set(ngrams(r["text"])))
            n_docs[r["lang"]] += 1
    share = {k: {g: n / n_docs[k] for g, n in c.items() if n >= min(2, math.ceil(0.05 * n_docs[k])) and n / n_docs[k] >= 0.004} for k, c in per.items()}
    top = collections.Counter()
    for c in share.values():
        for g, x in c.items():
            top[g] = max(top[g], x)
    chosen = {k: {g for g, x in c.items() if x >= 0.35 * top[g]} for k, c in share.items()}
    assert len(set().union(*chosen.values())) <= 12_000 * len(chosen)
    got = {r["doc_id"]: r for r in Q.op8_language_id(spark, base).collect()}
    agreed = 0
    for i, r in texts.items():
        found = ngrams(r["text"])
        scores = {k: sum(g in chosen[k] for g in found) / max(1, len(found)) for k in sorted(chosen)}
        best = max(scores, key=scores.get)
        agreed += got[i]["lang_pred"] == best and abs(got[i]["score"] - scores[best]) < 0.03
    assert agreed >= 0.98 * len(texts)


# --- 9 embeddings


def links_by_hand(rows, cosine):
    ok = [(i, v, k) for i, v, k in rows if v and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, root = collections.Counter(), {i: i for i, _, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, v, k) in enumerate(ok):
        for j, w, m in ok[:x]:
            if k == m and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i, _, _ in rows}


def test_embedding_duplicates_against_brute_force(spark, monkeypatch):
    from passagework.llm import embedding_dups as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(12)
    rows = []
    for g in range(25):
        centre = rng.normal(size=16)
        for _ in range(60 if g == 0 else 4):
            rows.append([len(rows), (centre + rng.normal(size=16) * rng.choice([0, 0.1, 0.2])).tolist(), int(g % 3)])
    rows += [[1000, None, 1], [1001, [0.0] * 16, 1], [1002, [float("nan")] * 16, 1], [1003, [None] + [1.0] * 15, 1], [1004, rows[0][1], None], [1005, [], 1], [1006, [1.0, 0.0], 1], [1007, [2.0, 0.0], 1], [1008, [2 * x for x in rows[0][1]], 0], [1009, [1e300, 1e300], 2], [1010, [1e-300, 1e-300], 2]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, Class int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_duplicates(df).collect()}
    want = links_by_hand(rows, 0.98)
    want[1009], want[1010] = (1, 1009), (1, 1009)  # plain products over- and underflow here
    assert got == want
    assert embedding_duplicates(df.where("false")).count() == 0


def test_probes_reach_every_neighbour():
    rng = np.random.default_rng(13)
    rows = rng.normal(size=(3000, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    quantiser = ProductQuantiser.fit(rows[:1000], 16)
    home, codes, error = quantiser.encode(rows)
    reach = quantiser.probes(rows, home, 0.3)
    a, b = np.nonzero(np.triu(np.linalg.norm(rows[:, None] - rows[None, :], axis=2) <= 0.3, 1) if len(rows) <= 500 else np.triu(2 - 2 * rows @ rows.T <= 0.09, 1))
    low, high = np.where(home[a] <= home[b], a, b), np.where(home[a] <= home[b], b, a)
    assert len(a) > 100 and ((home[low] == home[high]) | reach[low, home[high]]).all()
    for x, y in list(zip(low, high, strict=True))[:200]:
        assert math.sqrt(quantiser.distances(rows[[x]], home[y], codes[[y]])[0, 0]) <= 0.3 + error[y] + 1e-6


# --- 10 pieces


def test_pieces_agree_with_the_library(spark, sf_dir):
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    encoder = PieceEncoder(Q.PIECE_MODEL)
    want = encoder.library.encode(texts)
    for _ in range(2):
        assert [np.frombuffer(b, np.int32).tolist() for b in encoder.encode(texts)] == want
    assert encoder.checked and not encoder.differing
    for word in ("▁internationalization", "▁" + "ab" * 300, "▁x😀y"):
        assert encoder.merge(word) == encoder.library.encode(word[1:])


def test_piece_round_trip(spark, odd):
    library = PieceEncoder(Q.PIECE_MODEL).library
    rows = encoded_and_decoded(odd, Q.PIECE_MODEL).collect()
    both = odd.select("doc_id", encode_pieces(Q.PIECE_MODEL, F.col("text")).alias("ids")).withColumn("decoded", decode_pieces(Q.PIECE_MODEL, F.col("ids"))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, both))
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(library.encode(r["text"] or ""))
    assert all(r["ids"] in texts[r["doc_id"]] and r["decoded"] == library.decode(r["ids"]) for r in rows)
    digests = {r["doc_id"]: r for r in Q.op10_pieces(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        ids = library.encode(r["text"])
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digests[r["doc_id"]]["n_tokens"] == len(ids)


def test_piece_ids_are_the_agendas_and_differing_ones_raise():
    encoder = PieceEncoder(Q.PIECE_MODEL)
    assert np.frombuffer(encoder.encode(["two  spaces"])[0], np.int32).tolist() == encoder.library.encode("two  spaces")

    class Other:
        def encode(self, text, **options):
            return [[1] for _ in text] if isinstance(text, list) else [1]

    encoder.library = Other()
    for text in ("two  spaces here", "unmetword"):
        with pytest.raises(ValueError, match="other ids"):
            encoder.encode([text])


def test_decoded_digests_against_the_library(spark, sf_dir):
    library = PieceEncoder(Q.PIECE_MODEL).library
    got = {r["doc_id"]: r for r in Q.op10_pieces(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "")
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest() and got[r["doc_id"]]["n_tokens"] == len(ids)


def test_quality_of_blank_texts_is_learned(spark):
    good, bad = "This is a whole sentence of plain words, and it ends here.\n", "$$ 11 %% BUY >>> 22\n"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(100 + i, (None, "", " \n")[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100 + i, 0) for i in range(30)] + [(999, 1)], "doc_id long, quality int")
    for per_class in (3000, 10):
        model = train_quality(docs, labels, held_out=-1, per_class=per_class)
        assert model.blank == pytest.approx(31 / 91 / 31)
    assert model.score(["", "\n "]).tolist() == [model.blank] * 2


def test_samples_are_bounded_by_ids(spark):
    from passagework.llm.sampling import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    found = labelled_sample(docs, labels, "quality", per_class=100, held_out=-1, n_folds=5).collect()
    assert sorted((r["doc_id"], r["text"], r["label"]) for r in found) == [(1, "text 0", 1), (2, "b", 0), (3, "", 0)]


def test_toxicity_of_few_labels_and_of_long_texts(spark, monkeypatch):
    from passagework.llm import toxicity_mil as module

    rows = [(i, f"this is a vile thing {i}" if i % 2 else f"this is a nice thing {i}") for i in range(12)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    model = train_toxicity(docs, labels, held_out=-1)
    assert score_text(model, "a vile one", 0.5)[0] > 0.5 > score_text(model, "a nice one", 0.5)[0]
    text = "Nice words here. " * 40 + "A vile sentence! " + "It is nice\n" * 40 + "vile at the end"
    whole = score_text(model, text, 0.5)
    monkeypatch.setattr(module, "SEGMENT", 100)
    cut = score_text(model, text, 0.5)
    assert cut[0] == pytest.approx(whole[0]) and [(s["start"], s["end"]) for s in cut[1]] == [(s["start"], s["end"]) for s in whole[1]]
    assert [text[s["start"] : s["end"]] for s in cut[1]] == ["A vile sentence!", "vile at the end"]


def test_quality_learns_from_long_documents(spark):
    good, bad = "This is a whole sentence of plain words, and it ends here.\n", "$$ 11 %% BUY >>> 22\n"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * 450) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = train_quality(docs, labels, held_out=-1)
    scores = model.score([good * 3, bad * 3])
    assert scores[0] > 0.8 and scores[1] < 0.2
