"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

pytest.importorskip("passagework.llm")

from pyspark.sql import functions as F  # noqa: E402

from passagework.llm import conversation_repair as C  # noqa: E402
from passagework.llm import queries as Q  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def hurt(rows):
    """Rows after damage, in order."""
    out = []
    for conv_id, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))


def repaired(rows):
    """The row of one conversation, by trying every edit."""
    sys.setrecursionlimit(20_000)
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    then = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(at, state, inserts):
        ways = []
        if at == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts:
            for role in ("user", "assistant"):
                if (state, role[0]) in then:
                    cost, audit, out = best(at, then[state, role[0]], inserts - 1)
                    ways.append((cost + 2, "I" + audit, (f"{role}:", *out)))
        if at < len(rows):
            _, role, text = rows[at]
            cost, audit, out = best(at + 1, state, 2)
            ways.append((cost + 3, "D" + audit, out))
            if faults[at] not in ("blank", "duplicate"):
                for edit, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if (state, new[:1]) in then:
                        cost, audit, out = best(at + 1, then[state, new[:1]], 2)
                        ways.append((cost + 2 * (edit == "R") + (faults[at] == "truncated"), edit + audit, (f"{new}:{text}", *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 2)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def compare(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in Q.op13_conversations(spark, str(tmp_path)).collect()}
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    assert set(got) == set(by_id)
    for conv_id, own in by_id.items():
        want = repaired(hurt(own))
        assert {k: got[conv_id][k] for k in want} == want, conv_id


def some_rows(n_conversations, longest, seed):
    rng, rows = random.Random(seed), []
    for conv_id in [*range(n_conversations), None]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Well", " \n", "", None, "A tie?  ", f"Text {rng.random()}."])
            rows.append((conv_id, rng.choice([turn, turn, turn, None, turn + 1]), role, text))
    return rows


def test_against_a_search_over_all_edits(spark, tmp_path):
    compare(spark, tmp_path, some_rows(400, 9, 1))


def test_conversation_over_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    long = [(7, i, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[i % 2], f"Turn {i}{rng.choice(['.', '.', ''])}") for i in range(400)]
    same = [(8, 5, "user", "Over and over.")] * 300
    rest = [(i, t, ("user", "assistant")[t % 2], f"Text {i} {t}.") for i in range(20, 60) for t in range(6)]
    parts = C.repair_conversations(C.damaged(spark.createDataFrame(long + same + rest, SCHEMA))).turns.select("part").distinct().count()
    assert parts > 1
    compare(spark, tmp_path, long + same + rest)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_signatures_share_their_ends():
    import pandas as pd

    made = []

    class Counted(C.Suffix):
        def __init__(self, *of):
            made.append(1)
            super().__init__(*of)

    original, C.Suffix = C.Suffix, Counted
    try:
        turned = sorted(["au", "aud", "aus", "aua", "uau"])
        out = pd.concat(C.solved(iter([pd.DataFrame({"turned": turned[:2], "behind": "", "starts": 1}), pd.DataFrame({"turned": turned[2:], "behind": "", "starts": 1})])))
    finally:
        C.Suffix = original
    assert len(made) == 8  # nine suffixes that aren't empty without what is shared: a, au, aua, aud, aus, u, ua, uau
    assert dict(zip(out["turned"], out["paths"].str[0].str["edits"]))["aus"] == "KKK"


def test_empty_table_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hello.", 3, "x")], SCHEMA + ", cost long, chunk string")
    repair = C.repair_conversations(rows)
    assert [r["audit"] for r in repair.conversations.collect()] == ["KI"]
    assert [t.asDict() for r in repair.turns.collect() for t in r["turns"]] == [{"role": "user", "text": "Hello."}, {"role": "assistant", "text": ""}]
    empty = C.repair_conversations(rows.where(F.lit(False)))
    assert empty.conversations.count() == 0 and C.turns_sha256(empty.turns).count() == 0
