"""Fill-in-middle: cuts, forms and round trips against plain Python."""

import hashlib

import pytest

pytest.importorskip("passagework.llm")

from passagework.llm import fill_in_middle as M  # noqa: E402

TEXTS = ["abc", "é😀x<y>", "a<P>b", "", None, "x" * 50, "<S", "P>", "<<M", ">", "\n", "word " * 100_000]


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_against_plain_python(spark):
    ids = [*range(30), -5, 10**15, None]
    docs = spark.createDataFrame([(i, t, 1, "y") for i in ids for t in TEXTS], "doc_id long, text string, n int, output string")
    docs = docs.unionByName(docs.limit(7))
    out = M.fill_in_middle(docs)
    rows = out.select("*", M.restored_text("output", "form").alias("back"), M.restored_sha256("output", "form").alias("restored")).collect()
    given = {(d["doc_id"], d["text"] or "") for d in docs.collect()}
    assert len(rows) == len(ids) * len(TEXTS) + 7
    for r in rows:
        assert (r["doc_id"], r["back"]) in given
        n, form, prefix, middle, output = expected(r["doc_id"], r["back"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, prefix, middle, output)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest() and r["restored"] == hashlib.sha256(r["back"].encode()).hexdigest()
        assert M.PieceTable((r["back"], M.SENTINELS), tuple(tuple(p) for p in r["pieces"])).rendered() == output
    assert sorted((str(r["doc_id"]), r["back"]) for r in rows) == sorted((str(d["doc_id"]), d["text"] or "") for d in docs.collect())
    assert M.fill_in_middle(docs.where("false")).count() == 0


def test_cutting_and_permuting():
    parts = M.PieceTable.of("abcdef").cut(2).cut(2).cut(6)
    assert parts.pieces == ((0, 0, 2), (0, 2, 0), (0, 2, 4), (0, 6, 0)) and parts.arranged((2, 1, 0, 3)).rendered() == "cdefab"
    for order in M.ORDERS.values():
        assert [order[i] for i in M.inverse(order)] == list(range(6))
    with pytest.raises(ValueError, match="no such place"):
        parts.cut(7)


def test_digest_streams_in_steps(monkeypatch):
    monkeypatch.setattr(M, "STEP", 3)
    table = M.transformed(1, "€uro sign and more", "1", 90, 20)[3]
    assert table.sha256() == hashlib.sha256(table.rendered().encode()).hexdigest()
