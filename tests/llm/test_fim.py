"""Fill-in-middle: piece tables, cuts, forms and restoring, and the given query against SQL's way of it."""

from __future__ import annotations

import hashlib
import random

import pytest

from siteprism.llm import fim

CASES = [None, "", "a", "ab", "é", "日本語のテキスト", "x" * 300_000, "🙂é" * 50_000, "has <S> in it", "<P", "P><", "<<SP>M>", "a\x00b", "same", "same"]


def by_hand(text, doc_id):
    """Plain slicing of Python strings, as the contract says it."""
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_piece_table():
    t = fim.PieceTable(b"0123456789")
    assert t.cut(3).cut(7).bytes() == b"0123456789" and [p.size for p in t.cut(3).cut(7).parts] == [3, 4, 3]
    assert [p.size for p in t.cut(0).cut(0).parts] == [0, 0, 10] and [p.size for p in t.cut(10).parts] == [10, 0]
    with pytest.raises(ValueError, match="beyond"):
        t.cut(11)
    for form in fim.ORDERS:
        made = t.cut(3).cut(7).arranged(form)
        assert made.restored(form).bytes() == b"0123456789" and made.buffers[0].obj is t.buffers[0].obj
        assert made.sha256() == hashlib.sha256(made.bytes()).hexdigest()
    with pytest.raises(ValueError, match="form"):
        fim.split_output(b"<S>a<P>b<M>c", "psm")


def test_round_trip_near_sentinels():
    """Parts that end or begin like sentinels don't make new ones where they touch."""
    rng = random.Random(1)
    for i in range(4000):
        text = "".join(rng.choice("<>PSM") for _ in range(rng.randint(1, 12)))
        form, *_, made = fim.rearrange(text.encode(), i)
        assert fim.restore(made.bytes(), form) == text.encode()


def test_fill_in_middle(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(CASES)] + [(None, "no id", None, 1), (3, "ab", "x", 3), (3, "ab", "x", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, form string, extra int")
    got = fim.fill_in_middle(d).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"}
    want = [(i, e, *by_hand(t, i), sha(by_hand(t, i)[-1]), sha(t or "")) for i, t, _, e in rows]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert fim.fill_in_middle(d.limit(0)).count() == 0
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), outputs=False).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert {r.form for r in fim.fill_in_middle(d, rate=0).collect()} == {"plain"}


def test_fill_in_middle_query(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in fim.query(spark, tiny).collect():
        *told, made = by_hand(texts[r.doc_id], r.doc_id)
        assert tuple(r)[1:] == (*told, sha(made), sha(texts[r.doc_id] or ""))
