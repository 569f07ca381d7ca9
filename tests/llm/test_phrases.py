"""Phrase collocations against counting by hand: heavy words, stretches, piece ends, unary paths, exact arithmetic."""

from __future__ import annotations

import collections
import random
import re

import pytest

from siteprism.llm import phrases

SCHEMA = "text string, lang string, n long, gram string"


def by_hand(rows, least, top=phrases.TOP):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, 6):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        held = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = collections.defaultdict(list)
        for g, a in held.items():
            for j in range(2, len(g)):
                for i in range(len(g) - j + 1):
                    inside[g[i : i + j]].append(a)
        found = []
        for g, a in held.items():
            if not any(100 * b >= 100 * a for b in inside[g]):
                score, _, left, right = min((1000 * a * total[lang] // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, g.decode(), -a, left, right, total[lang], -s) for i, (s, a, g, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, texts=120):
    rng = random.Random(seed)
    words = ["the", "of", "é", "b\x01", "b", "B", "ab", "a", "日本", "x" * 40, *("w%d" % i for i in range(12))]
    common = ["the red fox ran over", "one two three four five six seven", "a b a b a b a b", "é é é é é é é"]
    out = []
    for i in range(texts):
        parts = [rng.choice(common) if rng.random() < 0.3 else " \t "[: rng.randint(1, 3)].join(rng.choices(words, [9, 7, 3, 2, 2, 2, 2, 2, 2, 1, *[1] * 12], k=rng.randint(1, 14))) for _ in range(rng.randint(1, 8))]
        out.append((rng.choice([" ", ". ", ",", "\n", "!?\r\n", " "]).join(parts), rng.choice(["en", "fr", None, "und"])))
    return [*out, (None, "en"), ("", "fr"), ("...", None), ("solo", "only"), (out[0][0], out[0][1]), ("long " * 3000 + "the red fox ran over " * 200, "en")]


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).collect())


@pytest.mark.parametrize(("stretch", "heavy"), [(1 << 20, 1024), (64, 8), (300, 10_000)])
def test_collocations(spark, monkeypatch, stretch, heavy):
    """Few and many heavy words, so that nodes are dealt to one task or several, and texts whole or in short stretches."""
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    monkeypatch.setattr(phrases, "HEAVY", heavy)
    rows = corpus(stretch)
    want = by_hand(rows, 4)
    assert len(want) > 100 and got(spark, rows, least=4) == want


def test_top_and_empty(spark):
    rows = corpus(9, 60)
    assert got(spark, rows, least=2, top=7) == by_hand(rows, 2, 7)
    assert got(spark, rows, least=10**6) == [] and got(spark, [], least=1) == []
    assert got(spark, [(None, None), ("", "en"), ("a", "en")], least=1) == []


def test_small_batches(spark, monkeypatch):
    """Nodes that run on over many batches of sorted rows."""
    rows = corpus(11, 80)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(spark, rows, least=3) == by_hand(rows, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_scores_are_exact(spark):
    """Products beyond 64 bits, as the plan multiplies and divides them."""
    a, n, left, right = 3 * 10**12 + 7, 9 * 10**13 + 1, 4 * 10**12 + 3, 5 * 10**12 + 11
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.selectExpr(f"({wide('a')} * {wide('n')} * cast(1000 as decimal(4, 0))) div ({wide('l')} * {wide('r')}) as s").first().s == 1000 * a * n // (left * right)


def test_stretches():
    text = ("one two, three four five six seven eight  nine\tten. " * 9).encode()
    for limit in (1, 7, 30, 1000):
        parts = list(phrases.stretches(text, limit))
        assert b"".join(p[:n] for p, n in parts) == text and all(text[sum(n for _, n in parts[:i]) :].startswith(p) for i, (p, _) in enumerate(parts))
    assert list(phrases.stretches(b"", 5)) == [(b"", 0)] and list(phrases.stretches(b"x" * 50, 5)) == [(b"x" * 50, 50)]
