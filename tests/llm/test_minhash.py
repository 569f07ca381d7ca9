"""HyperMinHash near-duplicates against brute force: registers, estimates, families, crowds and small sets."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F
from test_llm import docs, groups, prose

from siteprism.llm import minhash



def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def by_hand(texts):
    sets = dict(enumerate(map(shingles, texts)))
    root = groups(sets, lambda a, b: alike(sets[a], sets[b]))
    return {(i, len(sets[i]), root[i], root[i] == i) for i in sets}


def test_registers():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    least = minhash.least_values(x)
    r = minhash.registers(np.array([[1 << 62, (1 << 62) | (1 << 61), 1, 0]], np.uint64))[0]
    assert r.tolist() == [0, 512, 62 << 10 | 512, 63 << 10]
    assert least.shape == (minhash.REGISTERS,) and (least < 1 << 63).sum() > 60
    one = minhash.filled(minhash.least_values(x[:1])[None].copy())
    assert len(np.unique(one)) == 1 and one[0, 0] < 1 << 63
    keys = minhash.band_keys(least[None].copy())
    assert keys.shape == (1, minhash.BANDS) and (keys >> 48).tolist() == [list(range(minhash.BANDS))]


def test_registers_agree_as_sets_do():
    """Small and large sets alike: registers of two sets agree with the probability of their similarity."""
    rng = np.random.default_rng(2)
    for n in (4, 10, 60, 400):
        same = []
        for _ in range(150):
            x = rng.integers(0, 1 << 64, n + n // 4, dtype=np.uint64)
            a, b = (minhash.registers(minhash.filled(minhash.least_values(s)[None])) for s in (x, x[:n]))
            same.append((a == b).mean())
        assert abs(np.mean(same) - n / len(x)) < 0.03 and min(same) > minhash.LIKELY


def test_estimate(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    rows = []
    for k in (0, 1000, 2000, 3000, 4000):
        a, b = x[:3000], x[k : k + 3000] if k <= 1000 else np.concatenate([x[k:], rng.integers(0, 1 << 64, k - 1000, dtype=np.uint64)])
        keys = minhash.band_keys(np.stack([minhash.least_values(a), minhash.least_values(b)]))
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        rows.append((keys[0].tolist(), keys[1].tolist(), len(a), len(b), want))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, n long, m long, want double")
    for r in df.withColumn("got", minhash.estimate(F.col("x"), F.col("y"), F.col("n"), F.col("m"))).collect():
        assert abs(r.got - r.want) < 0.18


def edited(rng, words, share):
    """The words with about that share of them replaced, in one stretch each."""
    out = list(words)
    for _ in range(int(share * len(words))):
        out[rng.randrange(len(out))] = prose(rng, 1)
    return out


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "One  two\tthree", "one two three four", "one two three four five", "é è ê ë", "É è ê ë", "word " * 60_000]
    for _ in range(12):
        base = prose(rng, rng.randint(30, 160)).split()
        texts += [" ".join(base), " ".join(base).upper(), "\n".join(base)]
        texts += [" ".join(edited(rng, base, s)) for s in (0.01, 0.02, 0.03, 0.05, 0.1)]
        cut = rng.randint(1, len(base) // 2)
        texts += [" ".join(base[cut:]), " ".join(base + prose(rng, cut).split())]
    for n in (4, 5, 6, 9):  # small sets at the limit: 4 of 5 shingles link, and 8 of 10
        ws = prose(rng, n + 4).split()
        texts += [" ".join(ws[: n + 3]), " ".join(ws[: n + 4]), " ".join(ws[1 : n + 4])]
    got = {tuple(r) for r in minhash.near_duplicates(docs(spark, texts).repartition(3)).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == by_hand(texts)


def test_crowds(spark):
    """A crowd that shares a passage, a drifting chain and a template with many copies: whole results, no pair for each two."""
    rng = random.Random(5)
    passage = prose(rng, 60).split()
    texts = [" ".join(prose(rng, rng.randint(5, 45)).split() + passage) for _ in range(60)]
    chain = prose(rng, 90).split()
    for _ in range(40):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 0.02)
    base = prose(rng, 80).split()
    texts += [" ".join(edited(rng, base, 0.02)) for _ in range(80)] + [" ".join(base)] * 30
    rng.shuffle(texts)
    got = {tuple(r) for r in minhash.near_duplicates(docs(spark, texts)).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == by_hand(texts)


def test_rows(spark):
    """Null ids, repeated rows and an empty table."""
    rows = [(None, "a b c d e", 1), (None, "x y z w", 1), (7, "a b c d e", 1), (7, "a b c d e", 1), (3, None, 1), (None, "", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(map(repr, (tuple(r) for r in minhash.near_duplicates(d).collect())))
    assert got == sorted(map(repr, [(None, 2, 7, False), (None, 1, None, True), (7, 2, 7, True), (7, 2, 7, True), (3, 0, 3, True), (None, 0, None, True)]))
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_query(spark, tiny):
    table = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    ids = [r.doc_id for r in table]
    want = {(ids[i], n, ids[c], k) for i, n, c, k in by_hand([r.text for r in table])}
    assert {tuple(r) for r in minhash.query(spark, tiny).select("doc_id", "n_shingles", "component_id", "kept").collect()} == want
