"""Mixing sources to target weights from fixed-length token blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, materialise, spread, table

#: Words in a block, slots in an output shard, and stretches into which each source's documents are dealt for packing.
BLOCK, SHARD_SLOTS, STRETCHES = 128, 4096, 1024
#: Weights by code point order of the source, repeating; share of all words to take; most times a source is read.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SEED = 42
#: The draw decides how much of a source is taken, up to this share of its target more or less.
TOLERANCE = 0.02


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Targets in proportion to weights with sum ``total``, none above ``most`` times its size.

    What a capped source can't take is shared among the others by weight, until none is above its cap.
    """
    target, capped = [0.0] * len(sizes), [n == 0 for n in sizes]
    while True:
        rest = total - sum(t for t, c in zip(target, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        over = False
        for i, n in enumerate(sizes):
            if not capped[i]:
                target[i] = rest * weights[i] / weight
                over |= target[i] > most * n
        if not over:
            return target
        for i, n in enumerate(sizes):
            if not capped[i] and target[i] > most * n:
                target[i], capped[i] = most * n, True


def _round(right: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    x = (right + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) & np.uint64((1 << bits) - 1)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a Feistel network whose walk is cut to the range."""
    if n <= 1:
        return np.zeros_like(index)
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(4):
            round_key = np.uint64((key * 0x100000001B3 + r * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
            left, right = right, left ^ _round(right, round_key, bits)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def word_count(text: str = "text") -> F.Column:
    """Maximal runs of anything but the six ASCII white-space characters; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan_sources(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """Per source: sid (place by code point, null last), source_size, target, n_blocks, and what is taken whole.

    The sources' names and totals come to the driver (a row for each source, never one for each document).
    """
    rows = [(r.source, r.n or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).toLocalIterator()]
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    targets = water_fill([n for _, n in rows], weight, share * sum(n for _, n in rows), most)
    out = [(s, i, n, t, -(-n // block), min(int(t), int(most * n))) for i, ((s, n), t) in enumerate(zip(rows, targets))]
    return sized.sparkSession.createDataFrame(out, "source string, sid int, source_size long, target double, n_blocks long, words long")


def _packed(sized: DataFrame, block: int) -> DataFrame:
    """sid, block index, and the words of each document in it, as (first, n) within the block.

    Documents lie in pseudorandom order, end to end. Where each begins comes from sums over stretches and
    then within a stretch, so that no task reads a whole source.
    """
    dealt = sized.where("size > 0").withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("stretch", F.pmod(F.col("h"), F.lit(STRETCHES)))
    sums = dealt.groupBy("sid", "stretch").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("sid").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("sid", "stretch", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.sum("size").over(W.partitionBy("sid", "stretch").orderBy("h", "doc_id", "size", "uid").rowsBetween(W.unboundedPreceding, -1))
    placed = dealt.withColumn("at", F.coalesce(own, F.lit(0))).join(starts, ["sid", "stretch"]).withColumn("at", F.col("at") + F.col("base"))
    last = F.col("at") + F.col("size") - 1
    cut = placed.select("sid", "uid", "doc_id", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor(last / block))).alias("block"))
    first = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    return cut.select("sid", "block", "uid", "doc_id", first.alias("first"), (end - first).alias("n"), F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).alias("doc_word"))


def _before(rows: DataFrame, value: str) -> DataFrame:
    """The rows (shard, sid, ...) with ``before``: the sum of ``value`` over the source's earlier shards.

    By stretches of 1024 shards first, so that no task reads all shards of a source.
    """
    rows = rows.withColumn("part", F.floor(F.col("shard") / 1024))
    earlier = lambda c, by, order: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("sid", "part").agg(F.sum(value).alias("t")).select("sid", "part", earlier("t", ["sid"], "part").alias("base"))
    return rows.withColumn("own", earlier(value, ["sid", "part"], "shard")).join(sums, ["sid", "part"]).withColumn("before", F.col("own") + F.col("base")).drop("own", "base", "part")


def _drawn(spark: SparkSession, quota: list[int], seed: int) -> DataFrame:
    """shard, sid, n: what each output shard draws of each source.

    A shard of SHARD_SLOTS slots (the last has the rest) draws its sources' counts from a multinomial over the
    targets' shares, by a generator seeded with the shard's number.
    """
    total = sum(quota)
    share = np.array(quota) / total

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                counts = np.random.default_rng([seed, k]).multinomial(min(SHARD_SLOTS, total - k * SHARD_SLOTS), share)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), k)), pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts.astype(np.int64))], ["shard", "sid", "n"])

    return spark.range(-(-total // SHARD_SLOTS)).transform(arrow_map, draw, "shard long, sid int, n long")


def _settled(quota: list[int], most: list[int], drawn: list[int], tolerance: float) -> list[int]:
    """Slots of each source: what was drawn, within ``tolerance`` of the quota and never above ``most``.

    What this cuts off or adds goes to or comes from the others, in order, within their bounds; so the sum stays.
    """
    low = [q - int(tolerance * q) for q in quota]
    high = [min(q + int(tolerance * q), m) for q, m in zip(quota, most)]
    out = [min(max(d, a), b) for d, a, b in zip(drawn, low, high)]
    rest = sum(quota) - sum(out)
    for i in range(len(out)):
        step = min(rest, high[i] - out[i]) if rest > 0 else max(rest, low[i] - out[i])
        out[i] += step
        rest -= step
    return out


def _counts(drawn: DataFrame, got: list[int], wanted: list[int]) -> DataFrame:
    """shard, sid, n: how many slots of each output shard a source fills: as drawn, but for what is above or below ``wanted``.

    What a source has drawn above it in all (``got``) goes, spread over its shards in proportion to what each
    drew, to sources below theirs, within the same shards: so every shard stays as long as it is.
    """
    over = [(i, g, g - w) for i, (g, w) in enumerate(zip(got, wanted)) if g > w]
    if not over:
        return drawn.where("n > 0")
    bases = np.concatenate([[0], np.cumsum([e for _, _, e in over])]).tolist()
    under, at = [], 0
    for i, (g, w) in enumerate(zip(got, wanted)):
        if w > g:
            under.append((i, at, at + w - g))
            at += w - g
    excess = drawn.sparkSession.createDataFrame([(i, d, e, b) for (i, d, e), b in zip(over, bases)], "sid int, drawn long, excess long, base long")
    rows = _before(drawn, "n").join(excess, "sid", "left")
    given = lambda c: F.expr(f"coalesce(({c}) * excess div drawn, 0)")
    rows = rows.withColumn("first", given("before")).withColumn("give", given("before + n") - F.col("first"))
    # what is given is numbered through all sources above their quota, and what is lacking through all below
    need = F.array(*[F.struct(F.lit(i).alias("to"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, a, b in under])
    moved = rows.where("give > 0").select("shard", (F.col("base") + F.col("first")).alias("x"), (F.col("base") + F.col("first") + F.col("give")).alias("y"), F.explode(need).alias("u"))
    moved = moved.select("shard", F.col("u.to").alias("sid"), (F.least("y", "u.b") - F.greatest("x", "u.a")).alias("n")).where("n > 0")
    return rows.select("shard", "sid", (F.col("n") - F.col("give")).alias("n")).unionByName(moved).groupBy("shard", "sid").agg(F.sum("n").alias("n")).where("n > 0")


def _slots(plan: DataFrame, block: int, seed: int, draw: int, most: float) -> DataFrame:
    """shard, sid, slot, block, words: one row for each slot of the mix; a source's slots are numbered through the shards."""
    rows = sorted(plan.toLocalIterator(), key=lambda r: r.sid)
    quota = [_quota(r.words, r.source_size, r.n_blocks, block) for r in rows]
    spark = plan.sparkSession
    if not sum(quota):
        return spark.createDataFrame([], "shard long, sid int, slot long, block long, words int")
    drawn = _drawn(spark, quota, draw)
    # a row for each source comes to the driver
    totals = {r.sid: r.n for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).toLocalIterator()}
    got = [totals.get(i, 0) for i in range(len(rows))]
    wanted = _settled(quota, [_quota(int(most * r.source_size), r.source_size, r.n_blocks, block) for r in rows], got, TOLERANCE)
    due = [_due(r.words, w - q, w, int(most * r.source_size), r.source_size, r.n_blocks, block) for r, q, w in zip(rows, quota, wanted)]
    runs = _before(materialise(_counts(drawn, got, wanted), "counts"), "n").select("shard", "sid", F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("end"))
    sizes = [(r.source_size, r.n_blocks, d) for r, d in zip(rows, due)]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size, blocks, words = sizes[r["sid"]]
                slot = np.arange(r["start"], r["end"])
                at, taken = _taken(slot, size, blocks, words, block, seed * 1_000_003 + r["sid"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), r["shard"])), pa.array(np.full(len(slot), r["sid"], np.int32)), pa.array(slot), pa.array(at), pa.array(taken.astype(np.int32))], ["shard", "sid", "slot", "block", "words"])

    # a shard's slots are made from a few numbers each: dealt anew, as these come in few partitions
    return spread(runs, "shard", "sid").transform(arrow_map, fill, "shard long, sid int, slot long, block long, words int")


def _quota(words: int, size: int, blocks: int, block: int) -> int:
    """Slots that a source needs: whole passes over its blocks, and one slot more than could hold the rest."""
    if not size:
        return 0
    passes, rest = divmod(words, size)
    return passes * blocks + (min(blocks, rest // block + 2) if rest else 0)


def _due(words: int, more: int, slots: int, most: int, size: int, blocks: int, block: int) -> int:
    """Words that a source gives with ``more`` slots than its ``words`` need, ``slots`` in all: as many as these hold, at most ``most``."""
    out = max(0, min(words + more * block, most))
    while out and _quota(out, size, blocks, block) > slots:
        out = max(0, out - block)
    return out


def _taken(slot: np.ndarray, size: int, blocks: int, words: int, block: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each slot, and how many of its words (from its first on) the mix takes.

    Slot j is place j mod blocks of pass j div blocks. Every block has ``block`` words but the last; in the
    unfinished pass the words before a place tell how many are still due.
    """
    passes, rest = divmod(words, size)
    turn, place = np.divmod(slot, blocks)
    at = permuted(place, blocks, key)
    lack = blocks * block - size
    length = np.where(at == blocks - 1, block - lack, block)
    # where the short last block comes in the order
    if lack and rest:
        short = _place_of(blocks - 1, blocks, key)
        before = place * block - np.where(place > short, lack, 0)
    else:
        before = place * block
    return at, np.where(turn < passes, length, np.clip(rest - before, 0, length))


def _place_of(value: int, n: int, key: int) -> int:
    """The index whose permuted value is ``value``: following the cycle from it leads there."""
    if n <= 1:
        return 0
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits)
    x = np.array([value], np.uint64)
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            round_key = np.uint64((key * 0x100000001B3 + r * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
            left, right = right ^ _round(left, round_key, bits), left
        x = left << half | right
        if int(x[0]) < n:
            return int(x[0])


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a number for each row, written once: the numbers tell equal rows apart."""
    return materialise(docs.select("doc_id", "source", word_count().alias("size"), F.monotonically_increasing_id().alias("uid")), "sizes")


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    # one row for each source; the optimiser broadcasts it only below its own threshold
    return sized.join(plan.select(F.col("source").alias("s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mixed_blocks(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED, draw: int | None = None) -> DataFrame:
    """The mix itself: shard, slot, source, block, and the spans (doc_id, first word, words) that fill the block."""
    sized = _sized(docs)
    plan = plan_sources(sized, weights, share, most, block)
    slots = _slots(plan, block, seed, seed if draw is None else draw, most)
    pieces = _packed(_with_plan(sized, plan), block)
    span = F.struct("first", "doc_id", "doc_word", "n")
    filled = pieces.groupBy("sid", "block").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return slots.hint("merge").join(filled, ["sid", "block"]).join(plan.select("sid", "source"), "sid").select("shard", "slot", "source", "block", "words", "spans")


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED, draw: int | None = None) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), slots, first_shard.

    A source's words are packed into blocks of ``block``; every pass over them follows a pseudorandom index
    permutation, so a word is taken at most ``most`` times (rounded up). The multinomial draws (seeded by ``draw``,
    else by ``seed``) decide how many slots a source has in each shard, and so how many of its words are taken:
    its target, give or take TOLERANCE of it and two blocks, and never more than ``most`` times its size. The
    more slots, the nearer the draws come by themselves. ``slots`` counts the slots that hold some of a document's
    words, ``first_shard`` is the first such shard (null where nothing is taken).

    Null text has no words; null is a source of its own, last; sources without words get a target of 0; empty
    input gives an empty result; equal rows, null ids too, are packed one after the other. Reruns agree.
    """
    sized = _sized(docs)
    plan = plan_sources(sized, weights, share, most, block)
    known = _with_plan(sized, plan)
    used = _slots(plan, block, seed, seed if draw is None else draw, most).where("words > 0").groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("words", "shard"))).alias("takes"))
    # the slots come from a few numbers each, so their size is estimated far too low to let it decide on a broadcast
    pieces = _packed(known, block).join(used.hint("merge"), ["sid", "block"])
    here = F.filter("takes", lambda t: t["words"] > F.col("first"))
    got = F.aggregate("here", F.lit(0).cast("long"), lambda acc, t: acc + F.least(t["words"].cast("long") - F.col("first"), F.col("n")))
    told = pieces.select("uid", "first", "n", here.alias("here")).where(F.size("here") > 0)
    told = told.select("uid", got.alias("got"), F.size("here").alias("slots"), F.array_min(F.transform("here", lambda t: t["shard"])).alias("shard"))
    taken = told.groupBy("uid").agg(F.sum("got").alias("taken"), F.sum("slots").alias("slots"), F.min("shard").alias("first_shard"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return known.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", count("taken"), count("slots"), "first_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
