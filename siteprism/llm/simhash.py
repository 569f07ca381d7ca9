"""SimHash fingerprints and near-duplicate components by anchor-point covering; five-word similarity beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, materialise, pieces, raw, spread, table
from siteprism.llm.components import connected_components

#: Words in a shingle, and differing bits up to which fingerprints link.
SHINGLE, THRESHOLD = 3, 2
#: Home fingerprints at an anchor up to which they are compared one by one; beyond it see ``_by_midpoint``.
HOMES = 16
#: The similarity by which ``keep_one`` also links: words in a shingle, and the least Jaccard index of the shingle sets.
WORDS, SIMILARITY = 5, (4, 5)
#: Bands of minimum hashes that find its candidates, and hashes in each: 0.8 alike share one with probability 0.9998.
BANDS, ROWS = 12, 3
#: Texts that share a band up to which each is compared with each; beyond it see ``crowded``.
CROWD = 16
#: Texts of crowded bands that hold a shingle up to which they meet by it; shingles in more are common, see ``_by_common_part``.
COMMON = 16

#: Bits of the map by which ``shingle_sets`` puts texts aside (8 MiB).
MARK_BITS = 1 << 26

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a UTF-8 text, repeats included."""
    ws = text.translate(_LOWER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), 42)], np.uint64)
    grams = map(b" ".join, zip(*(ws[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(ws) - size + 1)


def fingerprint(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """A bit is 1 if set in over half the hashes; no hashes give zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The columns of every row but its text, and fp (long, the unsigned value's bits); null text counts as empty."""
    rest = docs.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            fp = np.array([fingerprint(shingle_hashes(t, size)) for t in raw(batch.column("text"))], np.uint64)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.transform(arrow_map, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + ["fp long"]))


# The anchors: codewords of three binary Golay codes side by side. 64 bits are blocks of 22, 21 and 21, each
# short of 23 by bits held at zero. The code of length 23 is perfect: every word is within 3 of one codeword.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: The cyclic code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GOLAY = 0b101011100011


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    return rest


@cache
def _nearest_error() -> np.ndarray:
    """By syndrome, the one error of weight 3 or less."""
    errors = np.array([sum(1 << b for b in bits) for w in range(4) for bits in combinations(range(23), w)])
    out = np.zeros(2048, np.int64)
    out[_syndrome(errors)] = errors
    return out


def nearest(words: np.ndarray) -> np.ndarray:
    """The codeword within 3 bits of each 23-bit word."""
    return words ^ _nearest_error()[_syndrome(words)]


@cache
def _changes(width: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome of a word, the distinct xors from its codeword to the codewords of words ``flips`` or fewer bits away.

    Rows of offsets into one array of values: the codeword of a changed word depends on the syndrome alone.
    """
    error = _nearest_error()
    patterns = np.array([sum(1 << b for b in bits) for w in range(flips + 1) for bits in combinations(range(width), w)])
    moved = _syndrome(patterns)
    rows = []
    for s in range(2048):
        # word = codeword ^ error[s]; the changed word word ^ p has syndrome s ^ moved[p]
        rows.append(np.unique(error[s] ^ patterns ^ error[s ^ moved]))
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)


def _cross(index: np.ndarray, word: np.ndarray, width: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``index`` with their words: every row with each codeword reached by at most that many flips."""
    starts, values = _changes(width, flips)
    s = _syndrome(word)
    n = starts[s + 1] - starts[s]
    row = np.repeat(np.arange(len(word)), n)
    value = values[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[s][row]]
    return row, nearest(word)[row] ^ value


def _split(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in BLOCKS]


def _pack(codewords: list[np.ndarray]) -> np.ndarray:
    """Each codeword by its 12 upper bits, which tell it."""
    return (codewords[0] >> 11) | (codewords[1] >> 11) << 12 | (codewords[2] >> 11) << 24


def home_anchor(fp: np.ndarray) -> np.ndarray:
    """The nearest anchor (within the covering radius, 3 bits a block) of each fingerprint."""
    return _pack([nearest(w) for w in _split(fp)])


def anchors_near(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: every anchor that is home to any fingerprint within ``threshold`` bits.

    These are the anchors within covering radius plus threshold that a partner can have as its home.
    """
    parts = _split(fp)
    rows, found = [], []
    for flips in np.ndindex(*(threshold + 1,) * 3):
        if sum(flips) != threshold:
            continue
        row, words = np.arange(len(fp)), []
        for b, k in enumerate(flips):
            at, code = _cross(row, parts[b][row], BLOCKS[b][1], k)
            row, words = row[at], [w[at] for w in words] + [code]
        rows.append(row)
        found.append(_pack(words))
    key = np.unique(np.concatenate(rows).astype(np.int64) << 36 | np.concatenate(found))
    return key >> 36, key & ((1 << 36) - 1)


def _replicas(fps: DataFrame, threshold: int) -> DataFrame:
    """anchor, fp: each distinct fingerprint at every anchor near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for i in range(0, len(fp), 2048):
                row, anchor = anchors_near(fp[i : i + 2048], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i : i + 2048][row])], ["anchor", "fp"])

    return fps.transform(arrow_map, run, "anchor long, fp long")


def _homes(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(home_anchor(fp)), batch.column("fp")], ["anchor", "home"])

    return fps.transform(arrow_map, run, "anchor long, home long")


def _by_midpoint(fps: DataFrame) -> DataFrame:
    """Links among fingerprints at crowded anchors, without comparing pairs.

    Two fingerprints within 2 bits of each other share a point within 1 bit of both, and all that share a
    point are within 2 bits. So each fingerprint goes to its 65 points, and links to the least at each.
    """
    points = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    at = fps.select("fp", F.explode(points).alias("z"))
    least = at.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("z", "b")
    return at.join(least, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, threshold: int = THRESHOLD, homes: int = HOMES) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within ``threshold`` bits.

    Anchor-point covering: each fingerprint has its nearest anchor as home and is replicated to every anchor
    within covering radius plus threshold that can be a partner's home; homes and replicas meet by anchor. At
    an anchor with over ``homes`` home fingerprints the pairs would grow with the square, so all that reach it
    are linked by common midpoints instead (exact too, for a threshold of 2).
    """
    if threshold != 2 and homes < 1 << 40:
        raise ValueError("crowded anchors are linked by midpoints, which fit a threshold of 2")
    fps = spread(fps, "fp")
    home = _homes(fps)
    crowd = home.groupBy("anchor").agg(F.count("*").alias("n"))
    few = home.join(crowd.where(F.col("n") <= homes), "anchor").select("anchor", "home")
    # one row stands for a crowded anchor, so that one shuffle of the replicas serves both ways
    at = few.unionByName(crowd.where(F.col("n") > homes).select("anchor", F.lit(None).cast("long").alias("home")))
    near = (F.col("fp") > F.col("home")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= threshold)
    # there are over a hundred replicas of a fingerprint, which no size estimate knows of, so neither side is broadcast
    met = materialise(_replicas(fps, threshold).hint("merge").join(at, "anchor").where(F.col("home").isNull() | near).select("fp", "home"), "met")
    plain = met.where("home is not null").select(F.col("fp").alias("a"), F.col("home").alias("b"))
    return plain.unionByName(_by_midpoint(met.where("home is null").select("fp").distinct()))


_FACTORS = np.random.default_rng(6).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, step: int = 4096) -> np.ndarray:
    """A key for each band: its least hashes under as many multiplications. No hashes give no keys."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), step):
        least = np.minimum(least, (hashes[i : i + step, None] * _FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * _FACTORS[0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """The columns of every row but its text, fp, n (its distinct five-word shingles) and keys (its bands)."""
    rest = docs.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            fp, n, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), []
            for i, t in enumerate(raw(batch.column("text"))):
                fp[i] = fingerprint(shingle_hashes(t))
                shingles = np.unique(shingle_hashes(t, WORDS))
                n[i] = len(shingles)
                keys.append(band_keys(shingles))
            names = [c for c in batch.schema.names if c != "text"]
            added = [pa.array(fp.view(np.int64)), pa.array(n), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added], [*names, "fp", "n", "keys"])

    return docs.transform(arrow_map, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + ["fp long", "n long", "keys array<long>"]))


def marks(hashes: DataFrame) -> np.ndarray:
    """A map of MARK_BITS bits, set at the hashes (column th) modulo its size; pieces of 4 KiB come to the driver."""
    place = F.pmod("th", F.lit(MARK_BITS)) + 1
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toLocalIterator():
        piece = np.frombuffer(r.bits, np.uint8)
        out[(r.b - 1) * len(piece) : r.b * len(piece)] = piece[: len(out) - (r.b - 1) * len(piece)]
    return out


def shingle_sets(texts: DataFrame, wanted: DataFrame, size: int = WORDS, wide: bool = False) -> DataFrame:
    """th, shingles (distinct, by 32 bits of their hashes, or by all 64 if ``wide``) of the wanted ones (th) among rows of th and text.

    Texts that aren't wanted are put aside as they are read, by a map of bits of bounded size (some pass it that
    aren't wanted, more the more there are, and go in the join); so no text is shuffled, and a copy once a task.
    """
    held = texts.sparkSession.sparkContext.broadcast(marks(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            low = batch.column("th").to_numpy() & (MARK_BITS - 1)
            for part in pieces([batch.filter(pa.array((held.value[low >> 3] >> (low & 7) & 1).astype(bool)))], "text"):
                new = [i for i, h in enumerate(part.column("th").to_pylist()) if not (h in seen or seen.add(h))]
                part = part.take(pa.array(new, pa.int64()))
                sets = [np.unique(shingle_hashes(t, size).astype(kept)).view(signed) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("th"), pa.array(sets, pa.list_(pa.from_numpy_dtype(signed)))], ["th", "shingles"])

    kept, signed = (np.uint64, np.int64) if wide else (np.uint32, np.int32)
    sets = texts.select("th", "text").transform(arrow_map, run, f"th long, shingles array<{'long' if wide else 'int'}>")
    return sets.join(wanted, "th", "left_semi").dropDuplicates(["th"])


def candidates(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that share a band and could be alike by their numbers of shingles, and the rows of crowded bands.

    The first has a, fp_a, b, fp_b. In bands of up to ``CROWD`` texts all meet. In larger ones every text meets
    the one that shares its bands with most others (an original is shared by all its copies), which joins most
    of a family without a pair for each two; the rest is left to ``crowded``.
    """
    texts = sketches.where("n > 0").select("th", "fp", "n", "keys").dropDuplicates(["th"])
    at = materialise(texts.select("th", "fp", "n", F.explode("keys").alias("key")), "bands")
    # written first: a join of two plain shuffles is one in which adaptive execution splits a crowded band's rows
    size = materialise(at.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = materialise(at.join(size, "key"), "shared")
    few = shared.where(F.col("size") <= CROWD)
    many = shared.where(F.col("size") > CROWD)
    degree = many.groupBy("th").agg(F.sum("size").alias("degree"))
    top = many.join(degree, "th").groupBy("key").agg(F.max(F.struct("degree", "th", "fp", "n")).alias("top"))
    top = top.select("key", *(F.col(f"top.{c}").alias(f"{c}_b") for c in ("th", "fp", "n")))
    other = few.select("key", *(F.col(c).alias(f"{c}_b") for c in ("th", "fp", "n")))
    met = few.join(other, "key").where("th > th_b").unionByName(many.join(top, "key").where("th <> th_b"))
    low, high = SIMILARITY
    met = met.where((F.least("n", "n_b") * high >= F.greatest("n", "n_b") * low) & (F.col("fp") != F.col("fp_b")))
    return met.select(F.col("th").alias("a"), F.col("fp").alias("fp_a"), F.col("th_b").alias("b"), F.col("fp_b")).distinct(), many.select("key", "th", "fp")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the fingerprints of those pairs whose shingle sets are alike enough."""
    first, second = sets.select(F.col("th").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("th").alias("b"), F.col("shingles").alias("y"))
    low, high = SIMILARITY
    common = F.size(F.array_intersect("x", "y")) * (low + high)
    alike = pairs.join(first, "a").join(second, "b").where(common >= (F.size("x") + F.size("y")) * low)
    return alike.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def crowded(many: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """a, fp_a, b, fp_b: further pairs of texts of crowded bands that could be alike, which connect all that are.

    A band whose texts ``known`` links all connect needs no more. For the texts of the others, shingles are put in
    one order, rarest first. The first shingle that two texts alike enough share is among the n - ceil(0.8 n) + 1
    first of either (its prefix). Where that shingle is in COMMON texts at most, the two meet by it. Where it is in
    more, they share nothing but such common shingles, and ``_by_common_part`` finds links without pairing all.
    """
    found = connected_components(known)
    rooted = many.join(found, many.fp == found.node, "left").select("key", "th", "fp", F.coalesce("root", "fp").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = materialise(rooted.join(open_, "key", "left_semi").select("th", "fp", "root").distinct(), "open")
    held = sets.join(rest, "th").select("th", "fp", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held = materialise(held, "held")
    often = held.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("df > 1")
    low, high = SIMILARITY
    # shingles of one text alone come first in the order, so the others' places begin after them
    by_text = Window.partitionBy("th").orderBy("df", "s")
    each = Window.partitionBy("th")
    placed = held.join(materialise(often, "often"), "s").withColumns({"at": F.row_number().over(by_text), "k": F.count("*").over(each), "f": F.count_if(F.col("df") > COMMON).over(each)})
    placed = placed.withColumn("at", F.col("n") - F.col("k") + F.col("at"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(low) / F.lit(high)) + 1
    placed = materialise(placed.select("s", "th", "fp", "root", "n", "f", "at", "df", ((F.col("at") <= prefix) & (F.col("low") < F.col("high"))).alias("first")), "placed")
    fits = F.least("n", "n_b") * high >= F.greatest("n", "n_b") * low
    start = placed.where(F.col("first") & (F.col("df") <= COMMON)).select("s", "th", "fp", "root", "n", "at")
    other = start.select("s", *(F.col(c).alias(f"{c}_b") for c in ("th", "fp", "root", "n", "at")))
    met = start.join(other, "s").where((F.col("th") > F.col("th_b")) & (F.col("root") != F.col("root_b")) & fits)
    ends = met.groupBy("th", "fp", "n", "th_b", "fp_b", "n_b").agg(F.count("*").alias("common"), F.max("at").alias("at"), F.max("at_b").alias("at_b"))
    # those go that can't reach the limit even if all after their last common rare shingle were common
    most = F.col("common") + F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    ends = ends.where(most * (low + high) >= (F.col("n") + F.col("n_b")) * low)
    by_rare = ends.select(F.col("th").alias("a"), F.col("fp").alias("fp_a"), F.col("th_b").alias("b"), F.col("fp_b"))
    return by_rare.unionByName(_by_common_part(placed)).distinct()


def _by_common_part(placed: DataFrame) -> DataFrame:
    """a, fp_a, b, fp_b: pairs that connect all texts alike enough that share common shingles alone.

    Whether such texts x and y are alike depends on their common parts and their sizes only: n_x + n_y may be 9/4
    of what they share. So among texts with one common part the smallest, its head, is alike to each that is alike
    to any of them; and where x and y of different parts are alike, so are the heads of the two parts, and each of
    x and y is alike to its own head or to the other's, the smaller one. Texts are therefore compared with the
    head of their part, and heads, and texts too large for theirs, with smaller heads of parts whose prefix they
    share: a passage that thousands of texts consist of gives a pair for each of them. Before that, texts go whose
    common part lies within that of a text no larger and of the same component, as edited copies' do within their
    original's: what is alike to them is alike to it.
    """
    low, high = SIMILARITY
    enough = F.col("f") * high >= F.col("n") * low
    common = placed.where((F.col("df") > COMMON) & enough)
    tops = common.groupBy("root").agg(F.max(F.struct("f", -F.col("n"), -F.col("th").cast("decimal(20,0)"), "th", "n")).alias("top"))
    tops = materialise(tops.select(F.col("top.th").alias("t_th"), F.col("top.n").alias("t_n"), F.col("root").alias("t_root")), "tops")
    held = materialise(common.join(tops, common.th == tops.t_th).select("t_root", "t_n", "t_th", F.col("s").alias("t_s")), "top-parts")
    within = common.join(held, (F.col("root") == F.col("t_root")) & (F.col("s") == F.col("t_s"))).where((F.col("th") != F.col("t_th")) & (F.col("t_n") <= F.col("n")))
    within = within.groupBy("th", "f").agg(F.count("*").alias("shared")).where("shared = f").select("th")
    common = materialise(common.join(materialise(within, "within"), "th", "left_anti"), "common")
    part = common.groupBy("th", "fp", "root", "n", "f").agg(F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("p1"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("p2"))
    part = materialise(part, "parts")
    heads = part.groupBy("p1", "p2").agg(F.min(F.struct("n", "th", "fp", "root")).alias("head"))
    heads = materialise(heads, "heads")
    own = part.join(heads, ["p1", "p2"]).where(F.col("th") != F.col("head.th"))
    near = (F.col("n") + F.col("head.n")) * low <= F.col("f") * (low + high)
    star = own.where(near & (F.col("root") != F.col("head.root"))).select(F.col("th").alias("a"), F.col("fp").alias("fp_a"), F.col("head.th").alias("b"), F.col("head.fp").alias("fp_b"))
    # heads, and texts too large for theirs with the size of that head, which a smaller one must be below
    asking = heads.select("head.th", F.lit(None).cast("long").alias("limit")).unionByName(own.where(~near).select("th", F.col("head.n").cast("long").alias("limit")))
    first = common.where("first").select("s", "th", "fp", "root", "n", "f", "at")
    left = first.join(asking, "th")
    right = first.join(heads.select("head.th"), "th", "left_semi").select("s", *(F.col(c).alias(f"{c}_b") for c in ("th", "fp", "root", "n", "f", "at")))
    # what a pair's first common shingle leaves after it in the order must be enough; later ones may fail this
    left_over = (F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) + 1) * (low + high) >= (F.col("n") + F.col("n_b")) * low
    fits = left_over & ((F.col("n") + F.col("n_b")) * low <= F.least("f", "f_b") * (low + high)) & ((F.col("n_b") < F.col("n")) | (F.col("n_b") == F.col("n")) & (F.col("th_b") < F.col("th"))) & (F.col("limit").isNull() | (F.col("n_b") < F.col("limit")))
    cross = left.join(right, "s").where((F.col("root") != F.col("root_b")) & fits)
    return star.unionByName(cross.select(F.col("th").alias("a"), F.col("fp").alias("fp_a"), F.col("th_b").alias("b"), F.col("fp_b")).distinct())


def similar(docs: DataFrame, sketches: DataFrame, likely: Callable[[DataFrame], DataFrame] | None = None, size: int = WORDS, wide: bool = False) -> DataFrame:
    """a, b: links between fingerprints that connect texts whose five-word shingle sets are 0.8 alike or more.

    A fingerprint of 64 bits can't find these: some such pairs differ in over 10 bits, and at that distance
    unrelated texts link as well. Bands of minimum hashes find candidates, crowded ones by way of the rarest
    shingles, and whole sets decide exactly. ``likely`` may put pairs aside before their sets are made; shingles
    may be of another ``size``, and ``wide``.
    """
    pairs, many = candidates(sketches)
    pairs, many = materialise(pairs if likely is None else likely(pairs), "pairs"), materialise(many, "many")
    wanted = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).unionByName(many.select("th")).distinct()
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    sets = materialise(shingle_sets(keyed, materialise(wanted, "wanted"), size, wide), "sets")
    known = materialise(alike(pairs, sets), "alike")
    if many.isEmpty():
        return known
    return known.unionByName(alike(materialise(crowded(many, sets, known), "rest"), sets))


def components(fp: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """fp, root: the least fingerprint that each distinct one of column fp reaches over links, and over those in ``more``."""
    own = materialise(fp.select("fp").distinct(), "distinct")
    near = links(own)
    found = connected_components(near if more is None else near.unionByName(more))
    return own.join(found, own.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long), component_id: the least doc_id reachable over links, per document row.

    Equal fingerprints are one node, so copies are never paired; null and empty texts share fingerprint zero
    and link like any other. A null doc_id keeps its row, and names a component only if no other does. Empty
    input gives an empty result; repeated rows give repeated results.
    """
    fp = materialise(fingerprints(docs.select("doc_id", "text"), size), "fingerprints")
    rooted = fp.groupBy("fp").agg(F.min("doc_id").alias("least")).join(components(fp), "fp")
    name = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(name, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document row of each group of near duplicates: that of least doc_id (null last), in its own columns.

    Near duplicates have fingerprints within 2 bits, or five-word shingle sets 0.8 alike or more; groups are
    what such links connect. Null and empty texts are one group. Of rows that share doc_id and text one stays,
    whichever. Empty input gives an empty result. Extra columns of any name are carried along.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    fp = materialise(_sketches(keyed), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    by_fp = fp.groupBy("fp").agg(F.min(order).alias("first")).join(components(fp, similar(docs, fp)), "fp")
    first = by_fp.groupBy("root").agg(F.min("first").alias("first")).select(*_row_key(F.col("first.doc_id"), F.col("first.th")))
    # plain equalities, so that rows stay dealt by the join's keys and no second shuffle of the texts follows
    own = [F.col(c).alias(f"own_{c}") for c in docs.columns]
    met = docs.select(*own, *_row_key(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))).join(first, ["_d", "_n", "_t"])
    return met.dropDuplicates(["_d", "_n", "_t"]).select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


def _row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0)).alias("_d"), doc_id.isNull().alias("_n"), text_hash.alias("_t")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
