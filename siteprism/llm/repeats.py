"""Exact removal of long repeated byte strings by merged Burrows-Wheeler transforms of text shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, materialise, pieces, raw, table, utf8

#: Bytes of a string that counts as repeated; symbols that spell it; bytes of the grams among which anchors are chosen.
LENGTH, DEPTH, GRAM = 400, 4, 32
#: Bytes of text in a shard, and different fragments of one anchor that go to one task at most, about.
SHARD_BYTES, GROUP = 1 << 20, 256
#: Copies of a fragment from which it is broadcast: at most one of so many runs.
COMMON = 128

_SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256).astype(np.uint64)


@cache
def _factor(width: int) -> np.uint64:
    out = np.uint64(1)
    for _ in range(width):
        out = np.uint64((int(out) * 0xD6E8FEB86659FD93) % (1 << 64))
    return out


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from every place on, by doubling (shorter by width - 1 than the data)."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    power, size = _BYTE[data], 1
    out, done = None, 0
    while True:
        if width & size:
            n = len(data) - done - size + 1
            out = power[done : done + n].copy() if out is None else out[:n] * _factor(size) + power[done : done + n]
            done += size
            if done == width:
                return out
        power = power[: len(power) - size] * _factor(size) + power[size:]
        size *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes inside the texts: text, first and number of starts, anchor's hash.

    A string's anchor is its gram of least hash (the leftmost of equal ones), so equal strings have equal
    anchors. Strings that start side by side mostly share one: each row is a run of starts with one anchor.
    """
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    gram = _mixed(gram_hashes(data, GRAM))
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    window, size = length - GRAM + 1, 1
    while 2 * size <= window:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if window > size:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # starts whose string ends in the same text
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + length <= offsets[text + 1]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & valid)
    # within a text the valid starts come first, so a run ends where the next begins or where they end
    stop = np.flatnonzero(np.append(new | ~valid, True))
    end = stop[np.searchsorted(stop, first, "right")]
    return text[first], first, end - first, gram[at[first]].view(np.int64)


def _occurrences(docs: DataFrame, length: int, block: int = 1 << 20) -> DataFrame:
    """doc_id, th, start, n, anchor, frag, times, own: runs of starts with one anchor, and a hash of the bytes each spans.

    Runs of one text that span the same bytes (a word over and over gives one for each) repeat one another: the
    first stands for all, with their number and, joined where they touch, their places. A long text has such a
    row for each stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", block):
            whole, ends = utf8(batch.column("text"))
            doc, th = batch.column("doc_id"), batch.column("th").to_numpy()
            # a long text is worked on in stretches that overlap by a string less one byte
            for a in range(0, max(1, len(whole) - length + 1), block) if len(ends) == 2 else (0,):
                data = whole[a : a + block + length - 1] if len(ends) == 2 else whole
                text, first, n, anchor = anchors(data, np.array([0, len(data)]) if len(ends) == 2 else ends, length)
                view = memoryview(np.ascontiguousarray(data))
                frag = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(first.tolist(), (first + n + length - 1).tolist())), np.uint64, len(first)).view(np.int64)
                start = first - ends[text] + a
                head, times, own = _own_repeats(text, start, n, frag)
                text = text[head]
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(text)), pa.array(th[text]), pa.array(start[head]), pa.array(n[head].astype(np.int32)), pa.array(anchor[head]), pa.array(frag[head]), pa.array(times), own],
                    ["doc_id", "th", "start", "n", "anchor", "frag", "times", "own"],
                )

    return docs.transform(arrow_map, run, "doc_id long, th long, start long, n int, anchor long, frag long, times long, own array<struct<start: long, n: int>>")


def _own_repeats(text: np.ndarray, start: np.ndarray, n: np.ndarray, frag: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """The first run of each different fragment of a text, how many there are of it, and where, if more than one."""
    order = np.lexsort((frag, text))  # stable: of equal ones the first place comes first
    t, f, begin, end = text[order], frag[order], start[order], (start + n)[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(order)))
    apart = new.copy()
    apart[1:] |= begin[1:] != end[:-1]
    at = np.flatnonzero(apart)
    end = end[np.append(at, len(order))[1:] - 1]
    group = np.cumsum(new)[at] - 1
    again = times[group] > 1
    at, end, group = at[again], end[again], group[again]
    places = pa.StructArray.from_arrays([pa.array(begin[at]), pa.array((end - begin[at]).astype(np.int32))], ["start", "n"])
    own = pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(len(heads) + 1)).astype(np.int32)), places)
    by_place = np.argsort(order[heads])
    return order[heads][by_place], times[by_place], own.take(pa.array(by_place))


def _fragments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs with the bytes they span, cut from their documents."""
    asked = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "anchor", "frag", "copies", "kinds")).alias("runs"))
    met = docs.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "text")
    met = met.join(asked, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))).select("doc_id", "th", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            runs = batch.column("runs")
            own = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy())))
            flat = runs.flatten()
            texts = raw(batch.column("text"))
            start, n = flat.field("start").to_pylist(), flat.field("n").to_pylist()
            bits = [texts[i][s : s + k + length - 1] for i, s, k in zip(own.to_pylist(), start, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(own), batch.column("th").take(own), *(flat.field(c) for c in ("start", "n", "anchor", "frag", "copies", "kinds")), pa.array(bits, pa.binary())],
                ["doc_id", "th", "start", "n", "anchor", "frag", "copies", "kinds", "bits"],
            )

    return met.transform(arrow_map, run, "doc_id long, th long, start long, n int, anchor long, frag long, copies long, kinds long, bits binary")


# The merge. A text is read as words of ``step`` bytes, at each of its ``step`` phases, so that DEPTH symbols spell
# the ``length`` bytes of a string and a few rounds of refinement tell strings apart that plain bytes would take
# hundreds of rounds for. A shard's transform lists, in the order of the suffixes, the symbol before each suffix.


def _stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of codes from 0 to 2^32 by two rounds of radix sort (numpy's own below 17 bits)."""
    low = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if int(values.max(initial=0)) < 1 << 16:
        return low
    return low[np.argsort((values[low] >> 16).astype(np.uint16), kind="stable")]


def spelled(bits: list[bytes], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols at every place of the texts, with -1 where there is none, and where each begins.

    Behind each text stand ``step`` places without a symbol: the ends of its phases. Symbols that occur once
    can't be part of a repeated string, so they are ends too (most by a count of hashes, the rest exactly).
    """
    gap = bytes(step)
    data = np.frombuffer(b"".join(x for b in bits for x in (b, gap)) + gap, np.uint8)
    size = np.array([len(b) for b in bits])
    first = np.concatenate([[0], np.cumsum(size + step)])
    codes = gram_hashes(data, step)[: first[-1]]
    into = np.arange(first[-1]) - np.repeat(first[:-1], size + step)
    real = np.flatnonzero(into <= np.repeat(size - step, size + step))
    slot = (_mixed(codes[real]) >> np.uint64(42)).astype(np.int64)
    real = real[np.bincount(slot, minlength=1 << 22)[slot] > 1]
    _, number, counts = np.unique(codes[real], return_inverse=True, return_counts=True)
    again = counts[number] > 1
    symbol = np.full(first[-1], -1, np.int32)
    symbol[real[again]] = number[again]
    return symbol, first, into


class Transform:
    """A shard's suffixes in order (to DEPTH symbols) and the symbols before them."""

    def __init__(self, suffixes: np.ndarray, before: np.ndarray):
        self.suffixes, self.before = suffixes, before

    @classmethod
    def of(cls, start: int, end: int, symbol: np.ndarray, into: np.ndarray, step: int) -> Transform:
        """The transform of the texts at places start to end, by sorting this shard's suffixes alone."""
        own = np.arange(start, end)
        # a place without a symbol is an end only if a symbol stands one step before it
        real = (symbol[own] >= 0) | ((into[own] >= step) & (symbol[np.maximum(own - step, 0)] >= 0))
        own = own[real]
        keys, at, live = [], own, np.ones(len(own), bool)
        for _ in range(DEPTH):
            key = np.where(live, symbol[at], -1)
            keys.append(key)
            live = live & (key >= 0)
            at = np.minimum(at + step, len(symbol) - 1)
        order = _stable_order(keys[-1] + 1)
        for key in keys[-2::-1]:
            order = order[_stable_order(key[order] + 1)]
        return cls(own[order], _before(own[order], symbol, into, step))


def _before(suffixes: np.ndarray, symbol: np.ndarray, into: np.ndarray, step: int) -> np.ndarray:
    """The symbol one step before each suffix, -2 where its phase begins."""
    return np.where(into[suffixes] >= step, symbol[np.maximum(suffixes - step, 0)], -2)


def merge(a: Transform, b: Transform) -> tuple[Transform, np.ndarray]:
    """The transform of both shards, and for each of its suffixes the number of its block.

    Iterative interleave refinement: ``z`` tells, place by place, which shard's next suffix stands there. Round
    by round the symbols before the suffixes, in the order so far, are dealt stably by symbol: where they land
    is the order by one symbol more. A block holds the suffixes that agree in the symbols compared so far; it
    splits where symbols differ or where the suffixes one symbol on lay in different blocks, so the blocks
    give the common prefixes. No suffix of either shard is sorted again: within a shard the order never changes.
    """
    ends = (_ends(a), _ends(b))
    z = np.concatenate([np.zeros(len(a.before), bool), np.ones(len(b.before), bool)])
    block = np.zeros(len(z), np.int64)
    for _ in range(DEPTH):
        before = np.empty(len(z), np.int32)
        before[~z], before[z] = a.before, b.before
        has = np.flatnonzero(before >= 0)
        order = has[_stable_order(before[has])]
        new = np.ones(len(order), bool)
        new[1:] = (before[order[1:]] != before[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        z = np.concatenate([np.zeros(ends[0], bool), np.ones(ends[1], bool), z[order]])
        block = np.concatenate([np.zeros(sum(ends), np.int64), np.cumsum(new)])
    suffixes, before = np.empty(len(z), np.int64), np.empty(len(z), np.int32)
    suffixes[~z], suffixes[z] = a.suffixes, b.suffixes
    before[~z], before[z] = a.before, b.before
    return Transform(suffixes, before), block


def _ends(t: Transform) -> int:
    """How many of the suffixes are empty: they come first."""
    return len(t.before) - int((t.before >= 0).sum())


def repeated_starts(bits: list[bytes], n: list[int], sure: list[bool], length: int = LENGTH, shard: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``n`` starts of each text, whether its string starts elsewhere too (texts end to end).

    Also the texts' first places in that. A text that is
    ``sure`` stands for several copies, so its strings are all repeated.
    """
    step = length // DEPTH
    symbol, first, into = spelled(bits, step)
    total = int(first[-1])
    cuts = [0]
    for f in first[1:].tolist():
        if f - cuts[-1] >= shard or f == total:
            cuts.append(f)
    parts = [Transform.of(a, b, symbol, into, step) for a, b in zip(cuts, cuts[1:])]
    if len(parts) == 1:
        parts.append(Transform(np.zeros(0, np.int64), np.zeros(0, np.int32)))
    block = np.zeros(0, np.int64)
    while len(parts) > 1:
        merged = [merge(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
        block = merged[0][1]
        parts = [m for m, _ in merged] + (parts[-1:] if len(parts) % 2 else [])
    suffixes = parts[0].suffixes
    limit = np.repeat(np.array(n), np.diff(first))
    starts = (into[suffixes] < limit[suffixes]) & _spells(suffixes, symbol, step)
    places, number = suffixes[starts], block[starts]
    weight = 1 + np.repeat(np.array(sure, np.int64), np.diff(first))[places]
    counts = np.bincount(number, weight)
    held = np.full(total, -1, np.int64)
    held[places] = number
    wanted = into < limit
    number = held[wanted]
    # starts whose first symbol was cut off are in no block
    found = (number >= 0) & (counts[number] > 1) if len(counts) else np.zeros(len(number), bool)
    return found | np.repeat(np.array(sure, bool), n), np.concatenate([[0], np.cumsum(n)])


def _spells(suffixes: np.ndarray, symbol: np.ndarray, step: int) -> np.ndarray:
    """Whether DEPTH symbols follow one another from each suffix on."""
    out, at = np.ones(len(suffixes), bool), suffixes
    for _ in range(DEPTH):
        out &= symbol[at] >= 0
        at = np.minimum(at + step, len(symbol) - 1)
    return out


def _runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first place and length of each run of true flags within a text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])
    begin = np.flatnonzero(new)
    return text[at[begin]], at[begin] - first[text[at[begin]]], np.diff(np.append(begin, len(at)))


_FOUND = "doc_id long, th long, start long, n int"


def _resolved(fragments: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts in fragments (key, copies, doc_id, th, start, n, bits) that lie key by key.

    What has one key is told together; several keys are told at once as long as they are small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            length_of = np.diff(utf8(batch.column("bits"))[1])
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            begin = 0
            for a, b in zip(cut[:-1], cut[1:]):
                if size >= 2 * SHARD_BYTES and key[a] != last:
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    yield _told(held, length)
                    held, size, begin = [], 0, a
                size += int(length_of[a:b].sum())
                last = key[a]
            held.append(batch.slice(begin))
        if held:
            yield _told(held, length)

    return fragments.select("key", "copies", "doc_id", "th", "start", "n", "bits").transform(arrow_map, run, _FOUND)


def _told(held: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    n = rows.column("n").to_numpy()
    sure = rows.column("copies").to_numpy() > 1
    flags, first = repeated_starts(rows.column("bits").to_pylist(), n.tolist(), sure.tolist(), length)
    t, start, count = _runs(flags & ~sure[np.repeat(np.arange(len(n)), n)], first)
    own = pa.array(t)
    return pa.RecordBatch.from_arrays([rows.column("doc_id").take(own), rows.column("th").take(own), pa.array(rows.column("start").to_numpy()[t] + start), pa.array(count.astype(np.int32))], ["doc_id", "th", "start", "n"])


#: A crowded key's fragments: ``lo`` is the least place of the anchor in the strings that the key stands for, ``at`` the
#: anchor's place in the fragment.
_PART = "key long, frag long, copies long, doc_id long, th long, start long, n int, lo int, at int, bits binary"


def _halves(fragments: DataFrame, length: int, width: int) -> DataFrame:
    """Fragments of crowded keys, each cut into two: the strings with the anchor in the lower and in the upper half.

    ``width`` is how many places of the anchor a half has. All strings of a half hold the bytes between its
    first string's start and its last one's end, so these bytes make the new key: equal strings keep equal keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bits", 4 << 20):
            cols = {c: batch.column(c).to_pylist() for c in ("key", "start", "n", "lo", "at", "bits")}
            own, out = [], []
            for i, (key, start, n, lo, at, bits) in enumerate(zip(*cols.values())):
                for low in (lo, lo + width):
                    high = min(low + width - 1, length - GRAM)
                    # a string that starts at s has the anchor at its place at - s
                    s, e = max(0, at - high), min(n - 1, at - low)
                    if s > e:
                        continue
                    block = bits[at - low : at - high + length]
                    own.append(i)
                    part = bits[s : e + length]
                    out.append((xxhash.xxh3_64_intdigest(b"%d %d " % (key, low) + block), xxhash.xxh3_64_intdigest(part), start + s, e - s + 1, low, at - s, part))
            at = pa.array(own, pa.int64())
            key, frag, start, n, lo, place, bits = zip(*out) if out else [()] * 7
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [signed(key), signed(frag), *(batch.column(c).take(at) for c in ("copies", "doc_id", "th")), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(lo, pa.int32()), pa.array(place, pa.int32()), pa.array(bits, pa.binary())],
                ["key", "frag", "copies", "doc_id", "th", "start", "n", "lo", "at", "bits"],
            )

    return fragments.transform(arrow_map, run, _PART)


def _placed(fragments: DataFrame, length: int) -> DataFrame:
    """Fragments with the place of their anchor: where its gram first occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [int(np.argmax(_mixed(gram_hashes(np.frombuffer(b, np.uint8), GRAM)).view(np.int64) == k)) for b, k in zip(batch.column("bits").to_pylist(), batch.column("key").to_pylist())]
            yield batch.append_column("at", pa.array(at, pa.int32()))

    rows = fragments.select("key", "frag", "copies", "doc_id", "th", "start", "n", F.lit(0).alias("lo"), "bits")
    return rows.transform(arrow_map, run, "key long, frag long, copies long, doc_id long, th long, start long, n int, lo int, bits binary, at int")


def _uncrowded(crowd: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Crowded fragments split by more and more of the bytes around the anchor: runs that are told, and small groups.

    Each round halves the places that an anchor can have in a key's strings. Strings that differ near the anchor
    part, what turns out equal as a whole is told, what is alone goes, and what is still crowded is halved again;
    after nine rounds a key is a whole string. A fragment gives a few rows a round, however many share its anchor.
    """
    told, small, width = [], [], 1
    while width < length - GRAM + 1:
        width *= 2
    crowd = _placed(crowd, length)
    while width > 1 and not crowd.isEmpty():
        width //= 2
        parts = materialise(_halves(crowd, length, width), "halves")
        kinds = parts.groupBy("key", "frag").agg(F.sum("copies").alias("total"))
        # written first, as the anchors are: so a crowded fragment's rows can be split in the join
        again = materialise(kinds.where("total > 1").select("key", "frag"), "again")
        told.append(parts.where("copies = 1").join(again, ["key", "frag"], "left_semi").select("doc_id", "th", "start", "n"))
        groups = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("total").alias("least")).where("kinds > 1 and least = 1").select("key", "kinds")
        rest = parts.groupBy("key", "frag").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "th", "start", "n", "lo", "at", "bits")).alias("r"))
        rest = materialise(rest.join(groups, "key").select("key", "frag", "copies", "r.*", "kinds"), "parts")
        small.append(rest.where(F.col("kinds") <= GROUP))
        crowd = rest.where(F.col("kinds") > GROUP).drop("kinds")
    return told, small


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, start, n: runs of starts in a text whose strings of ``length`` bytes start elsewhere too.

    ``docs`` has doc_id, th (a hash of the text) and text. Only what shares an anchor can be equal, so anchors
    that occur once are put aside first. Where all occurrences of an anchor span the same bytes, the runs are
    repeated as they are; the rest is told by merged transforms of the spanned bytes, different ones once. An
    anchor with over GROUP different fragments is first split by the bytes around it (``_uncrowded``). Runs of
    one text that span the same bytes are told where the text is read, and one of them meets the others.
    """
    seen = materialise(_occurrences(docs, length), "runs")
    often = seen.groupBy("anchor").agg(F.sum("times").alias("k"), F.min("frag").alias("low"), F.max("frag").alias("high")).where("k > 1")
    # written first: a join of two plain shuffles is one in which adaptive execution splits a crowded anchor's rows
    often = materialise(often.select("anchor", (F.col("low") == F.col("high")).alias("same")), "anchors")
    kept = materialise(seen.join(often, "anchor"), "repeated")
    own = kept.where("times > 1").selectExpr("doc_id", "th", "inline(own)")
    whole = kept.where("same and times = 1").select("doc_id", "th", "start", "n")
    mixed = kept.where(~F.col("same"))
    place = F.struct("doc_id", "th", "start", "n")
    frags = materialise(mixed.groupBy("anchor", "frag").agg(F.sum("times").alias("copies"), F.min(place).alias("at")), "fragments")
    # what many texts hold would meet in one task each: it is looked up where it lies, and only the rest is dealt out
    once, common = mixed.where("times = 1"), F.broadcast(frags.where(F.col("copies") > COMMON).select("anchor", "frag"))
    copied = once.join(common, ["anchor", "frag"], "left_anti").join(frags.where(F.col("copies").between(2, COMMON)).select("anchor", "frag"), ["anchor", "frag"], "left_semi")
    copied = copied.unionByName(once.join(common, ["anchor", "frag"], "left_semi")).select("doc_id", "th", "start", "n")
    kinds = frags.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("least = 1")
    kinds = materialise(kinds.select("anchor", "kinds"), "kinds")
    wanted = frags.join(kinds, "anchor").select("anchor", "frag", "copies", "kinds", "at.*")
    bits = materialise(_fragments(docs, wanted, length).withColumnRenamed("anchor", "key"), "bits")
    told, small = _uncrowded(bits.where(F.col("kinds") > GROUP), length)
    out = own.unionByName(whole).unionByName(copied)
    for rows in (bits.where(F.col("kinds") <= GROUP), *small):
        out = out.unionByName(_resolved(rows.repartition("key").sortWithinPartitions("key"), length))
    for rows in told:
        out = out.unionByName(rows)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", text).withColumn("th", F.xxhash64(text))


def _merged(starts: list[int], counts: list[int], length: int) -> list[tuple[int, int]]:
    """Byte spans covered by strings that begin at the runs of starts, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for s, n in sorted(zip(starts, counts)):
        e = s + n - 1 + length
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _short_passages(docs: DataFrame, length: int, words: int) -> DataFrame:
    """doc_id, th, start, n: passages of ``words`` words in under ``length`` bytes that stand elsewhere too.

    Longer ones are strings of ``length`` bytes already. Such a passage of k bytes is a run of k - length + 1
    starts (none or less), which spans its k bytes like any other run. One that a text itself repeats is told at
    once, and stands for all its places there when texts are compared: a row for each different one of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, start, size, high, low = [], [], [], [], []
            for i, text in enumerate(raw(batch.column("text"))):
                inside = np.concatenate([[False], ~np.isin(np.frombuffer(text, np.uint8), _SPACES), [False]])
                first, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
                n = len(first) - words + 1
                seen: dict[int, list[tuple[int, int]]] = {}
                for j in np.flatnonzero(end[words - 1 :] - first[:n] < length).tolist() if n > 0 else ():
                    a, b = int(first[j]), int(end[j + words - 1])
                    seen.setdefault(xxhash.xxh3_128_intdigest(text[a:b]), []).append((a, b))
                twice: list[tuple[int, int]] = []
                for a, b in sorted(x for own in seen.values() if len(own) > 1 for x in own):
                    if twice and a <= twice[-1][1]:
                        twice[-1] = (twice[-1][0], max(b, twice[-1][1]))
                    else:
                        twice.append((a, b))
                told = [(a, b, None) for a, b in twice] + [(*own[0], h) for h, own in seen.items()]
                for a, b, h in told:
                    row.append(i), start.append(a), size.append(b - a), high.append(h and h >> 64), low.append(h and h & (1 << 64) - 1)
            signed = lambda x: pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in x], pa.int64())
            n = pa.array(np.array(size, np.int64) - length + 1)
            own = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("th").take(own), pa.array(start, pa.int64()), n, signed(high), signed(low)], ["doc_id", "th", "start", "n", "high", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = materialise(docs.select("doc_id", "th", "text").transform(arrow_map, run, f"doc_id {kind}, th long, start long, n long, high long, low long"), "short")
    # by texts, so that of a text's own repeats only those that others hold as well meet again
    often = materialise(seen.where("high is not null").groupBy("high", "low").agg(F.count("*").alias("k")).where("k > 1").select("high", "low"), "shared")
    told = seen.where("high is null").unionByName(seen.join(often, ["high", "low"], "left_semi").select(*seen.columns))
    return told.select("doc_id", "th", "start", "n")


def _with_runs(docs: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """The documents (null text as empty) with th and the runs found in them, null where none."""
    keyed = _keyed(docs)
    runs = repeated_runs(keyed.select("doc_id", "th", "text"), length)
    if words:
        runs = runs.unionByName(_short_passages(keyed, length, words))
    by_doc = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs")).withColumnsRenamed({"doc_id": "d", "th": "t"})
    return keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").drop("d", "t")


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document row.

    Removed is each byte covered by a string of ``length`` bytes that starts anywhere else too, in whatever
    document. Null text is empty; rows repeated in all columns repeat each other's strings; texts shorter than
    ``length`` stay; empty input gives an empty result.
    """
    met = _with_runs(docs.select("doc_id", "text"), length).select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            out = []
            for text, runs in zip(raw(batch.column("text")), batch.column("runs").to_pylist()):
                spans = _merged([r["start"] for r in runs], [r["n"] for r in runs], length) if runs else []
                kept, done = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(text[done:s])
                    done = e
                kept.update(text[done:])
                out.append((len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return met.transform(arrow_map, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The documents, in their own columns, without what ``removal_digests`` counts as removed.

    With ``words``, passages of so many words that stand elsewhere too go as well, however short their words.
    A character stays whole unless all its bytes go. Documents of which nothing but white space is left go
    altogether if they had more; documents without repeats stay as they are, null texts too.
    """
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", F.col("text").isNull().alias("no_text"), *(F.col(c).alias(f"own_{c}") for c in rest))
    met = _with_runs(own, length, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            texts = []
            for text, runs in zip(raw(batch.column("text")), batch.column("runs").to_pylist()):
                if not runs:
                    texts.append(None)
                    continue
                out, done = [], 0
                for s, e in _merged([r["start"] for r in runs], [r["n"] for r in runs], length):
                    while s < e and s < len(text) and text[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                        e -= 1
                    out.append(text[done:s])
                    done = e
                texts.append(b"".join([*out, text[done:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "runs"), pa.array(texts, pa.string())], [*(c for c in batch.schema.names if c != "runs"), "left"])

    kept = met.drop("runs")
    out = met.select(*kept.columns, "runs").transform(arrow_map, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["left string"]))
    out = out.where(F.col("left").isNull() | (F.trim("left") != ""))
    text = F.coalesce("left", F.when(~F.col("no_text"), F.col("text")))
    columns = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"own_{c}") for c in rest}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("left").isNull(), columns["n_chars"]).otherwise(F.length("left").cast("long"))
    return out.select(*(columns[c].alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))
