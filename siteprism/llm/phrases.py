"""Phrase collocation mining by a weighted de Bruijn graph of word grams."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, materialise, raw, table, utf8

#: Words of the longest phrase, least count of a phrase, and phrases that each language reports.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A word is heavy if it is more than one in so many of all words; so there are at most as many of them.
HEAVY = 1024
#: Bytes of text that a worker takes at once; a longer text is taken in stretches.
STRETCH = 4 << 20
#: The commonest words of up to so many bytes go by two bytes between tasks; at most as many as two bytes have below 0xFF00.
SHORT_WORDS, SHORT_BYTES = 0xFF00, 40

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: What ends a piece, and what parts words within it (fixed by the contract of the operator).
_ENDS, _BLANKS = b".,;:!?\n\v\f\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_ENDS)] = 1, 2
_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")
_AHEAD = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,%d}" % (LONGEST - 1))


def stretches(text: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """A text in stretches of about ``limit`` bytes cut between words, with the words ahead that grams reach; and its own bytes."""
    a = 0
    while len(text) - a > limit and (cut := _CUT.search(text, a + limit)):
        yield text[a : _AHEAD.match(text, cut.start()).end()], cut.start() - a
        a = cut.start()
    yield text[a:], len(text) - a


def _loads(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    """Languages, stretches and their own bytes, about ``limit`` bytes at a time."""
    langs, held, own, size = [], [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for lang, text in zip(part.column("lang").to_pylist(), raw(part.column("text"))):
                for bits, n in stretches(text, limit):
                    langs.append(lang)
                    held.append(bits)
                    own.append(n)
                    size += len(bits)
                    if size >= limit:
                        yield langs, held, own
                        langs, held, own, size = [], [], [], 0
    if held:
        yield langs, held, own


class Words:
    """The words of some stretches: ``text`` holds each with one blank behind it, ``at`` where it begins.

    ``lang`` (a number in ``langs``), ``own`` (whether it is among the stretch's own), ``place`` (its piece), and
    ``id`` (its number in ``names``) are by word.
    """

    def __init__(self, langs: list[str], held: list[bytes], own: list[int]):
        data = np.frombuffer((b"\n".join(held) + b"\n").translate(_LOWER), np.uint8)
        kind = _KIND[data]
        word = kind == 0
        after = np.concatenate([[False], word[:-1]])
        start = np.flatnonzero(word & ~after)
        kept = word | after
        self.text = np.where(word, data, np.uint8(32))[kept]
        self.at = np.concatenate([[0], np.flatnonzero(~word[kept]) + 1])
        first = np.concatenate([[0], np.cumsum([len(b) + 1 for b in held])[:-1]])
        stretch = np.searchsorted(first, start, "right") - 1
        self.own = start - first[stretch] < np.array(own)[stretch]
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs])[stretch]
        self.place = np.cumsum(kind == 2)[start]
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(self.at.astype(np.int32)), pa.py_buffer(self.text)])
        coded = words.dictionary_encode()
        self.id, self.names = coded.indices.to_numpy(), coded.dictionary

    def hashes(self) -> np.ndarray:
        """Spark's xxhash64 of every different word."""
        return np.fromiter((xxhash.xxh64_intdigest(x[:-1], 42) for x in self.names.to_pylist()), np.uint64, len(self.names))

    def tokens(self, short: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words as tokens end to end, and where each begins."""
        names = pa.array([token(x[:-1], short) for x in self.names.to_pylist()], pa.binary())
        return utf8(pa.DictionaryArray.from_arrays(pa.array(self.id), names).dictionary_decode())


def token(word: bytes, short: dict[bytes, bytes]) -> bytes:
    """A word for the shuffle: its two bytes, or 0xFF, its length and itself. No token begins another."""
    return short.get(word) or b"\xff" + len(word).to_bytes(4, "big") + word


def spelled(data: bytes, words: list[bytes]) -> list[bytes]:
    """The words of tokens end to end; ``words`` are those that two bytes number."""
    out, at = [], 0
    while at < len(data):
        if data[at] < 255:
            out.append(words[data[at] << 8 | data[at + 1]])
            at += 2
        else:
            end = at + 5 + int.from_bytes(data[at + 1 : at + 5], "big")
            out.append(data[at + 5 : end])
            at = end
    return out


def _slices(data: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray, step: int = 1 << 15) -> Iterator[tuple[slice, pa.Array]]:
    """The bytes of ``size`` tokens from each of ``first`` on, some at a time."""
    for i in range(0, len(first), step):
        part = slice(i, i + step)
        a, b = at[first[part]], at[first[part] + size[part]]
        ends = np.cumsum(b - a)
        into = np.arange(ends[-1]) + np.repeat(a - np.concatenate([[0], ends[:-1]]), b - a)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        yield part, pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(data[into])])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: all occurrences of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for load in _loads(batches, STRETCH):
            w = Words(*load)
            key, n = np.unique((w.lang * len(w.names) + w.id)[w.own], return_counts=True)
            word = pc.binary_slice(w.names.take(pa.array(key % max(1, len(w.names)))), 0, -1).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(w.langs).cast(pa.string()).take(pa.array(key // max(1, len(w.names)))), word, pa.array(n)], ["lang", "word", "n"])

    return docs.transform(arrow_map, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _same(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each different combination of the columns' codes (each below its size), and how many rows have it."""
    code, size = columns[0].astype(np.int64), sizes[0]
    for c, n in zip(columns[1:], sizes[1:]):
        if size * n >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            size = len(code)
        code, size = code * n + c, size * n
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return first, counts


#: A gram's count, the bytes by which it is dealt out, and the words these hold, in one number.
_COUNT, _BYTES = 1 << 35, 1 << 3


def edges(docs: DataFrame, short: list[bytes], heavy: list[int]) -> DataFrame:
    """gram, v: what begins at each word but the last of a piece, counted within a worker's stretch.

    A gram is the language and LONGEST words as tokens: an edge of the graph, from the node of its first words to
    that of its last. Where a piece ends sooner the gram ends there (a piece-end correction: flow that enters the
    shorter node and leaves the graph). ``v`` holds the count and how a gram is dealt out: by its first two words,
    or by as many more as it takes to have one that is not heavy; by all, if all are (then for LONGEST + 1 words).
    """
    held = docs.sparkSession.sparkContext.broadcast((short, np.array(heavy, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, heavy_hashes = held.value
        numbers = {x: i.to_bytes(2, "big") for i, x in enumerate(words)}
        for load in _loads(batches, STRETCH):
            w = Words(*load)
            if not len(w.id):
                continue
            new = np.flatnonzero(np.concatenate([[True], w.place[1:] != w.place[:-1]]))
            n_words = np.diff(np.append(new, len(w.id)))
            left = np.repeat(new + n_words, n_words) - np.arange(len(w.id))
            size = np.minimum(left, LONGEST)
            first = np.flatnonzero(w.own & (size > 1))
            size = size[first]
            columns = [np.where(size > k, w.id[np.minimum(first + k, len(w.id) - 1)] + 1, 0) for k in range(LONGEST)]
            one, n = _same([w.lang[first], *columns], [len(w.langs), *[len(w.names) + 1] * LONGEST])
            first, size = first[one], size[one]
            common = np.isin(w.hashes().view(np.int64), heavy_hashes)[w.id]
            upto = np.full(len(first), LONGEST + 1)
            for k in range(LONGEST, 1, -1):
                light = np.zeros(len(first), bool)
                for i in range(k):
                    light |= (size > i) & ~common[np.minimum(first + i, len(common) - 1)]
                upto[light & (size >= k)] = k
            data, at = w.tokens(numbers)
            for lang, name in enumerate(w.langs):
                own = w.lang[first] == lang
                head = token(name.encode(), numbers)
                f, m, u = first[own], size[own], upto[own]
                v = n[own] * _COUNT + (len(head) + at[f + np.minimum(m, u)] - at[f]) * _BYTES + u
                for part, grams in _slices(data, at, f, m):
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.scalar(head), grams, pa.scalar(b"")), pa.array(v[part])], ["gram", "v"])

    return docs.transform(arrow_map, run, "gram binary, v long")


def _parsed(gram: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row of tokens (language, then words) their bytes, where each ends (rows by token), and a number for each, alike for equal ones; -1 where there is none."""
    data, offsets = utf8(gram)
    width = LONGEST + 1
    ends, number = np.full((len(gram), width), -1), np.full((len(gram), width), -1)
    at, stop = offsets[:-1].copy(), offsets[1:]
    padded = np.concatenate([data, np.zeros(5, np.uint8)]).astype(np.int64)
    long_rows, long_at, long_to = [], [], []
    for k in range(width):
        here = np.flatnonzero(at < stop)
        p = at[here]
        plain = padded[p] < 255
        number[here[plain], k] = padded[p[plain]] << 8 | padded[p[plain] + 1]
        size = np.where(plain, 2, 5 + (padded[p + 1] << 24 | padded[np.minimum(p + 2, len(data))] << 16 | padded[np.minimum(p + 3, len(data))] << 8 | padded[np.minimum(p + 4, len(data))]))
        at[here] = p + size
        ends[here, k] = at[here]
        rest = np.flatnonzero(~plain)
        long_rows.append(here[rest] * width + k)
        long_at.append(p[rest])
        long_to.append(p[rest] + size[rest])
    where, a, b = (np.concatenate(x) for x in (long_rows, long_at, long_to))
    if len(where):
        view = memoryview(np.ascontiguousarray(data))
        number.ravel()[where] = 1 << 16 | pa.array([bytes(view[i:j]) for i, j in zip(a.tolist(), b.tolist())], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    return data, ends, number


def _flows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[bytes, int]]:
    """Tokens and flow of the nodes of every length above one that sorted grams begin with.

    What begins with some words lies together, so a node's flow, out along its edges and at piece ends, is a sum
    over neighbouring rows. Nodes dealt to several tasks are told with what is here, others if it is ``least``.
    """
    open_: dict[int, tuple[bytes, int, bool]] = {}  # by length, the last node so far: tokens, flow, whether all of it is here
    last: list[bytes] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends, number = _parsed(batch.column("gram"))
        starts = utf8(batch.column("gram"))[1][:-1]
        v = batch.column("v").to_numpy()
        n, upto = v // _COUNT, v % _BYTES
        same = np.ones(len(v), bool)
        for k in range(LONGEST + 1):
            here = number[:, k] >= 0
            both = np.zeros(len(v), bool)
            both[1:] = here[1:] & (number[1:, k] == number[:-1, k])
            both[0] = here[0] and len(last) > k and data[starts[0] if k == 0 else ends[0, k - 1] : ends[0, k]].tobytes() == last[k]
            same &= both
            if k < 2:
                continue
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            begin = np.flatnonzero(~same[rows])
            if not len(begin) or begin[0]:  # the node that the batch before ended in goes on
                begin = np.concatenate([[0], begin])
            sums = np.add.reduceat(n[rows], begin)
            head = rows[begin]
            whole = upto[head] <= k
            if same[head[0]]:
                sums[0] += open_.pop(k)[1]
            elif k in open_:
                tokens, flow, all_here = open_.pop(k)
                if flow >= least or not all_here:
                    yield tokens, flow
            for i in np.flatnonzero((sums[:-1] >= least) | ~whole[:-1]).tolist():
                yield data[starts[head[i]] : ends[head[i], k]].tobytes(), int(sums[i])
            open_[k] = (data[starts[head[-1]] : ends[head[-1], k]].tobytes(), int(sums[-1]), bool(whole[-1]))
        row = len(v) - 1
        bounds = [starts[row], *ends[row][ends[row] >= 0]]
        last = [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
    yield from ((tokens, flow) for tokens, flow, all_here in open_.values() if flow >= least or not all_here)


def gram_counts(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, gram (words joined by blanks), n: every phrase of one to LONGEST words that occurs ``least`` times.

    Only the longest grams are counted from the text. They are dealt out by their first two words (by more, if
    these are heavy) and sorted; shorter counts are sums over what begins alike.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    heavy = [r.h for r in words.where(F.col("n") * HEAVY > total).select(F.xxhash64("word").alias("h")).distinct().collect()]
    # a bounded number of words of bounded size comes to the driver and goes to the workers
    common = words.where(F.octet_length("word") <= SHORT_BYTES).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(SHORT_WORDS)
    short = [r.word.encode() for r in common.select("word").collect()]
    held = docs.sparkSession.sparkContext.broadcast(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _flows(batches, least)
        while some := list(itertools.islice(found, 10_000)):
            spoken = [spelled(tokens, held.value) for tokens, _ in some]
            text = lambda parts: pa.array([b" ".join(p) for p in parts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text([p[:1] for p in spoken]), text([p[1:] for p in spoken]), pa.array([n for _, n in some], pa.int64())], ["lang", "gram", "n"])

    by = F.expr(f"xxhash64(substring(gram, 1, cast(v % {_COUNT} div {_BYTES} as int)))")
    nodes = edges(docs, short, heavy).repartition(by).sortWithinPartitions("gram").transform(arrow_map, run, "lang string, gram string, n long")
    longer = nodes.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words.where(F.col("n") >= least).select("lang", F.col("word").alias("gram"), "n").unionByName(longer)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, count and bytes.

    ``docs`` has text and lang; null text counts as empty, null lang is ``und``. Texts are lower-cased in A-Z and
    split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks. A phrase of 2 to LONGEST words that
    occurs ``least`` times (a) scores floor(1000 a n / (l r)) at its worst cut into parts that occur l and r times
    among n words. Phrases on an unary path of the graph are compacted: where all that passes a node goes on along
    one edge, or came by one, the node's phrase lies in that edge's and goes. (A longer phrase of the same count
    that holds it has one more word next to it, so edges to the next length are all there is to look at.) Ties
    keep their order by phrase; repeated rows count again; a language without such a phrase has no row, and empty
    input gives an empty result. Long texts are taken in stretches. Further columns don't matter.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = materialise(word_counts(docs), "words")
    grams = materialise(gram_counts(docs, words, least), "grams")
    sized = grams.withColumn("k", F.size(F.split("gram", " "))).where("k > 1")
    cut = sized.select("lang", "gram", "n", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.selectExpr("lang", "gram", "n", "cut", "substring_index(gram, ' ', cut) as head", "substring_index(gram, ' ', cut - k) as tail")
    part = lambda name, n: grams.select(F.col("lang"), F.col("gram").alias(name), F.col("n").alias(n))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    cut = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(total, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    # products of up to 38 digits; the quotient is a long
    scored = cut.withColumn("score", F.expr(f"({wide('n')} * {wide('total')} * cast(1000 as decimal(4, 0))) div ({wide('l')} * {wide('r')})"))
    worst = scored.groupBy("lang", "gram").agg(F.min(F.struct("score", "cut", "l", "r", "total", "n")).alias("w"))
    edge = sized.where("k > 2")
    paths = edge.selectExpr("lang", "n", "explode(array(substring_index(gram, ' ', k - 1), substring_index(gram, ' ', 1 - k))) as gram")
    paths = paths.groupBy("lang", "gram").agg(F.max("n").alias("through"))
    left = worst.join(paths, ["lang", "gram"], "left").where(F.col("through").isNull() | (F.col("through") < F.col("w.n")))
    rows = left.select("lang", F.col("gram").alias("phrase"), F.col("w.n").alias("a"), "w.l", "w.r", F.col("w.total").alias("n"), "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of many shares of a language first, so that no task orders a whole language
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    return few.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS gram FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws)) AS total FROM w GROUP BY lang),
c AS (SELECT lang, k, gram, n, string_split(gram, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.gram, c.n AS a, cut, l.n AS l, r.n AS r, t.total AS n, (1000::HUGEINT * c.n * t.total::HUGEINT) // (l.n::HUGEINT * r.n) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.gram = array_to_string(ws[1 : cut], ' ') JOIN f r ON r.lang = c.lang AND r.gram = array_to_string(ws[cut + 1 : c.k], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(ws[i : i + j - 1], ' ') AS gram, n FROM (SELECT lang, n, string_split(gram, ' ') AS ws, k, j, unnest(range(1, k - j + 2)) AS i FROM f, (SELECT unnest([2, 3, 4]) AS j) WHERE j < k)),
kept AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = b.lang AND x.gram = b.gram AND 100 * x.n >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept) WHERE rank <= 2000
"""
