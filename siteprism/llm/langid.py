"""Language identification by interpolated Kneser-Ney character models, one for each language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, materialise, pieces, table

#: Characters in an n-gram.
ORDER = 4
#: Deviations beyond which a text is none of the languages; texts that the languages' pooled variance counts as in each one's own.
REJECT, POOLED = 12.0, 8
#: Characters beyond which more text doesn't sharpen the score.
SCORE_CHARS = 40

_BITS = 16
_MASKS = [np.uint64((1 << _BITS * k) - 1) for k in range(5)]


@cache
def _classes() -> np.ndarray:
    """By code point: the lower-case letter (or mark of one), or a space for anything else, in 16 bits."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(128, 0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = ord(chr(c).lower()[0])
    for c in range(65, 91):
        out[c] = out[c + 32] = c + 32
    out = np.where(out > 0xFFFF, 0xF000 | out & 0xFFF, out)  # rare scripts share classes
    return out.astype(np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-gram that ends at each symbol of the texts, and where each text's begin (one more at the end).

    Symbols are lower-case letters, and one space for a run of anything else. An n-gram reaches back to the
    space before its word at most; before that stand zeros, so words don't depend on each other.
    """
    joined = " " + " ".join(texts) + " "
    code = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = code == 32
    # ends of texts in characters: each begins after a joining space
    at = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]) if texts else np.ones(1, np.int64)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    bounds = (np.cumsum(keep) - keep)[np.minimum(at, len(code) - 1)]
    code, space = code[keep], space[keep]
    key = code.copy()
    inside = np.ones(len(code), bool)
    for k in range(1, ORDER):
        if k > 1:
            inside[k - 1 :] &= ~space[: len(code) - k + 1]
            inside[: k - 1] = False
        before = np.zeros(len(code), np.uint64)
        before[k:] = code[: len(code) - k]
        key |= np.where(inside, before, np.uint64(0)) << np.uint64(_BITS * k)
    # every text's symbols: from its first letter to the space after its last (none without a letter)
    bounds[-1] = len(code)
    return key, bounds


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class HashArray:
    """Keys as sorted hashes, with the place where each value of the upper bits begins."""

    hashes: np.ndarray
    starts: np.ndarray
    shift: int
    order: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, keys: np.ndarray) -> HashArray:
        mixed = _mix(keys)
        order = np.argsort(mixed)
        bits = max(1, int(len(keys)).bit_length() + 1)
        hashes = mixed[order]
        starts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return cls(np.append(hashes, np.uint64(0)), np.append(starts, len(keys)).astype(np.int32), 64 - bits, order)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1. (The arrays of values lie in the order of the hashes.)"""
        mixed = _mix(keys)
        bucket = (mixed >> np.uint64(self.shift)).astype(np.int64)
        at = self.starts[bucket]
        out = np.where((self.hashes[at] == mixed) & (at < self.starts[-1]), at, -1)
        left = np.flatnonzero((out < 0) & (self.starts[bucket + 1] - at > 1))
        step = 1
        while len(left):
            place = at[left] + step
            hit = self.hashes[place] == mixed[left]
            out[left[hit]] = place[hit]
            step += 1
            left = left[~hit & (self.starts[bucket[left] + 1] - at[left] > step)]
        return out


@dataclass
class Model:
    """Log probabilities of n-grams and log back-off weights of contexts, a column for each language."""

    langs: list[str]
    keys: list[HashArray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[HashArray | None] = field(default_factory=list)
    weights: list[np.ndarray | None] = field(default_factory=list)
    floor: np.ndarray | None = None
    #: Mean cross-entropy of own texts, its variance between texts, and the variance of one symbol's.
    calibration: np.ndarray | None = None

    def log_probs(self, key: np.ndarray) -> np.ndarray:
        """A row of log probabilities, one for each language, for each key."""
        return self._at(key, ORDER - 1)

    def _at(self, key: np.ndarray, k: int) -> np.ndarray:
        own = key & _MASKS[k + 1]
        place = self.keys[k].find(own)
        out = self.logs[k][place]
        lost = np.flatnonzero(place < 0)
        if len(lost):
            if k == 0:
                out[lost] = self.floor
            else:
                low = self._at(key[lost], k - 1)
                context = self.contexts[k].find(own[lost] >> np.uint64(_BITS))
                seen = context >= 0
                low[seen] += self.weights[k][context[seen]]
                out[lost] = low
        return out


def fit(langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from counts of the longest n-grams (language number, key, count)."""
    L = len(langs)
    model = Model(langs)
    # per order from the longest down: distinct (language, key) and their (continuation) counts
    tables = []
    for k in range(ORDER - 1, -1, -1):
        tables.append((lang, key, count))
        shorter = key & _MASKS[k]
        order = np.lexsort((shorter, lang))
        la, ke = lang[order], shorter[order]
        new = np.ones(len(la), bool)
        new[1:] = (la[1:] != la[:-1]) | (ke[1:] != ke[:-1])
        first = np.flatnonzero(new)
        lang, key, count = la[first], ke[first], np.diff(np.append(first, len(la))).astype(np.float64)
    tables = tables[::-1]
    symbols = len(np.unique(tables[0][1])) + 1
    model.floor = np.full(L, -np.log(symbols), np.float32)
    lower = None
    for k, (la, ke, co) in enumerate(tables):
        co = co.astype(np.float64)
        keys = np.unique(ke)
        own = HashArray.of(keys)
        keys = keys[own.order]
        dense = np.zeros((len(keys), L))
        at = own.find(ke)
        dense[at, la] = co
        discount = np.zeros(L)
        for i in range(L):
            ones, twos = (dense[:, i] == 1).sum(), (dense[:, i] == 2).sum()
            discount[i] = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = keys >> np.uint64(_BITS)
        held = HashArray.of(np.unique(context))
        place = held.find(context)
        total, kinds = np.zeros((len(held.order), L)), np.zeros((len(held.order), L))
        np.add.at(total, place, dense)
        np.add.at(kinds, place, dense > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gamma = np.where(total > 0, discount * kinds / total, 1.0)
            part = np.where(total[place] > 0, np.maximum(dense - discount, 0) / total[place], 0.0)
        below = np.exp(model._at(keys, k - 1)) if k else np.full((len(keys), L), 1 / symbols)
        model.keys.append(own)
        model.logs.append(np.log(part + gamma[place] * below).astype(np.float32))
        model.contexts.append(held)
        model.weights.append(np.log(np.maximum(gamma, 1e-12)).astype(np.float32))
        if k == 0:
            model.floor = (np.log(np.maximum(gamma[0], 1e-12)) - np.log(symbols)).astype(np.float32) if len(gamma) else model.floor
    return model


def _entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: symbols, sums of log probabilities and of their squares, by language."""
    key, bounds = grams(texts)
    n = np.maximum(np.diff(bounds), 0)
    sums, squares = np.zeros((len(texts), len(model.langs))), np.zeros((len(texts), len(model.langs)))
    step = 1 << 17
    text = np.repeat(np.arange(len(texts)), n)
    key = key[bounds[0] : bounds[0] + len(text)]
    for i in range(0, len(key), step):
        logs = model.log_probs(key[i : i + step]).astype(np.float64)
        own = text[i : i + step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[first]] += np.add.reduceat(logs, first, axis=0)
        squares[own[first]] += np.add.reduceat(logs * logs, first, axis=0)
    return n, sums, squares


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and deviation from the language's own texts, for each text.

    The lowest cross-entropy wins (ties: the first in code point order). The score is its share of the
    languages' likelihoods over SCORE_CHARS symbols at most, less where rejection is near.
    """
    lang, score, off = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf)
    known = [i for i, t in enumerate(texts) if t and _has_letter(t)]
    if model is None or not known:
        return lang, score, off
    n, sums, _ = _entropies(model, [texts[i] for i in known])
    n = np.maximum(n, 1)
    cross = -sums / n[:, None]
    best = cross.argmin(axis=1)
    low = cross[np.arange(len(best)), best]
    share = 1 / np.exp(-(cross - low[:, None]) * np.minimum(n, SCORE_CHARS)[:, None]).sum(axis=1)
    mean, between, within = model.calibration[best].T
    z = (low - mean) / np.sqrt(between + within / n)
    for i, b in zip(known, best):
        lang[i] = model.langs[b]
    score[known] = share / (1 + np.exp(np.clip(z - REJECT, -50, 50)))
    off[known] = z
    return lang, score, off


def _counted(labelled: DataFrame) -> DataFrame:
    """lang, key, n: the n-grams of all labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                key, n = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "key", "n"])
            held.clear()

        for batch in pieces(batches, "text"):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                key, bounds = grams(texts)
                own = np.unique(key[bounds[0] :], return_counts=True)
                held.setdefault(lang, []).append(own)
                size += len(own[0])
                if len(held[lang]) >= 16:
                    size -= sum(len(k) for k, _ in held[lang])
                    held[lang] = [_summed(held[lang])]
                    size += len(held[lang][0][0])
            if size > 4_000_000:
                yield from merged()
                size = 0
        yield from merged()

    rows = labelled.select("lang", "text").transform(arrow_map, run, "lang string, key long, n long")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    out, at = np.unique(key, return_inverse=True)
    return out, np.bincount(at, n, len(out)).astype(np.int64)


def _packed(counted: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The counts on the driver as language, keys and counts, fetched part by part as plain bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            which, key, n = coded.indices.to_numpy(), batch.column("key").to_numpy(), batch.column("n").to_numpy()
            own = [np.flatnonzero(which == i) for i in range(len(coded.dictionary))]
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array([key[i].tobytes() for i in own], pa.binary()), pa.array([n[i].tobytes() for i in own], pa.binary())], ["lang", "key", "n"]
            )

    # written first, so that fetching one part after the other doesn't count anew
    rows = materialise(counted, "grams").transform(arrow_map, run, "lang string, key binary, n binary").toLocalIterator()
    return [(r.lang, np.frombuffer(r.key, np.uint64), np.frombuffer(r.n, np.int64)) for r in rows]


def train(labelled: DataFrame) -> Model | None:
    """A model of every language of ``labelled`` (lang, text, doc_id); None where it has no text with a letter.

    N-grams are counted over all rows and all of them are in the model, which comes to the driver with the
    sums of all rows' cross-entropies.
    """
    labelled = labelled.where("lang is not null and text is not null")
    parts = _packed(_counted(labelled).where(F.col("key") != 32))
    if not parts:
        return None
    langs = sorted({x for x, _, _ in parts}, key=str.encode)
    number = {x: i for i, x in enumerate(langs)}
    lang = np.repeat([number[x] for x, _, _ in parts], [len(k) for _, k, _ in parts])
    key = np.concatenate([k for _, k, _ in parts])
    count = np.concatenate([n for _, _, n in parts])
    order = np.lexsort((key, lang))
    model = fit(langs, lang[order], key[order], count[order])
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(held.value.langs)}
        for batch in pieces(batches, "text"):
            n, sums, squares = _entropies(held.value, batch.column("text").to_pylist())
            own = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()])
            ok = np.flatnonzero((n > 0) & (own >= 0))
            own, n = own[ok], n[ok]
            mean = -sums[ok, own] / n
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(n), pa.array(mean), pa.array(squares[ok, own] / n - mean**2)], ["own", "n", "h", "v"]
            )

    # copies of a text say nothing of the variance between texts
    each = labelled.select("lang", "text").transform(arrow_map, run, "own long, n long, h double, v double").groupBy("own", "n", F.round("h", 9).alias("h")).agg(F.first("v").alias("v"))
    fitted = each.groupBy("own").agg(F.count("*").alias("k"), F.avg("h").alias("h"), F.coalesce(F.var_samp("h"), F.lit(0.0)).alias("s"), F.avg("v").alias("v")).collect()
    free = sum(r.k - 1 for r in fitted)
    pooled = sum((r.k - 1) * r.s for r in fitted) / free if free else 1.0
    model.calibration = np.tile([3.0, 1.0, 4.0], (len(langs), 1))
    for r in fitted:
        between = ((r.k - 1) * r.s + POOLED * pooled) / (r.k - 1 + POOLED)
        model.calibration[r.own] = r.h, max(between, 1e-4), max(r.v, 1e-2)
    return model


def label_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred, score and deviation (see ``predict``).

    Null text and text without a letter is ``und`` with score 0, and so is everything where nothing was
    learnt. Existing columns of these names are replaced. Whole texts are read, of any length.
    """
    docs = docs.drop("lang_pred", "score", "deviation")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lang, score, off = predict(held.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(off)], [*batch.schema.names, "lang_pred", "score", "deviation"])

    return docs.transform(arrow_map, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string, score double, deviation double"]))


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, in their own columns, less those of no language: ``und`` or beyond the calibrated limit."""
    own = docs.select("doc_id", "text", *[F.col(c).alias(f"own_{c}") for c in docs.columns if c not in ("doc_id", "text")])
    told = label_languages(own, model).where((F.col("lang_pred") != "und") & (F.col("deviation") <= REJECT))
    return told.select(*[c if c in ("doc_id", "text") else F.col(f"own_{c}").alias(c) for c in docs.columns])


def held_out(docs: DataFrame) -> F.Column:
    """Rows whose labels training never sees; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(docs)))
    return label_languages(docs.select("doc_id", held_out(docs).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
