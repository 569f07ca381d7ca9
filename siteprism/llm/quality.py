"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, pieces, table, utf8

#: Labelled rows in training, about, and their lines together, beyond which fewer rows are taken (each with all its lines).
LABELLED_ROWS, LABELLED_LINES = 6_000, 2_400_000
#: Score from which a document is predicted good.
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _PIPE, _BANG, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = _UPPER, _LOWER, _LOWER, _DIGIT
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[list(b".,;:?'\"()-")] = _STOP
_CLASS[ord("|")], _CLASS[ord("!")] = _PIPE, _BANG
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: Features of a line by itself; those of the line before and after come beside them.
OWN = 14


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over [start, end) of each line."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, the lines' bytes, and where each text's lines begin (one more at the end).

    A text of no bytes has one empty line.
    """
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(breaks, offsets)  # line breaks before each text
    counts = np.diff(own) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[first[:-1]], starts[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[first[1:] - 1], ends[inner] = offsets[1:], breaks
    n = len(starts)
    size = ends - starts
    kind = _CLASS[data]
    counted = [_sums(kind == k, starts, ends) for k in range(8)]
    letters = np.maximum(counted[_UPPER] + counted[_LOWER], 1)
    solid = kind != _SPACE
    begin = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(data) else np.zeros(0, np.int64)
    # a text's first byte begins a word even where the text before it ends in one
    edge = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    edge = edge[solid[edge]] if len(edge) else edge
    begin = np.union1d(begin, edge)
    line = np.searchsorted(starts, begin, "right") - 1 if len(begin) else np.zeros(0, np.int64)
    words = np.bincount(line, minlength=n)
    repeats = np.zeros((2, n))
    if len(begin):
        place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))) if begin[0] == 0 else np.concatenate([np.zeros(begin[0], np.int64), np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))])
        code = np.add.reduceat(np.where(solid, _BYTE[data] * _PLACE[place & 63], np.uint64(0)), begin)
        for k, lag in enumerate((1, 2)):
            same = (code[lag:] == code[:-lag]) & (line[lag:] == line[:-lag])
            repeats[k] = np.bincount(line[lag:][same], minlength=n)
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(n, np.uint8)
    head = data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else np.zeros(n, np.uint8)
    many = np.maximum(words, 1)
    x = np.stack(
        [
            np.ones(n),
            counted[_UPPER] / letters,
            np.minimum(counted[_OTHER] / many, 3),
            np.minimum(counted[_PIPE] / many, 1),
            np.minimum(counted[_BANG] / many, 3),
            counted[_DIGIT] / np.maximum(size, 1),
            counted[_STOP] / many,
            repeats[0] / many,
            repeats[1] / many,
            np.minimum(letters / many, 20) / 10,
            np.log1p(words) / 5,
            np.isin(last, list(b".?!\"'")) & (size > 0),
            (head >= 65) & (head <= 90) & (size > 0),
            size == 0,
        ],
        axis=1,
    ).astype(np.float32)
    return x, size, first


def beside(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features with those of the line before and the line after in its text (zeros where none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def _message(m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of good for the next line, from those of this one, over transitions t[from, to]."""
    return np.logaddexp(t[0, 1], m + t[1, 1]) - np.logaddexp(t[0, 0], m + t[1, 0])


def forward_backward(unary: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward, backward and marginal log odds of good for every line, all texts a line at a time.

    Only differences matter for two labels, so nothing overflows, however many lines a text has.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, counts = first[:-1][order], counts[order]
    forward, backward = unary.astype(np.float64).copy(), np.zeros(len(unary))
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(1, longest + 1), "right")
    for s in range(1, longest):
        at = starts[: active[s]] + s
        forward[at] += _message(forward[at - 1], t)
    for s in range(longest - 2, -1, -1):
        at = starts[: active[s + 1]] + s
        backward[at] = _message(unary[at + 1] + backward[at + 1], t.T)
    return forward, backward, forward + backward


@dataclass
class Model:
    """Weights of a line's log odds, log transitions, and the logistic curve from mean marginal to score."""

    weights: np.ndarray
    transitions: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    def mean_good(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of good, of each text."""
        _, _, odds = forward_backward(beside(x, first) @ self.weights, first, self.transitions)
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        weight = np.maximum(size, 1)
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)

    def scores(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.mean_good(x, size, first), -50, 50)))


def _ascend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, first: np.ndarray, model: Model, steps: int, penalty: float) -> Model:
    """Adam on the conditional likelihood of the line labels y; ``weight`` is of each line's text."""
    w, t = model.weights.copy(), model.transitions.copy()
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    pair = np.flatnonzero(inner)
    theta = np.concatenate([w, t.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for step in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        unary = x @ w
        forward, backward, odds = forward_backward(unary, first, t)
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        grad_w = x.T @ (weight * (y - good)) / total
        a, b = forward[pair - 1], unary[pair] + backward[pair]
        joint = np.stack([np.full(len(pair), t[0, 0]), t[0, 1] + b, t[1, 0] + a, t[1, 1] + a + b])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        seen = np.zeros((4, len(pair)))
        seen[(2 * y[pair - 1] + y[pair]).astype(int), np.arange(len(pair))] = 1
        grad_t = ((seen - joint) * weight[pair]).sum(axis=1) / total
        grad = np.concatenate([grad_w, grad_t]) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 120, rounds: int = 3) -> Model:
    """A model from texts' labels (1 good, 0 bad).

    Every line of a good text is good. Those of a bad text start as bad; then lines that the model holds to be
    good are relabelled, but for the worst one, and the field is fitted again.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    y = label[text].astype(np.float64)
    share = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    weight = (share / counts)[text]
    wide = beside(x, first).astype(np.float64)
    model = Model(np.zeros(wide.shape[1]), np.zeros((2, 2)))
    for _ in range(rounds):
        model = _ascend(wide, y, weight, first, model, steps, 1e-4)
        _, _, odds = forward_backward(wide @ model.weights, first, model.transitions)
        worst = np.minimum.reduceat(odds, first[:-1])[text]
        y = np.where(label[text] == 1, 1.0, np.where((odds > 0) & (odds > worst), 1.0, 0.0))
    mean = model.mean_good(x, size, first)
    a, b = 0.0, 1.0
    for _ in range(3000):  # the curve: logistic regression in one variable, classes weighing alike
        p = 1 / (1 + np.exp(-(a + b * mean)))
        g = share * (label - p)
        a, b = a + 8 * (g.sum() - 1e-4 * a), b + 8 * ((g * mean).sum() - 1e-4 * b)
    model.curve = (float(a), float(b))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality), on a bounded sample of labelled rows.

    The sample takes rows by a hash of doc_id, whole texts always; while they have over LABELLED_LINES lines it
    is halved, unless that would leave labels of one kind only. A document labelled twice counts as the lower
    label. Where no labels of one kind or none are left, everything scores 0.5.
    """
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = labels.count()
    every = max(1, -(-n // LABELLED_ROWS))
    place = F.xxhash64("doc_id", F.lit(1))
    sample = labels.where(F.pmod(place, F.lit(every)) == 0)
    # the sample is bounded by LABELLED_ROWS, whatever the input, so it can be broadcast
    held = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    lines = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]", "")) + 1
    sizes = held.select(place.alias("place"), "quality", lines.alias("lines")).collect()
    while sum(r.lines for r in sizes) > LABELLED_LINES:
        half = [r for r in sizes if r.place % (2 * every) == 0]
        if len({r.quality for r in half}) < 2:
            break
        every, sizes = 2 * every, half
    held = held.where(F.pmod(place, F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x, size, first = line_features(*utf8(batch.column("text")))
            for i, (doc, q) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist())):
                rows = slice(first[i], first[i + 1])
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([q], pa.int32()), pa.array([x[rows].tobytes()]), pa.array([size[rows].tobytes()])], ["doc_id", "quality", "x", "size"])

    rows = sorted(held.transform(arrow_map, run, "doc_id long, quality int, x binary, size binary").toLocalIterator(), key=lambda r: (r.doc_id, bytes(r.x)))
    if len({r.quality for r in rows}) < 2:
        return Model(np.zeros(3 * OWN), np.zeros((2, 2)), (0.0, 0.0))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, OWN) for r in rows])
    size = np.concatenate([np.frombuffer(r.size, np.int64) for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r.size) // 8 for r in rows])])
    return fit(x, size, first, np.array([r.quality for r in rows]))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and what else ``docs`` has besides its text, with score and predicted.

    Whole texts are scored; null counts as empty, which is one empty line. Equal texts score alike, and repeated
    rows stay. Existing columns named score and predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            parts = [line_features(*utf8(p.column("text"))) for p in pieces([batch], "text")]
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, _, f in parts]))])
            score = held.value.scores(np.concatenate([x for x, _, _ in parts]), np.concatenate([s for _, s, _ in parts]), first)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*rest, "score", "predicted"])

    kept = docs.drop("text")
    return docs.transform(arrow_map, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["score double, predicted int"]))


def held_out(docs: DataFrame) -> F.Column:
    """Rows whose labels training never sees; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out(labels)))
    return score_documents(docs.select("doc_id", held_out(docs).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
