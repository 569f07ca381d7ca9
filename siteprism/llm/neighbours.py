"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, materialise, table

#: Neighbours of a query; hash tables.
K, TABLES = 20, 8
#: Queries whose true neighbours fix how far all probe, and the share of these neighbours that must be within reach.
PILOT, REACH = 64, 0.95
#: Vectors and queries of a cell that meet in one group at most, about. Rows of a probing batch.
BLOCK, ROWS = 1024, 8192
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        y[:, :, 0], y[:, :, 1] = a, b
        h *= 2
    return x / np.sqrt(n)


def rotated(unit: np.ndarray, t: int, j: int) -> np.ndarray:
    """The pseudo-rotation of table t's function j: three rounds of random signs and a Hadamard transform."""
    signs = np.random.default_rng([SEED, t, j])
    for _ in range(3):
        unit = hadamard(unit * signs.choice([-1.0, 1.0], unit.shape[1]))
    return unit


def axis_scores(unit: np.ndarray, t: int, j: int, axes: int) -> np.ndarray:
    """Nearness of each row to the first ``axes`` axes either way (positive ones first)."""
    y = rotated(unit, t, j)[:, :axes]
    return np.concatenate([y, -y], axis=1)


def gaps(unit: np.ndarray, t: int, j: int, axes: int) -> np.ndarray:
    """What each signed axis falls short of the nearest one, squared: how far a probe must reach for it."""
    y = axis_scores(unit, t, j, axes)
    return ((y.max(axis=1, keepdims=True) - y) ** 2).astype(np.float32)


def functions(n: int, width: int) -> list[int]:
    """Axes of a table's hash functions, the last ones fewer, so that there are about as many buckets as vectors."""
    out, buckets = [], 1
    while buckets < n or not out:
        axes = 1
        while axes < width and buckets * 2 * axes < n:
            axes *= 2
        out.append(axes)
        buckets *= 2 * axes
    return out


@dataclass(frozen=True)
class Index:
    """What hashing depends on: dimensions, the largest component, the longest vector measured by it, element type, and the functions' axes."""

    dims: int
    largest: float
    longest: float
    kind: str
    axes: tuple[int, ...]

    @property
    def width(self) -> int:
        return 1 << self.dims.bit_length()

    @property
    def code(self) -> str:
        """The type of a place among the axes of all functions but the first."""
        return "<u2" if 2 * sum(self.axes[1:]) < 1 << 16 else "<u4"

    @property
    def places(self) -> np.ndarray:
        """Where each function's axes begin among those of all functions but the first, and where the last's end."""
        return np.cumsum([0, *(2 * a for a in self.axes[1:])])

    def matrix(self, blobs: list[bytes]) -> np.ndarray:
        out = np.zeros((len(blobs), self.dims), self.kind)
        for i, b in enumerate(blobs):
            row = np.frombuffer(b, self.kind)
            out[i, : len(row)] = row
        return out


def lifted(x: np.ndarray, width: int, largest: float, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose angles order as inner products do.

    A vector, shortened by the longest one's length, gets one more component that makes its length 1; a query
    is only scaled and has zero there. So the largest inner product is the smallest angle, whatever the lengths.
    Lengths are measured in units of the ``largest`` component (a query's of its own), so that no square under- or overflows.
    """
    out = np.zeros((len(x), width))
    x = x.astype(float)
    x = x / (np.abs(x).max(axis=1, keepdims=True) if query else largest)
    norm = np.linalg.norm(x, axis=1)
    scale = norm if query else np.full(len(x), longest)
    out[:, : x.shape[1]] = x / scale[:, None]
    if not query:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, always summed in the same order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose id isn't null and whose vector has finite components, one of them not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0))


def _blobs(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, vec: the components as plain bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("embedding")
            values = np.ascontiguousarray(held.flatten().to_numpy(), kind)
            ends = (held.offsets.to_numpy() - held.offsets[0].as_py()) * values.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), blobs], ["vec_id", "vec"])

    return vectors.select("vec_id", "embedding").transform(arrow_map, run, "vec_id long, vec binary")


def _hashed(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, vec, home: the signed axis of each table's first function, fine: those of its other functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                unit = lifted(index.matrix(batch.column("vec").to_pylist()), index.width, index.largest, index.longest, False)
                code = np.stack([np.stack([axis_scores(unit, t, j, a).argmax(axis=1) for j, a in enumerate(index.axes)], axis=1) for t in range(TABLES)], axis=1)
                code[:, :, 1:] += index.places[:-1]
                fine = [[r.tobytes() for r in v] for v in code[:, :, 1:].astype(index.code)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code[:, :, 0].tolist(), pa.list_(pa.int32())), pa.array(fine, pa.list_(pa.binary()))], ["vec_id", "vec", "home", "fine"])

    return vectors.transform(arrow_map, run, "vec_id long, vec binary, home array<int>, fine array<binary>")


def _reach(held: DataFrame, asked: DataFrame, index: Index, k: int) -> float:
    """The summed gap up to which buckets are probed: REACH of the true neighbours of PILOT queries are that near.

    The pilot queries, chosen by a hash of their ids, are compared with all vectors in one pass. Where they
    have fewer than ``k`` neighbours each, all buckets are within reach.
    """
    pilot = asked.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(PILOT).collect()
    ids, q = np.array([r.vec_id for r in pilot]), index.matrix([r.vec for r in pilot]).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            score = q @ index.matrix(batch.column("vec").to_pylist()).T.astype(float)
            vec = batch.column("vec_id").to_numpy()
            score[ids[:, None] == vec[None, :]] = -np.inf
            n = min(k, batch.num_rows)
            at = np.argpartition(-score, n - 1, axis=1)[:, :n] if n else np.zeros((len(q), 0), int)
            p, at = np.repeat(np.arange(len(q)), n), at.ravel()
            s = score[p, at]
            own = pa.Table.from_arrays([pa.array(p), pa.array(s), *(batch.column(c).take(pa.array(at)) for c in ("vec_id", "home", "fine"))], ["p", "score", "vec_id", "home", "fine"]).filter(pa.array(s > -np.inf))
            best = own if best is None else pa.concat_tables([best, own])
            best = best.take(pa.array(_best_places(best["p"].to_numpy(), best["score"].to_numpy(), best["vec_id"].to_numpy(), k)))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    found = held.transform(arrow_map, run, "p long, score double, vec_id long, home array<int>, fine array<binary>")
    rank = F.row_number().over(W.partitionBy("p").orderBy(F.desc("score"), "vec_id"))
    near = found.withColumn("rank", rank).where(F.col("rank") <= k).collect()  # PILOT times k rows at most
    if not near or max(r.rank for r in near) < k:
        return np.inf
    unit = lifted(q, index.width, 1.0, 1.0, True)
    p, need = np.array([r.p for r in near]), np.full(len(near), np.inf)
    for t in range(TABLES):
        fine = np.array([np.frombuffer(r.fine[t], index.code) for r in near]).reshape(len(near), -1).astype(int) - index.places[:-1]
        code = np.column_stack([[r.home[t] for r in near], fine]).astype(int)
        need = np.minimum(need, sum(gaps(unit, t, j, a)[p, code[:, j]] for j, a in enumerate(index.axes)))
    return float(np.quantile(need, REACH, method="higher"))


def _best_places(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best."""
    order = np.lexsort((vec, -score, query))
    own = query[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def probes(x: np.ndarray, index: Index, reach: float, filled: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Table, queries' places, cells, what is left of the reach there, and the codes and gaps of other functions within it.

    A cell is a signed axis of the table's first function; ``filled`` tells which hold any vector.
    """
    unit = lifted(x, index.width, 1.0, 1.0, True)
    for t in range(TABLES):
        first = gaps(unit, t, 0, index.axes[0])
        rest = [gaps(unit, t, j, a) for j, a in enumerate(index.axes) if j]
        fine = np.concatenate(rest, axis=1) if rest else np.zeros((len(x), 0), np.float32)
        at, cell = np.nonzero((first <= reach) & filled[t])
        for i in range(0, len(at), ROWS):
            own, b = at[i : i + ROWS], cell[i : i + ROWS]
            left = (reach - first[own, b]).astype(np.float32)
            gap = fine[own]
            row, code = np.nonzero(gap <= left[:, None])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(own)))])
            yield t, own, b, left, _binary(code.astype(index.code), ends), _binary(gap[row, code], ends)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the values between ends."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _probing(asked: DataFrame, index: Index, reach: float, filled: np.ndarray) -> DataFrame:
    """vec_id, vec, t, b, rest, codes, gaps: a query at each cell within its reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                for t, at, b, left, codes, gap in probes(index.matrix(batch.column("vec").to_pylist()), index, reach, filled):
                    own = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(own), batch.column("vec").take(own), pa.array(np.full(len(at), t, np.int32)), pa.array(b.astype(np.int32)), pa.array(left), codes, gap], ["vec_id", "vec", "t", "b", "rest", "codes", "gaps"])

    return asked.transform(arrow_map, run, "vec_id long, vec binary, t int, b int, rest float, codes binary, gaps binary")


def selected(index: Index, rest: np.ndarray, codes: list[bytes], gap: list[bytes], own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Queries' and vectors' places of a cell's pairs whose other functions' gaps together are within the rest."""
    if len(index.axes) == 1:
        return np.nonzero(np.ones((len(rest), len(own)), bool))
    at = np.frombuffer(b"".join(codes), index.code).astype(int)
    row = np.repeat(np.arange(len(codes)), np.array([len(c) for c in codes]) // np.dtype(index.code).itemsize)
    need = np.full((len(codes), index.places[-1]), np.inf, np.float32)
    need[row, at] = np.frombuffer(b"".join(gap), np.float32)
    code = np.frombuffer(b"".join(own), index.code).reshape(len(own), -1).astype(int)
    total = sum(need[:, code[:, j]] for j in range(code.shape[1]))
    return np.nonzero(total <= rest[:, None])


def top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, a vector counting once."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    same = np.zeros(len(query), bool)
    same[1:] = (query[1:] == query[:-1]) & (vec[1:] == vec[:-1])
    query, vec, score = query[~same], vec[~same], score[~same]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], vec[rank < k], score[rank < k]


def _met(both: DataFrame, index: Index, k: int) -> DataFrame:
    """Per partition and query the best of its candidates there; rows lie group by group, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, due = 0, 200_000
        # queries that have k already, and their last score: what is below it needs no more work
        full, least = np.zeros(0, np.int64), np.zeros(0)

        def emit() -> Iterator[pa.RecordBatch]:
            if found:
                q, v, s = top(*map(np.concatenate, zip(*found)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])
                found.clear()

        for group in _groups(batches):
            side, ids = group["side"], group["vec_id"]
            first = int(np.searchsorted(side, 1))
            if not 0 < first < len(side):
                continue
            x = index.matrix(group["vec"])
            q, v, qid, vid = x[:first], x[first:], ids[:first], ids[first:]
            row, col = selected(index, group["rest"][:first], group["codes"][:first], group["gaps"][:first], group["codes"][first:])
            other = qid[row] != vid[col]
            row, col = row[other], col[other]
            bar = np.full(first, -np.inf)
            if len(full):
                at = np.minimum(np.searchsorted(full, qid), len(full) - 1)
                bar = np.where(full[at] == qid, least[at] - 1e-4 * np.linalg.norm(q, axis=1) * index.longest, -np.inf)
            for i in range(0, len(row), 1 << 17):
                r, c = row[i : i + (1 << 17)], col[i : i + (1 << 17)]
                good = np.einsum("ij,ij->i", q[r], v[c]) >= bar[r]
                r, c = r[good], c[good]
                found.append((qid[r], vid[c], exact_products(q[r].astype(float), v[c].astype(float))))
                size += len(r)
                if size > due:
                    found[:] = [top(*map(np.concatenate, zip(*found)), k)]
                    qs, _, ss = found[0]
                    last = np.flatnonzero(np.arange(len(qs)) - np.searchsorted(qs, qs) == k - 1)
                    full, least, size = qs[last], ss[last], len(qs)
                    due = max(200_000, 2 * size)
                    if size > 500_000:
                        yield from emit()
                        size = 0
        yield from emit()

    return both.transform(arrow_map, run, "query_id long, vec_id long, score double")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of each (t, b, vb, qb) in turn: side (0 query, 1 vector), ids, vectors, and what tells candidates."""
    held: list[pa.RecordBatch] = []
    at = None

    def done() -> dict:
        t = pa.Table.from_batches(held).select(["side", "vec_id", "vec", "rest", "codes", "gaps"])
        return {c: t[c].to_pylist() if c in ("vec", "codes", "gaps") else t[c].to_numpy() for c in t.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("t", "b", "vb", "qb")], axis=1)
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        for a, b in zip(cut[:-1], cut[1:]):
            own = tuple(key[a])
            if own != at and held:
                yield done()
                held = []
            at = own
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def _table_of(counts: DataFrame, cells: int) -> np.ndarray:
    """Counts by table and cell; at most TABLES times the cells of a table come to the driver."""
    out = np.zeros((TABLES, cells), np.int64)
    for r in counts.toLocalIterator():
        out[r.t, r.b] = r.n
    return out


def _candidates(held: DataFrame, asked: DataFrame, index: Index, reach: float, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query among the vectors in buckets within its reach."""
    cells = 2 * index.axes[0]
    homes = held.select("vec_id", "vec", "fine", F.posexplode("home").alias("t", "b")).select("vec_id", "vec", "t", "b", F.col("fine")[F.col("t")].alias("codes"))
    counts = _table_of(homes.groupBy("t", "b").agg(F.count("*").alias("n")), cells)
    probing = _probing(asked, index, reach, counts > 0)
    load = _table_of(probing.groupBy("t", "b").agg(F.count("*").alias("n")), cells)
    blocks = asked.sparkSession.createDataFrame(
        [(t, b, int(-(-counts[t, b] // BLOCK)), int(-(-load[t, b] // BLOCK))) for t in range(TABLES) for b in range(cells) if counts[t, b] and load[t, b]] or [(-1, -1, 1, 1)],
        "t int, b int, vbs int, qbs int",
    )
    # a row for each cell, TABLES times 4 * dims at most, so it can be broadcast
    to = F.broadcast(blocks)
    own = F.xxhash64("vec_id")
    left = probing.join(to, ["t", "b"]).select("t", "b", F.explode(F.sequence(F.lit(0), F.col("vbs") - 1)).alias("vb"), F.pmod(own, F.col("qbs")).cast("int").alias("qb"), F.lit(0).alias("side"), "vec_id", "vec", "rest", "codes", "gaps")
    right = homes.join(to, ["t", "b"]).select("t", "b", F.pmod(own, F.col("vbs")).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), F.lit(1).alias("side"), "vec_id", "vec", F.lit(0.0).cast("float").alias("rest"), "codes", F.lit(b"").alias("gaps"))
    both = left.unionByName(right).repartition("t", "b", "vb", "qb").sortWithinPartitions("t", "b", "vb", "qb", "side")
    best = _met(both, index, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query among all vectors but its own.

    ``vectors`` and ``queries`` have vec_id and embedding. Every usable vector is hashed in each table to a
    bucket by its nearest signed axes under several rotations (``functions``: the more vectors, the finer); a
    query probes the buckets whose axes together fall short of its own nearest ones by at most a reach that
    ``_reach`` fits. Rows meet by the first function's axis (a cell), of which vectors and queries are cut into
    blocks where crowded; only pairs of probed buckets are scored, exactly. A query that has found fewer than
    ``k`` probes everything. Of equal vectors only the k + 1 least ids take part, as no more can be among k nearest.
    Vectors shorter than the longest count as ending in zeros. Components may be of any finite size (inner products
    themselves are what double precision makes of them). Rows with one vec_id are one vector: the best of
    them counts, and none is a neighbour of its own query. No usable vector or query gives an empty result.
    """
    spark = vectors.sparkSession
    plain = all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (vectors, queries))
    vectors, queries = (usable(df).select("vec_id", F.col("embedding").cast(f"array<{'float' if plain else 'double'}>").alias("embedding")) for df in (vectors, queries))
    part = lambda x: F.abs(x.cast("double"))
    told = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.max(F.array_max(F.transform("embedding", part))).alias("largest")).first()
    widest = queries.agg(F.max(F.size("embedding")).alias("d")).first().d
    if not told.n or not widest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.pow(part(x) / told.largest, F.lit(2.0)))
    longest = vectors.agg(F.max(square)).first()[0]
    dims = max(told.d, widest)
    index = Index(dims, told.largest, float(np.sqrt(longest)), "<f4" if plain else "<f8", tuple(functions(told.n, 1 << dims.bit_length())))
    copy = F.row_number().over(W.partitionBy(F.md5("vec")).orderBy("vec_id"))
    distinct = _blobs(vectors, index.kind).withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    held = materialise(_hashed(distinct, index), "vectors")
    asked = materialise(_blobs(queries, index.kind), "queries")
    reach = _reach(held, asked, index, k)
    found = _candidates(held, asked, index, reach, k)
    if reach == np.inf:
        return found
    found = materialise(found, "found")
    done = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(done, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    again = _candidates(held, materialise(short, "short"), index, np.inf, k)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
