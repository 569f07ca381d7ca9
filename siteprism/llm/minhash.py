"""HyperMinHash near-duplicate detection: compressed registers are banded, Jaccard is estimated, whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, materialise, pieces, raw, table
from siteprism.llm.components import connected_components
from siteprism.llm.simhash import shingle_hashes, similar

#: Words in a shingle. The similarity that links, 0.8, is SIMILARITY of the set join this rests on.
WORDS = 4
#: Bands, registers in each (three of 16 bits fit a key), and mantissa bits of a register below its 6 bits of leading zeros.
BANDS, ROWS, MANTISSA = 24, 3, 10
REGISTERS = BANDS * ROWS
#: Pairs estimated below this are not verified: a pair 0.8 alike is with probability under 1e-9.
LIKELY = 0.45
#: Chance that a register of two sets of one size agrees though their least hashes differ, times 2^MANTISSA (a fixed value, HyperMinHash's).
COLLISION = 0.169919487159739093975315012348

_NONE = np.iinfo(np.uint64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least of the remixed hashes in each of the REGISTERS buckets that their upper halves choose; all ones where a bucket is empty."""
    out = np.full(REGISTERS, _NONE, np.uint64)
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    np.minimum.at(out, bucket.astype(np.int64), _mixed(hashes) >> np.uint64(1))
    return out


@cache
def _turns() -> np.ndarray:
    """Place of every bucket in the order in which a register looks for one that is filled: its own first."""
    turns = np.random.default_rng(12).random((REGISTERS, REGISTERS))
    np.fill_diagonal(turns, -1.0)
    return turns.argsort(axis=1).argsort(axis=1).astype(np.int16)


def filled(least: np.ndarray) -> np.ndarray:
    """Rows of least values with every empty bucket filled from the first filled one of its own fixed order.

    Two sets' registers then agree with the probability of their similarity, small sets' as well. A row without
    any value stays as it is.
    """
    empty = least == _NONE
    for i in np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1)):
        turns = np.where(empty[i], np.int16(REGISTERS), _turns()[empty[i]])
        least[i, empty[i]] = least[i, turns.argmin(axis=1)]
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros of each 63-bit value, and the MANTISSA bits after its first one."""
    v = (least << np.uint64(1)) | np.uint64(1)
    zeros = np.zeros(v.shape, np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = v >> np.uint64(64 - step) == 0
        zeros += np.where(high, np.uint64(step), np.uint64(0))
        v = np.where(high, v << np.uint64(step), v)
    return zeros << np.uint64(MANTISSA) | (v << np.uint64(1)) >> np.uint64(64 - MANTISSA)


def band_keys(least: np.ndarray) -> np.ndarray:
    """For every row a long for each band: its number and its registers, which can be read back from it."""
    r = registers(filled(least)).reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) << np.uint64(48), r.shape[:2])
    for i in range(ROWS):
        key = key | r[:, :, i] << np.uint64(16 * i)
    return key.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp (a hash of the shingle set), n (its size) and keys (its bands; none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            fp, n = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            least = np.full((batch.num_rows, REGISTERS), _NONE, np.uint64)
            for i, t in enumerate(raw(batch.column("text"))):
                shingles = np.unique(shingle_hashes(t, WORDS))
                n[i] = len(shingles)
                if n[i]:
                    fp[i], least[i] = xxhash.xxh3_64_intdigest(shingles.tobytes()), least_values(shingles)
            keys = band_keys(least)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(keys[n > 0]).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fp.view(np.int64)), pa.array(n), keys], ["doc_id", "th", "fp", "n", "keys"])

    return docs.select("doc_id", "th", "text").transform(arrow_map, run, "doc_id long, th long, fp long, n long, keys array<long>")


def estimate(x: Column, y: Column, n: Column, m: Column) -> Column:
    """Jaccard index of two sets by their keys and sizes: equal registers, less those expected to agree by chance."""
    differ = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    equal = lambda mask: F.size(F.filter(differ, lambda d: d.bitwiseAND(F.lit(mask)) == 0))
    same = sum((equal(0xFFFF << 16 * i) for i in range(ROWS)), F.lit(0))
    by_chance = F.lit(REGISTERS * COLLISION / 2**MANTISSA * 4) * n * m / ((n + m) * (n + m))
    return (same - by_chance) / REGISTERS


def _likely(sketches: DataFrame):
    """A step that keeps those of candidate pairs (a, b) whose estimate is not far below the limit."""

    def keep(pairs: DataFrame) -> DataFrame:
        own = materialise(sketches.where("n > 0").select("th", "n", "keys").dropDuplicates(["th"]), "registers")
        first, second = own.select(F.col("th").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("x")), own.select(F.col("th").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("y"))
        met = pairs.join(first, "a").join(second, "b")
        return met.where(estimate(F.col("x"), F.col("y"), F.col("n_a"), F.col("n_b")) >= LIKELY).select(*pairs.columns)

    return keep


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept, per document row.

    Links are between texts whose sets of four-word shingles are 0.8 alike or more. Texts of one set are one node
    (told by 64 bits of a hash, as shingles are), so copies are never paired. Bands of registers find candidates:
    a pair 0.8 alike shares one with probability 1 - 1e-7, more alike ones sooner; what crowds a band is linked
    exactly by its rarest shingles (see ``simhash.crowded``). Estimates put pairs aside that are far from alike,
    and whole sets decide. Null, empty and wordless texts have no shingles and stand alone. A null doc_id keeps
    its row, names a component only if no other does, and is kept only then. Repeated rows give repeated results;
    empty input gives an empty result. Further columns don't matter.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = materialise(_sketches(keyed), "registers")
    # texts of one set are alike in all there is to compare: one of them stands for all
    sets = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"))
    sets = materialise(sets, "sets")
    own = materialise(rows.join(sets.select("th"), "th", "left_semi"), "own")
    found = connected_components(similar(docs, own, _likely(own), WORDS, True))
    rooted = sets.join(found, sets.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    name = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(name, "root").select("fp", "component_id")
    some = rows.where("n > 0").select("doc_id", "n", "fp").join(named, "fp").select("doc_id", "n", "component_id")
    out = some.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
