"""Benchmark decontamination by a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, pieces, raw, table

#: Words in a window; a shorter item counts whole.
WINDOW = 10
#: Item words in one automaton (about 100 MB); more items make more automata, each with a pass of its own.
AUTOMATON_WORDS = 300_000

#: Byte to byte: A-Z to a-z, digits, a-z and bytes of non-ASCII letters as they are, all else to a space.
NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: bytes) -> list[bytes]:
    """Normalised words of UTF-8 text."""
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of word sequences that tells, word by word, the longest match with any item.

    Identical items share states; a match never runs across two items, as each starts at the root again.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items if ws]
        self.least = min([window, *(len(ws) for _, ws in coded)])
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: Items by the state of their window (or of the whole short item), with the length that counts.
        self.at: dict[int, dict[int, set[int]]] = {}
        for k, ws in coded:
            need, v, length = min(window, len(ws)), 0, 0
            for w in ws:
                v, length = self.step(v, length, w)
                if length >= need:
                    self.at.setdefault(self._shrink(v, need), {}).setdefault(need, set()).add(k)
        #: The nearest state at or above each one that completes an item's window.
        self.found = [-1] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.found[v] = v if v in self.at else self.found[self.link[v]] if v else -1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def _state(self, length: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of state q for the shorter of its strings, those that p reaches by w."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _shrink(self, v: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[v]] >= length:
            v = self.link[v]
        return v

    def step(self, v: int, length: int, w: int) -> tuple[int, int]:
        """State and longest match length after one more word."""
        while v and w not in self.next[v]:
            v = self.link[v]
            length = self.length[v]
        to = self.next[v].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words (first, one past the last), and the items with a window in ``ws``."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if len(ws) < self.least or not self.vocab:
            return spans, items
        codes = np.fromiter(map(self.vocab.get, ws, repeat(-1)), np.int64, len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start < self.least:
                continue
            v = length = 0
            for i, w in enumerate(codes[start:end].tolist(), start):
                v, length = self.step(v, length, w)
                u = self.found[v]
                while u >= 0:
                    for need, own in self.at[u].items():
                        if need <= length:
                            items |= own
                            first = i + 1 - need
                            while spans and spans[-1][1] >= first:
                                first = min(first, spans.pop()[0])
                            spans.append((first, i + 1))
                    u = self.found[self.link[u]] if u else -1
        return spans, items


_built: dict[str, Automaton] = {}


def _automaton(token: str, items: list[tuple[int, bytes]], window: int) -> Automaton:
    """Built once in each Python worker."""
    if token not in _built:
        _built.clear()
        _built[token] = Automaton([(k, words(t)) for k, t in items], window)
    return _built[token]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the hit words and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def _blocks(benchmark: DataFrame, limit: int) -> list[list[tuple[int | None, bytes]]]:
    """Items in blocks of at most ``limit`` words (a longer item is a block alone), fetched one after the other."""
    rows = benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    out, size = [[]], 0
    for r in rows.toLocalIterator():
        n = len(words(bytes(r.text)))
        if n and size + n > limit and out[-1]:
            out.append([])
            size = 0
        if n:
            out[-1].append((r.item_id, bytes(r.text)))
            size += n
    return [x for x in out if x]


SCHEMA = "n_words long, spans array<struct<a:int,b:int>>, items array<long>, clean string"
_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _scan(docs: DataFrame, block: list[tuple[int, bytes]], window: int, clean: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)
    token = hashlib.sha1(repr((block, window)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = None
        for batch in pieces(batches, "text", 2 << 20):
            auto = auto or _automaton(token, held.value, window)
            n, spans, items, texts = [], [], [], []
            for text in raw(batch.column("text")):
                ws = words(text)
                hit, own = auto.scan(ws)
                n.append(len(ws))
                spans.append([{"a": a, "b": b} for a, b in hit])
                items.append(sorted(own, key=lambda k: (k is None, k or 0)))
                texts.append(_cut(text, hit).decode("utf-8", "replace") if clean and hit else None)
            cols = [batch.column(c) for c in batch.schema.names if c != "text" or clean]
            names = [c for c in batch.schema.names if c != "text" or clean]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(spans, _TYPE), pa.array(items, pa.list_(pa.int64())), pa.array(texts, pa.string())], [*names, "n_words", "spans", "items", "clean"])

    kept = docs if clean else docs.drop("text")
    return docs.transform(arrow_map, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [SCHEMA]))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words, and the ids of the items with an occurring window.

    The automaton of all items is broadcast as their bare texts and built in each worker; ``limit`` bounds
    its words. More items make several automata: a pass each over the documents, whose spans and items are
    then merged by document. Null text has no words; a null item counts as none; items with the same id
    count once, those without an id as one item; identical rows give identical results, one each; an empty benchmark hits nothing.
    """
    docs = docs.select("doc_id", "text")
    blocks = _blocks(benchmark, limit) or [[]]
    if len(blocks) == 1:
        return _scan(docs, blocks[0], window, False).drop("clean")
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("own"), "text")
    by_doc = _all_scanned(keyed, blocks, window).groupBy("doc_id", "own", "n_words").agg(F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).alias("copies"), *_together())
    rows = by_doc.withColumn("spans", _joined_spans())
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "spans", "items")


def _all_scanned(keyed: DataFrame, blocks: list[list[tuple[int, bytes]]], window: int) -> DataFrame:
    """A row of each document (less its text) for each block, numbered: what this block alone hits."""
    parts = [_scan(keyed, b, window, False).withColumn("block", F.lit(i)) for i, b in enumerate(blocks)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union


def _together() -> list[Column]:
    return [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("spans", "items")]


def _joined_spans() -> Column:
    """The sorted spans of several blocks, joined where they touch or overlap."""
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(F.size("spans") > 0, merged).otherwise(F.col("spans"))


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from ``find_hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]).cast("long"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _cut_by_all(docs: DataFrame, blocks: list[list[tuple[int, bytes]]], window: int) -> DataFrame:
    """The documents with n_words, spans and clean (see ``_scan``) by the spans of all blocks together.

    Spans depend on the text alone, so they are found and joined by a hash of it.
    """
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    hits = _all_scanned(docs.select(own.alias("own"), "text"), blocks, window).where(F.size("spans") > 0)
    hits = hits.groupBy("own").agg(*_together()).select("own", _joined_spans().alias("spans"))
    met = docs.withColumn("own", own).join(hits, "own", "left").select(*docs.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            n, texts = [], []
            for text, spans in zip(raw(batch.column("text")), batch.column("spans").to_pylist()):
                n.append(len(words(text)))
                texts.append(_cut(text, [(s["a"], s["b"]) for s in spans]).decode("utf-8", "replace") if spans else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(texts, pa.string())], [*batch.schema.names, "n_words", "clean"])

    out = met.transform(arrow_map, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema] + ["n_words long, clean string"]))
    return out.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, limit: int = AUTOMATON_WORDS) -> DataFrame:
    """The documents without what they share with the benchmark, in their own columns.

    Every hit span (``window`` words or a whole short item, and whatever longer matches join up) is cut from
    the text; a document with over ``max_coverage`` of its words hit goes altogether. Documents without a hit
    stay byte for byte, null texts too. Several automata (``limit``) all judge the text as given, and it is cut once.
    Extra columns of any name are carried along; n_chars follows the text. Repeated rows stay.
    """
    names = docs.columns
    blocks = _blocks(benchmark, limit)
    if not blocks:
        return docs
    docs = docs.select("text", *[F.col(c).alias(f"own_{c}") for c in names if c != "text"])
    got = _scan(docs, blocks[0], window, True) if len(blocks) == 1 else _cut_by_all(docs, blocks, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]).cast("long"))
    out = got.where(n_hit <= max_coverage * F.col("n_words")).withColumn("text", F.coalesce("clean", "text"))
    kept = {c: F.col(f"own_{c}") for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        kept["n_chars"] = F.when(F.col("clean").isNull(), kept["n_chars"]).otherwise(F.length("text"))
    return out.select(*[kept[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
gram AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM gram JOIN win USING (n, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
