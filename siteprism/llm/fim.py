"""Fill-in-middle: documents cut in three and rearranged around sentinels, as piece tables over immutable buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siteprism.llm.common import arrow_map, pieces, raw, table

#: The sentinels before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents those that are rearranged, and of these those whose suffix stands first.
RATE, SPM = 90, 20

#: Where prefix, middle and suffix (0, 1, 2) stand in each form, and the sentinel before each.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_SENTINELS = PREFIX + SUFFIX + MIDDLE
_BEFORE = (0, 2 * len(PREFIX), len(PREFIX))


@dataclass(frozen=True)
class Piece:
    """A stretch of a buffer: 0 is the text, 1 the sentinels."""

    buffer: int
    start: int
    size: int


class PieceTable:
    """Descriptors, in order, over buffers that are never changed or copied."""

    def __init__(self, text: bytes, parts: list[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(_SENTINELS))
        self.parts = [Piece(0, 0, len(text))] if parts is None else parts

    def _with(self, parts: list[Piece]) -> PieceTable:
        out = PieceTable.__new__(PieceTable)
        out.buffers, out.parts = self.buffers, parts
        return out

    def cut(self, at: int) -> PieceTable:
        """The descriptor that holds byte ``at`` of the whole split before it; one at an end is split off empty."""
        parts, seen = list(self.parts), 0
        for i, p in enumerate(parts):
            if at <= seen + p.size:
                parts[i : i + 1] = [Piece(p.buffer, p.start, at - seen), Piece(p.buffer, p.start + at - seen, p.size - at + seen)]
                return self._with(parts)
            seen += p.size
        raise ValueError(f"{at} lies beyond the end")

    def arranged(self, form: str) -> PieceTable:
        """Three descriptors in the order of ``form``, each behind its sentinel."""
        return self._with([q for k in ORDERS[form] for q in (Piece(1, _BEFORE[k], 3), self.parts[k])])

    def restored(self, form: str) -> PieceTable:
        """The inverse permutation of ``arranged``, without the sentinels."""
        order = ORDERS[form]
        return self._with([self.parts[2 * order.index(k) + 1] for k in range(3)])

    def views(self) -> Iterator[memoryview]:
        for p in self.parts:
            yield self.buffers[p.buffer][p.start : p.start + p.size]

    def bytes(self) -> bytes:
        return b"".join(self.views())

    def sha256(self) -> str:
        """Hash of the whole, descriptor by descriptor."""
        out = hashlib.sha256()
        for v in self.views():
            out.update(v)
        return out.hexdigest()


def split_output(output: bytes, form: str) -> PieceTable:
    """The table of an output as ``arranged`` gives it, cut at its three sentinels.

    A sentinel begins with a character that no other one of it repeats, so none arises where parts and sentinels
    touch: each is found at its only place.
    """
    marks = [(PREFIX, MIDDLE, SUFFIX)[k] for k in ORDERS[form]]
    at = [output.index(m) for m in marks]
    if at != sorted(at) or at[0]:
        raise ValueError(f"not an output of form {form}")
    whole = PieceTable(output)
    for a in at:
        for place in (a, a + 3):
            if place:
                whole = whole.cut(place)
    return whole


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    return output if form == "plain" else split_output(output, form).restored(form).bytes()


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that a document's id alone decides; a null id counts as an empty one."""
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def _place(text: bytes, *units: int) -> list[int]:
    """Byte offsets of code points by number."""
    if text.isascii():
        return list(units)
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(begins[u]) if u < len(begins) else len(text) for u in units]


def rearrange(text: bytes, doc_id: int | None, rate: int = RATE, spm: int = SPM) -> tuple[str, int, int, int, PieceTable]:
    """form, code points, those of prefix and of middle, and the rearranged table of one text."""
    n = len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    h1, h2, h3, h4 = draws(doc_id)
    whole = PieceTable(text)
    if not n or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", n, 0, 0, whole
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = _place(text, first, second)
    form = "spm" if h4 % 100 < spm else "psm"
    return form, n, first, second - first, whole.cut(a).cut(b).arranged(form)


ADDED = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def fill_in_middle(docs: DataFrame, outputs: bool = True, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Every row with its own columns but text, and n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    A text's places are code points, null counts as empty, and an empty text or one that holds a sentinel stays
    plain, with null prefix_chars and middle_chars. ``doc_id`` alone decides cuts and form, so repeated rows give
    repeated results and reruns agree; a null doc_id draws as an empty one. ``restored_sha256`` is of the text
    rebuilt from output and form. Without ``outputs`` the column output is left out: then no text goes back to
    the JVM. Own columns named like added ones give way to them; others are carried along. Empty input gives an
    empty result. A long text takes memory in proportion to it alone.
    """
    added = [x.split() for x in ADDED.split(", ") if outputs or not x.startswith("output ")]
    names = [n for n, _ in added]
    own = docs.drop(*[c for c in docs.columns if c.lower() in names])
    rest = [f for f in own.schema if f.name != "text"]
    kept = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: dict[str, list] = {n: [] for n in names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                form, n, first, middle, t = rearrange(text, doc_id, rate, spm)
                made = t.bytes()
                told = {"n": n, "form": form, "prefix_chars": None, "middle_chars": None, "output_sha256": t.sha256(), "output": made}
                if form != "plain":
                    told |= {"prefix_chars": first, "middle_chars": middle}
                told["restored_sha256"] = (PieceTable(made) if form == "plain" else split_output(made, form).restored(form)).sha256()
                for c in names:
                    out[c].append(told[c])
            kinds = {"long": pa.int64(), "string": pa.string()}
            cast = lambda name, kind: pa.array(out[name], pa.binary()).cast(pa.string()) if name == "output" else pa.array(out[name], kinds[kind])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(cast(*x) for x in added)], [*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{n} {k}" for n, k in added)])
    return own.transform(arrow_map, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=False)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
