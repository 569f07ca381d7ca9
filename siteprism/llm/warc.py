"""WARC archives: writing with deduplicated payloads and segments, and reading with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, fresh_path, pieces, raw, table

#: Bytes of a record's block beyond which it goes on in continuation records; bytes of a transfer chunk.
SEGMENT, CHUNK = 64 << 10, 8 << 10
#: Payloads of fewer bytes are never revisits. Bytes in an archive file before compression at most (less the heads of
#: its records), as a record's block has at most a segment and its last character.
LEAST, FILE_BYTES = 1000, 128 << 20

_CRLF = b"\r\n"
_DATE = "2020-01-01T00:00:00Z"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    out = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        out += [b"%x\r\n" % len(part), part, _CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body without its framing; ValueError where the framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = framed.index(_CRLF, at)
        n = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if framed[at + n : at + n + 2] != _CRLF:
            raise ValueError("chunk does not end where it says")
        out.append(framed[at : at + n])
        at += n + 2


def _cut(block: bytes, size: int) -> list[bytes]:
    """The block in segments of about ``size`` bytes that end between UTF-8 characters."""
    out, at = [], 0
    while at < len(block) or not out:
        end = min(at + size, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        out.append(block[at:end])
        at = end
    return out


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + _CRLF + block


def _records(page: int | None, url: str, payload: bytes, digest: str, refers: int | None, number: str, segment: int) -> list[bytes]:
    """A page's records: a response with its continuations, or a revisit with the response's HTTP head alone."""
    name = f"<urn:x-page:{'' if page is None else page}:{number}>"
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    target = "".join(c for c in url if c not in "\r\n")
    common = [("WARC-Target-URI", target), ("WARC-Date", _DATE), ("WARC-Payload-Digest", sha1)]
    if refers is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Refers-To", f"<urn:x-page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")]
        return [_record(own, http)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    # A chunk may end inside a character; the text writer wants whole ones, so chunks are cut like segments.
    block = http + b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, CHUNK) if c) + b"0\r\n\r\n"
    parts = _cut(block, segment)
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response")], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Target-URI", target), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i)]
        own += [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
        out.append(_record(own, part))
    return out


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, refers_to: pages whose payload a page with a larger page_id repeats.

    Pages without an id neither refer nor are referred to, and of rows that share the largest id all are responses.
    Digests are taken in the scan and grouped with map-side combining, so equal pages never meet in one task.
    """
    narrow = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least)
    held = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).where("first < refers_to")
    return narrow.join(held.select("digest", "n", "refers_to"), ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Write each page (page_id, url, html) as WARC records, gzipped, under ``path``.

    Spark's text writer ends every record with the format's two line ends and commits whole tasks, so a lost
    executor leaves no half files. Null html is an empty payload, null url an empty one, a null page_id stays so.
    Rows with one page_id are captures of their own; an empty table gives archives without a record. Records of
    one page can lie in any file: continuations carry their origin's id.
    """
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    back = revisits(pages, least)
    told = known.join(back.withColumnRenamed("digest", "sha"), ["page_id", "sha"], "left").withColumn("number", F.monotonically_increasing_id().cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha", "refers_to", "number")), raw(batch.column("html")))
            out = [r for page, url, sha, refers, number, html in rows for r in _records(page, url or "", html, sha, refers, number, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    lines = told.transform(arrow_map, run, "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // segment)).text(path)


def _inflated(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The archive's bytes part by part; gzip archives may hold a member for each record."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    at = 0
    while at < len(data) and data[at]:  # zeros may fill up the end
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a gzip member")
            yield member.decompress(data[at : at + step])
            at += step
        at = min(at, len(data)) - len(member.unused_data)


def _parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, by Content-Length; one is held at a time."""
    held = bytearray()

    def upto(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while upto(1) and held[0] in _CRLF:
            del held[: len(held) - len(held.lstrip(_CRLF))]
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not upto(seen + 1):
                raise ValueError("the archive ends inside a record's head")
        lines = bytes(held[:end]).split(_CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {lines[0][:40]!r}")
        head: dict[str, str] = {}
        for line in lines[1:]:
            if line[:1] in b" \t" and head:  # a folded line goes on
                head[k] += " " + line.strip().decode("utf-8", "replace")
            else:
                name, _, value = line.partition(b":")
                k = name.strip().lower().decode("utf-8", "replace")
                head[k] = value.strip().decode("utf-8", "replace")
        n = int(head["content-length"])
        if not upto(end + 4 + n):
            raise ValueError("the archive ends inside a record's block")
        yield head, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]


#: Records that capture a page; warcinfo, request, metadata, resource, conversion and unknown ones are passed over.
CAPTURES = ("response", "revisit")
_ROW = "origin string, segment int, total long, type string, url string, refers string, digest string, http boolean, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """origin, segment, total, type, url, refers, digest, http, block: one row for each capture and each segment.

    ``segment`` is 0 where a record isn't segmented. A file's compressed bytes are a task's (WARC files are made
    to be of bounded size); they are inflated and parsed as a stream.
    """
    files = spark.read.format("binaryFile").load(path).where("path like '%.gz' or path like '%.warc'").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for head, block in _parse(_inflated(data.as_py())):
                    kind, segment = head.get("warc-type", "").lower(), int(head.get("warc-segment-number", 0))
                    if kind not in CAPTURES and not segment:
                        continue
                    origin = head.get("warc-segment-origin-id") or head.get("warc-record-id")
                    total = head.get("warc-segment-total-length")
                    http = head.get("content-type", "application/http").lower().startswith("application/http")
                    rows.append((origin, segment, int(total) if total else None, kind, head.get("warc-target-uri", "").strip("<>"), head.get("warc-refers-to"), head.get("warc-payload-digest"), http, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    return files.transform(arrow_map, run, _ROW)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["origin", "segment", "total", "type", "url", "refers", "digest", "http", "block"])


def digest_of(header: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a payload digest, which is in hex or base 32; None where there is none or it is neither."""
    name, _, value = (header or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return None
    size = 2 * hashlib.new(name).digest_size
    if re.fullmatch(f"[0-9a-fA-F]{{{size}}}", value):
        return name, value.lower()
    try:
        found = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return None
    return (name, found) if len(found) == size else None


_PAGE = re.compile(r"<?urn:x-page:(-?\d+)[:>]")


def _page(record: str | None) -> int | None:
    """The page_id in the id of a record that ``write_archives`` made; None in any other."""
    m = _PAGE.match(record or "")
    return int(m[1]) if m else None


def decoded(block: bytes, kind: str, digest: str | None, http: bool) -> tuple[int | None, str | None, bytes | None]:
    """Payload length, its SHA-1 in hex, and the payload, of a whole block.

    A revisit has the full payload's length from its HTTP head and the digest from its header, each None where
    it doesn't say; its payload is None. ValueError where transfer framing or digest don't fit.
    """
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(_CRLF)[1:])}
    told = digest_of(digest)
    if kind == "revisit":
        n = fields.get(b"content-length", b"")
        return int(n) if n.isdigit() else None, told[1] if told and told[0] == "sha1" else None, None
    payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    # some archives take the digest over the framed body
    if told and told[1] not in (hashlib.new(told[0], payload).hexdigest(), hashlib.new(told[0], body).hexdigest()):
        raise ValueError("the payload is not that of its digest")
    return len(payload), hashlib.sha1(payload).hexdigest(), payload


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, refers_to_id string, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, refers_to_id, payload of every capture.

    Any archives: ids may be of any form (page_id and refers_to are null unless ``write_archives`` made them),
    digests may lack or be of another algorithm, and what is no capture is passed over (``CAPTURES``). Records
    that aren't segmented are decoded as they are read. Segments of one origin are grouped by its id (a group is
    one capture), ordered by number, and checked: numbers run from 1, lengths sum to the stated total, transfer
    framing is whole, and the payload has the digest that its header states. ValueError where any fails. A
    revisit's bytes and digest are the full payload's; its payload is null. No records give an empty result.
    """
    rows = read_segments(spark, path)
    whole = rows.where("segment = 0").select("type", "origin", "url", "refers", "digest", "http", F.array("block").alias("blocks"), F.lit(None).cast("long").alias("total"), F.array(F.lit(1)).alias("numbers"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    many = rows.where("segment > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), *map(first, ("type", "url", "refers", "digest", "http"))
    )
    # segments whose first is of a kind to be passed over go; those without a first one are told below
    many = many.where(F.col("type").isNull() | F.col("type").isin(*CAPTURES))
    many = many.select(*[c for c in whole.columns if c not in ("blocks", "numbers")], F.col("parts.block").alias("blocks"), F.col("parts.segment").alias("numbers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _OUT.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(i, 256).to_pylist():
                    block, numbers = b"".join(r["blocks"]), r["numbers"]
                    if numbers != list(range(1, len(numbers) + 1)) or len(numbers) > 1 and r["total"] != len(block):
                        raise ValueError(f"segments of {r['origin']} are not whole: {numbers}, {len(block)} of {r['total']} bytes")
                    try:
                        n, digest, payload = decoded(block, r["type"], r["digest"], r["http"])
                    except ValueError as e:
                        raise ValueError(f"{r['origin']}: {e}") from None
                    out.append((_page(r["origin"]), n, digest, r["type"], _page(r["refers"]), r["origin"], r["url"], r["refers"], payload))
                cols = list(zip(*out)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return whole.unionByName(many).transform(arrow_map, run, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS top FROM p GROUP BY d, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM p JOIN m USING (d, n)
"""
