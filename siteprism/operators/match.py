"""Matching leads against a signature catalog."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.functions.arrays import let
from siteprism.functions.text import truncated
from siteprism.functions.urls import pick_url
from siteprism.operators.prefilter import Prefilter

#: The order of sources in a lead's detections, and headers that stand in for DNS records.
ORDER = ("script_src", "html", "css", "headers", "cookies", "meta", "url", "robots", "text", "dns_header")
DNS_HEADERS = ("via", "server", "x-powered-by", "x-served-by")

HAYSTACKS = "lead, source, qualifier, field, text"


def _lines(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.expr("cast(array() as array<string>)")), "\n")


_STACK = ("source", "qualifier", "field", "text")


def _stack(source: str, qualifier: Column, field: Column, text: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip((F.lit(source), qualifier, field, text), _STACK)])


def plain_stacks() -> Column:
    """A5: source, qualifier (null), field, text of the sources that aren't by name."""
    exists = F.coalesce(F.col("robots_txt.exists"), F.lit(False))
    parts = [
        ("script_src", "script_srcs[].url", _lines(F.col("script_srcs.url"))), ("html", "raw_html", F.col("raw_html")),
        ("css", "stylesheet_hrefs[].url", _lines(F.col("stylesheet_hrefs.url"))), ("url", "final_url", pick_url("final_url", "source_url")),
        ("robots", "robots_txt.body", F.when(exists, F.col("robots_txt.body"))), ("text", "text_content", F.col("text_content")),
    ]
    return F.array(*[_stack(s, F.lit(None).cast("string"), F.lit(f), t) for s, f, t in parts])


def _by_name(source: str, prefix: str, items: Column, only: tuple[str, ...] | None = None) -> Column:
    """A text for each name among items (name, value): its values in lines."""
    names = F.array_distinct(F.transform(items, lambda x: x["name"]))
    names = F.filter(names, lambda n: n.isin(*only)) if only else names
    values = lambda n: F.array_join(F.transform(F.filter(items, lambda x: x["name"] == n), lambda x: x["value"]), "\n")
    return F.transform(names, lambda n: _stack(source, n, F.concat(F.lit(prefix + "["), n, F.lit("]")), values(n)))


def header_stacks(headers: Column) -> Column:
    """Headers and cookies by name (values in lines), and all of them together.

    Header names fold case; cookie names don't, and a cookie's value ends at its first semicolon. The DNS
    stand-ins are the headers of those names.
    """
    # a lead's headers are one array already, so all of it is array work within the row: no shuffle
    sent = F.filter(F.transform(headers, lambda h: F.struct(h["key"].alias("key"), F.lower(h["key"]).alias("name"), h["value"].alias("value"))), lambda h: h["key"].isNotNull() & h["value"].isNotNull())
    cookie = lambda line: F.struct(F.regexp_extract(line, r"^\s*([^=]*)=", 1).alias("name"), F.regexp_extract(line, r"^\s*[^=]*=([^;]*)", 1).alias("value"))
    none = F.lit(None).cast("string")

    def told(h: Column) -> Column:
        own = F.filter(h, lambda x: x["name"] == "set-cookie")
        cookies = F.filter(F.transform(F.flatten(F.transform(own, lambda x: F.split(x["value"], "\n"))), cookie), lambda c: c["name"] != "")
        every = F.array(
            _stack("headers", none, F.lit("response_headers[*]"), F.array_join(F.transform(h, lambda x: F.concat_ws(": ", x["key"], x["value"])), "\n")),
            _stack("cookies", none, F.lit("set_cookie[*]"), F.array_join(F.transform(own, lambda x: x["value"]), "\n")),
        )
        return F.concat(_by_name("headers", "response_headers", h), _by_name("dns_header", "dns_header", h, DNS_HEADERS), let(cookies, lambda c: _by_name("cookies", "set_cookie", c)), every)

    return let(F.coalesce(sent, F.expr("cast(array() as array<struct<key:string,name:string,value:string>>)")), told)


def meta_stacks(lines: Column) -> Column:
    """Meta contents by (case-sensitive) name, and all ``name=content`` lines."""
    lines = F.coalesce(lines, F.expr("cast(array() as array<string>)"))
    named = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1).alias("name"), F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1).alias("value")))
    every = _stack("meta", F.lit(None).cast("string"), F.lit("meta[*]"), F.array_join(lines, "\n"))
    return F.concat(let(named, lambda m: _by_name("meta", "meta", m)), F.array(every))


def stacks() -> Column:
    """Everything that patterns are matched in, of a lead's columns."""
    whole = F.concat(plain_stacks(), header_stacks(F.col("response_headers")), meta_stacks(F.col("meta_lines")))
    return F.filter(whole, lambda s: s["text"] != "")


def _rows(leads: DataFrame, stacks: Column) -> DataFrame:
    return leads.select(F.col("id").alias("lead"), F.inline(stacks)).where("text <> ''")


def plain_haystacks(leads: DataFrame) -> DataFrame:
    """A5 as rows: lead, source, qualifier, field, text."""
    return _rows(leads, plain_stacks())


def header_haystacks(leads: DataFrame) -> DataFrame:
    """J2, J3, J5 as rows."""
    return _rows(leads, header_stacks(F.col("response_headers")))


def meta_haystacks(leads: DataFrame) -> DataFrame:
    """J4 as rows, from the column meta_lines."""
    return _rows(leads, meta_stacks(F.col("meta_lines")))


def haystacks(leads: DataFrame) -> DataFrame:
    """Everything that patterns are matched in."""
    return plain_haystacks(leads).unionByName(header_haystacks(leads)).unionByName(meta_haystacks(leads))


def _groups(regex: str) -> int:
    return re.compile(regex).groups


def version_of(text: Column, regex: str, template: str | None) -> Column:
    """The version template filled from the first match's groups; null where it is blank or names an absent group."""
    if not template:
        return F.lit(None).cast("string")
    out = F.lit(template)
    for i in range(1, _groups(regex) + 1):
        out = F.replace(out, F.lit(f"\\{i}"), F.regexp_extract(text, "(?i)" + regex, i))
    return F.when(~F.contains(out, F.lit("\\")), F.nullif(F.trim(out), F.lit("")))


def match_generated(stacks: DataFrame, patterns: list[dict]) -> DataFrame:
    """J1 for a few patterns of Java's dialect: an expression for each, constants that compile once and stay in codegen.

    A row of text meets only the patterns of its source (and name): a CASE by source keeps the others from
    being tried.
    """
    key = F.when(F.col("source").isin("headers", "dns_header"), F.lower("qualifier")).otherwise(F.col("qualifier"))
    rows = stacks.withColumn("_q", key)
    by: dict[str, list[Column]] = {}
    for p in patterns:
        q = p["qualifier"]
        if p["source"] == "dns_header" and (q or "").lower() not in DNS_HEADERS:
            continue
        named = F.col("_q").isNull() if q is None else F.col("_q") == (q.lower() if p["source"] in ("headers", "dns_header") else q)
        regex = "(?i)" + p["regex"]
        hit = F.struct(
            F.lit(p["name"]).alias("name"), F.lit(p["pack"]).alias("pack"), F.lit(p["idx"]).alias("idx"), F.lit(p["confidence"]).alias("confidence"),
            version_of(F.col("text"), p["regex"], p["version"]).alias("version"), truncated(F.regexp_extract("text", regex, 0)).alias("matched_value"),
        )
        by.setdefault(p["source"], []).append(F.when(named & F.col("text").rlike(regex), hit))
    found = None
    for source, hits in by.items():
        own = F.array_compact(F.array(*hits))
        found = F.when(F.col("source") == source, own) if found is None else found.when(F.col("source") == source, own)
    if found is None:
        return _finished(rows.limit(0).select("lead", "source", "field", F.lit("").alias("name"), F.lit("").alias("pack"), F.lit(0).alias("idx"), F.lit(0).alias("confidence"), F.lit("").alias("version"), F.lit("").alias("matched_value")))
    return _finished(rows.select("lead", "source", "field", F.inline(found)))


def match_joined(stacks: DataFrame, pattern: DataFrame) -> DataFrame:
    """J1 as a join: texts and patterns meet by source and name (an equi-join), the regular expression is the rest.

    The pattern table is small; the optimiser broadcasts it below its threshold and shuffles it beyond. Versions
    are left to the other two forms.
    """
    fold = lambda c, s: F.coalesce(F.when(s.isin("headers", "dns_header"), F.lower(c)).otherwise(c), F.lit(""))
    p = pattern.where((F.col("source") != "dns_header") | F.lower("qualifier").isin(*DNS_HEADERS))
    p = p.select(F.col("source").alias("_s"), fold(F.col("qualifier"), F.col("source")).alias("_q"), "name", "pack", "idx", F.concat(F.lit("(?i)"), "regex").alias("_re"), "confidence")
    rows = stacks.withColumn("_k", fold(F.col("qualifier"), F.col("source")))
    met = rows.join(p, (F.col("source") == F.col("_s")) & (F.col("_k") == F.col("_q")) & F.expr("text rlike _re"))
    value = truncated(F.expr("regexp_extract(text, _re, 0)"))
    return _finished(met.select("lead", "source", "field", "name", "pack", "idx", "confidence", F.lit(None).cast("string").alias("version"), value.alias("matched_value")))


_HIT = "lead string, source string, field string, name string, pack string, idx int, confidence int, version string, matched_value string, failed boolean"


def match_batched(stacks: DataFrame, patterns: list[dict], timeout: float = 0.1) -> DataFrame:
    """The matcher's form for packs: Arrow batches, each pattern compiled once in a worker.

    One automaton over the literals that patterns require tells in one pass which of them a text can match
    (see ``prefilter``); only these are tried. Patterns are Python's, whatever their number, and run by the
    ``regex`` module, which must be installed: its timeout keeps any from running away. One that does is no hit,
    and ``failures`` counts it.
    """
    return _batched(stacks, patterns, timeout).where(~F.col("failed")).drop("failed")


def failures(stacks: DataFrame, patterns: list[dict], timeout: float = 0.1) -> DataFrame:
    """Lead, failed: how many of a lead's patterns ran out of time, where any did."""
    return _batched(stacks, patterns, timeout).where("failed").groupBy("lead").agg(F.count("*").cast("int").alias("failed"))


def _folded_name(source: str, qualifier: str | None) -> str | None:
    return qualifier.lower() if qualifier is not None and source in ("headers", "dns_header") else qualifier


class Matcher:
    """Patterns ready to be tried in a worker: by source and name, each compiled once, behind their prefilter."""

    def __init__(self, patterns: list[dict], timeout: float):
        import regex

        by: dict[tuple[str, str | None], list[dict]] = {}
        for p in patterns:
            q = _folded_name(p["source"], p["qualifier"])
            if p["source"] != "dns_header" or q in DNS_HEADERS:
                by.setdefault((p["source"], q), []).append(p)
        self.by = {k: ([(p, regex.compile(p["regex"], regex.IGNORECASE)) for p in ps], Prefilter([p["regex"] for p in ps])) for k, ps in by.items()}
        self.timeout = timeout

    def hits(self, source: str, qualifier: str | None, text: str) -> Iterator[dict]:
        """name, pack, idx, confidence, version, matched_value, failed of every pattern that matches or runs out of time."""
        patterns, likely = self.by.get((source, _folded_name(source, qualifier)), ((), None))
        for i in likely.candidates(text) if patterns else ():
            p, compiled = patterns[i]
            own = {k: p[k] for k in ("name", "pack", "idx", "confidence")}
            try:
                m = compiled.search(text, timeout=self.timeout)
            except TimeoutError:
                yield own | {"version": None, "matched_value": None, "failed": True}
                continue
            if m:
                yield own | {"version": _filled(p["version"], m.groups()), "matched_value": m[0] if len(m[0]) <= 200 else m[0][:197] + "...", "failed": False}


def _batched(stacks: DataFrame, patterns: list[dict], timeout: float) -> DataFrame:
    held = stacks.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value, timeout)
        for batch in batches:
            out = [{"lead": r["lead"], "source": r["source"], "field": r["field"]} | hit for r in batch.to_pylist() for hit in matcher.hits(r["source"], r["qualifier"], r["text"])]
            yield pa.RecordBatch.from_pylist(out, schema=_HIT_TYPE)

    return _finished(stacks.select("lead", "source", "qualifier", "field", "text").mapInArrow(run, _HIT))


_HIT_TYPE = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.string())) for n, t in (x.split() for x in _HIT.split(", "))])


def _filled(template: str | None, groups: tuple) -> str | None:
    if not template:
        return None
    for i, g in enumerate(groups, 1):
        template = template.replace(f"\\{i}", g or "")
    return None if "\\" in template else template.strip() or None


def _finished(rows: DataFrame) -> DataFrame:
    """Detections with pattern_id and their order in the lead (by source, then name and index)."""
    place = F.array_position(F.lit(list(ORDER)), F.col("source"))
    code = F.concat("pack", F.lit(":"), "name", F.lit(":"), "source", F.lit("#"), F.col("idx").cast("string"))
    return rows.withColumn("pattern_id", code).withColumn("source_ord", place.cast("int"))


def detections(leads: DataFrame, patterns: list[dict], tech: DataFrame) -> DataFrame:
    """A lead's detections, numbered (seq) by source, pack, name and pattern, with their categories."""
    from pyspark.sql import Window as W

    stacks = haystacks(leads)
    found = match_batched(stacks, patterns)
    seq = F.row_number().over(W.partitionBy("lead").orderBy("source_ord", "name", "pack", "idx", "field"))
    return found.withColumn("seq", seq).join(tech.select("name", "pack", "categories"), ["name", "pack"])


def match_leads(leads: DataFrame, pack, block=None) -> DataFrame:
    """Resolved detections of every lead; ``block`` (a Blocklist) is applied where given.

    What a lead's text does to one pattern (a timeout) costs that pattern alone: see ``failures``.
    """
    from siteprism.operators import resolve as R
    from siteprism.sources.packs import tables
    from siteprism.sources.shared import written

    tech, _, edge = tables(leads.sparkSession, pack)
    # resolving refers to the detections many times; the patterns are tried once
    found = R.resolve(written(detections(leads, pack.pattern, tech), "detections"), tech, edge)
    return R.apply_blocklist(found, *block.frames(leads.sparkSession)) if block else found
