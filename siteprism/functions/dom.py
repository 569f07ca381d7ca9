"""A page's elements as an interval-encoded array, CSS selectors as folds over it, and the signals they tell."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.functions import html as H
from siteprism.functions import text as T
from siteprism.functions import urls
from siteprism.functions.arrays import let

#: An element or text, in document order. ``pre`` is its number and ``last`` that of the last one inside it, so that a
#: node holds those numbered from pre + 1 to last; ``up`` is its parent's number, -1 at the top. Texts have tag ``#text``.
NODES = "array<struct<pre:int,last:int,up:int,tag:string,attrs:map<string,string>,text:string>>"


class _Encoder(HTMLParser):
    """One pass over a page that numbers its nodes; an end tag closes what is open inside its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.count: dict[str, int] = {}

    def _add(self, tag: str, attrs: list[tuple[str, str]], text: str | None) -> dict:
        n = len(self.nodes)
        self.nodes.append({"pre": n, "last": n, "up": self.open[-1]["pre"] if self.open else -1, "tag": tag, "attrs": attrs, "text": text})
        return self.nodes[-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self._add(tag, list({k: v or "" for k, v in reversed(attrs)}.items()), None)
        if tag not in H._VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def _pop(self) -> str:
        node = self.open.pop()
        node["last"] = len(self.nodes) - 1
        self.count[node["tag"]] -= 1
        return node["tag"]

    def handle_endtag(self, tag: str) -> None:
        while self.count.get(tag):
            if self._pop() == tag:
                return

    def handle_data(self, data: str) -> None:
        self._add("#text", [], data)


def encoded(page: str | None) -> list[dict]:
    """The nodes of one page; null counts as empty."""
    e = _Encoder()
    e.feed(page or "")
    e.close()
    while e.open:
        e._pop()
    return e.nodes


def with_nodes(pages: DataFrame, column: str = "html") -> DataFrame:
    """The columns of every page but ``column``, and ``nodes`` (see NODES) of its html."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [f for f in pages.schema if f.name not in (column, "nodes")]
    out = StructType(kept + StructType.fromDDL("nodes " + NODES).fields)
    kind = to_arrow_schema(out).field("nodes").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                nodes = pa.array([encoded(h) for h in part.column(column).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), nodes], [*(f.name for f in kept), "nodes"])

    return pages.select(*[f"`{f.name}`" for f in kept], f"`{column}`").mapInArrow(run, out)


# Selectors.

_TOKEN = re.compile(r"\s*([>,])\s*|(\s+)|([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([~^*$]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]")
_Test = Callable[[Column], Column]


def _parsed(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """For each alternative its compounds, left to right: how it stands to the one before (blank or >) and its tests."""
    out: list[list[tuple[str, list[tuple]]]] = [[]]
    how, at, text = " ", 0, selector.strip()
    fresh = True
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no selector that is known here: {selector!r}")
        at = m.end()
        mark, blank, tag, cls, id_, attr, op, *values = m.groups()
        if mark == ",":
            if fresh:
                raise ValueError(f"an empty part in {selector!r}")
            out.append([])
            how, fresh = " ", True
            continue
        if mark or blank:
            if fresh:
                raise ValueError(f"nothing before {mark or 'a blank'} in {selector!r}")
            how, fresh = mark or " ", True
            continue
        if fresh:
            out[-1].append((how, []))
            fresh = False
        tests = out[-1][-1][1]
        if attr:
            tests.append(("attr", attr.lower(), op, next((v for v in values if v is not None), None)))
        else:
            tests.append(("tag", tag.lower()) if tag else ("class", cls) if cls else ("id", id_))
    if fresh:
        raise ValueError(f"an empty part in {selector!r}")
    return out


def _fits(n: Column, test: tuple) -> Column:
    """Whether a node passes a test; null where it lacks what is asked for."""
    kind, name, *rest = test
    if kind == "tag":
        return n["tag"] != "#text" if name == "*" else n["tag"] == name
    if kind == "class":
        return F.array_contains(F.split(n["attrs"]["class"], r"\s+"), name)
    value, (op, wanted) = n["attrs"]["id" if kind == "id" else name], rest or ("=", name)
    if op is None:
        return value.isNotNull()
    return {"=": value == wanted, "~=": F.array_contains(F.split(value, r"\s+"), wanted), "^=": value.startswith(wanted), "$=": value.endswith(wanted), "*=": value.contains(wanted)}[op]


def select(nodes: Column, selector: str) -> Column:
    """The elements that a selector means, in document order, as an array.

    Known are tags, ``*``, ``.class``, ``#id``, ``[attr]`` and ``[attr=value]`` (also ~=, ^=, $= and *=), several of
    them together, blanks (inside of), ``>`` (child of) and commas. What stands inside of what is told by numbers
    alone: a node lies in another if its number lies between that one's and its last.
    """
    found = reduce(F.array_union, [_numbers(nodes, parts) for parts in _parsed(selector)])
    return F.transform(F.array_sort(found) if "," in selector else found, lambda p: F.get(nodes, p))


def _numbers(nodes: Column, parts: list[tuple[str, list[tuple]]]) -> Column:
    """The numbers of what matches a selector without commas, in order."""
    found = None
    for how, tests in parts:
        own = F.transform(F.filter(nodes, _passes(tests)), lambda n: n["pre"])
        if found is None:
            found = own
        elif how == ">":
            found = let(found, _children(nodes, own))
        else:
            found = F.array_intersect(own, _covered(nodes, found))
    return found


def _passes(tests: list[tuple]) -> _Test:
    return lambda n: F.coalesce(reduce(lambda a, b: a & b, [_fits(n, t) for t in tests]), F.lit(False))


def _children(nodes: Column, own: Column) -> _Test:
    return lambda outer: F.filter(own, lambda p: F.array_contains(outer, F.get(nodes, p)["up"]))


def _covered(nodes: Column, found: Column) -> Column:
    """The numbers of all that lies inside of the nodes found: those of the outermost of them, one after the other."""
    last = lambda p: F.get(nodes, p)["last"]
    none = F.struct(F.lit(-1).alias("upto"), F.expr("cast(array() as array<int>)").alias("kept"))
    step = lambda s, p: F.when((p <= s["upto"]) | (last(p) == p), s).otherwise(F.struct(last(p).alias("upto"), F.concat(s["kept"], F.array(p)).alias("kept")))
    outermost = F.aggregate(found, none, step, lambda s: s["kept"])
    return F.flatten(F.transform(outermost, lambda p: F.sequence(p + 1, last(p))))


def inner_text(nodes: Column, node: Column, sep: str = " ") -> Column:
    """The texts inside a node, joined."""
    inside = F.filter(F.slice(nodes, node["pre"] + 2, node["last"] - node["pre"]), lambda t: t["tag"] == "#text")
    return F.array_join(F.transform(inside, lambda t: t["text"]), sep)


def texts(nodes: Column, selector: str) -> Column:
    """The texts of what a selector means, white space made single."""
    return F.transform(select(nodes, selector), lambda n: T.squeeze(inner_text(nodes, n)))


def attributes(nodes: Column, selector: str, name: str) -> Column:
    """An attribute of what a selector means, where it is there."""
    return F.filter(F.transform(select(nodes, selector), lambda n: n["attrs"][name]), lambda v: v.isNotNull())


def _first(items: Column, accept: _Test = lambda v: v != "") -> Column:
    return F.coalesce(F.try_element_at(F.filter(items, lambda v: accept(v)), F.lit(1)), F.lit(""))


# What the selectors tell.


def company_name(nodes: Column) -> Column:
    """H8: site name, application name, an image's alternative text that is no logo's, the first heading, the title's head: the first that may name a company."""
    first_only = lambda items: F.slice(items, 1, 1)
    alts = F.filter(F.transform(attributes(nodes, "img", "alt"), T.squeeze), lambda a: ~T.ascii_lower(a).contains("logo"))
    named = [
        first_only(F.transform(attributes(nodes, 'meta[property="og:site_name"]', "content"), T.squeeze)), first_only(F.transform(attributes(nodes, "meta[name=application-name]", "content"), T.squeeze)),
        alts, first_only(texts(nodes, "h1")),
    ]
    candidate = F.try_element_at(F.filter(F.concat(*named), lambda v: T.company_candidate(v)), F.lit(1))
    title = F.coalesce(F.try_element_at(texts(nodes, "title"), F.lit(1)), F.lit(""))
    return F.coalesce(candidate, T.title_company(title))


def address(nodes: Column) -> Column:
    """H9: the first text that looks like a postal address, in ``address`` and then the other places, place by place."""
    places = F.flatten(F.array(*[texts(nodes, place) for place in ("address", *H.ADDRESS_PLACES)]))
    return _first(places, lambda v: T.postal_address(v))


def schema_type(nodes: Column) -> Column:
    """The first JSON-LD block's type that is a text, of the block's object or of an item of its array."""
    blocks = F.transform(select(nodes, 'script[type="application/ld+json"]'), lambda n: inner_text(nodes, n, ""))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    items = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    types = F.transform(items, lambda v: F.try_variant_get(v, "$['@type']", "variant"))
    own = F.transform(F.filter(types, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.lit(""))


def meta_lines(nodes: Column) -> Column:
    """``name=content`` of every meta element that has a name of one of four kinds, the first that isn't empty."""
    name = lambda n: F.coalesce(*[F.nullif(n["attrs"][k], F.lit("")) for k in ("name", "property", "http-equiv", "itemprop")])
    named = F.filter(select(nodes, "meta"), lambda n: name(n).isNotNull())
    return F.transform(named, lambda n: F.concat(name(n), F.lit("="), F.coalesce(n["attrs"]["content"], F.lit(""))))


def links(nodes: Column, base: Column, selector: str, attr: str) -> Column:
    """H3-H5: url, is_internal and label of what a selector means, resolved; empty references are left out."""
    own = urls.host(base)
    some = F.filter(select(nodes, selector), lambda n: n["attrs"][attr] != "")

    def link(n: Column) -> Column:
        url = urls.resolve(base, n["attrs"][attr])
        return F.struct(url.alias("url"), F.coalesce((own != "") & (urls.host(url) == own), F.lit(False)).alias("is_internal"), F.trim(inner_text(nodes, n)).alias("label"))

    return F.transform(some, link)


def signals(pages: DataFrame) -> DataFrame:
    """page_id, url and what selectors tell of every page (page_id, url, html), as columns over its nodes; null html counts as empty."""
    rows = with_nodes(pages.select("page_id", "url", "html"))
    nodes, base = F.col("nodes"), F.col("url")
    rows = rows.select("page_id", "url", "nodes", links(nodes, base, "a[href]", "href").alias("anchor_hrefs"))
    social = lambda domain: F.coalesce(F.try_element_at(F.filter("anchor_hrefs", lambda a: a["url"].contains(domain)), F.lit(1))["url"], F.lit(""))
    return rows.select(
        "page_id", "url", "anchor_hrefs", links(nodes, base, "script[src]", "src").alias("script_srcs"), links(nodes, base, "link[rel=stylesheet][href]", "href").alias("stylesheet_hrefs"),
        F.coalesce(urls.resolve(base, F.nullif(F.try_element_at(attributes(nodes, "link[rel=manifest][href]", "href"), F.lit(1)), F.lit(""))), F.lit("")).alias("manifest_url"),
        meta_lines(nodes).alias("meta_lines"), company_name(nodes).alias("company_name"), address(nodes).alias("address"), schema_type(nodes).alias("schema_org_business_type"),
        (F.size(select(nodes, "meta[name=viewport]")) > 0).alias("has_viewport"), (F.size(select(nodes, "form")) > 0).alias("has_form"),
        T.squeeze(F.coalesce(F.try_element_at(select(nodes, "meta[name=description]"), F.lit(1))["attrs"]["content"], F.lit(""))).alias("meta_description"),
        social("linkedin.com").alias("social_linkedin"), social("facebook.com").alias("social_facebook"), social("instagram.com").alias("social_instagram"),
        F.exists("anchor_hrefs", lambda a: F.lower(F.concat_ws(" ", a["url"], a["label"])).contains("contact")).alias("has_contact_page"),
    )
