"""Page signals: a one-parse extractor, and pure column variants for what regular expressions can tell."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.functions import text as T
from siteprism.functions import urls

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDING = frozenset(("head", "script", "style", "noscript", "title"))
#: Where an address is looked for after <address>, in this order.
ADDRESS_PLACES = ("footer", ".footer", "#footer", ".contact", "#contact", ".contact-us", ".location", ".locations", ".address", "[itemprop=address]")


# Columns. Entities stay as they are in these variants.


def title_of(html: Column | str) -> Column:
    """H1: the first title, trimmed."""
    return F.trim(F.regexp_extract(F.coalesce(html if isinstance(html, Column) else F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column | str) -> Column:
    """H2: what stands in no head, script, style, comment or tag, white space made single."""
    out = F.coalesce(html if isinstance(html, Column) else F.col(html), F.lit(""))
    for pattern in (r"(?is)<head\b.*?</head>", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<noscript\b.*?</noscript>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def anchors_of(pages: DataFrame) -> DataFrame:
    """H3: page_id, base, pos, url, label of every quoted anchor, in order; tags in a label become nothing."""
    tag = r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>(.*?)</a>"
    pair = F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), 1).alias("href"), F.regexp_extract_all("html", F.lit(tag), 2).alias("label"))
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(pair).alias("pos", "a"))
    return rows.select("page_id", "base", "pos", urls.resolve("base", "a.href").alias("url"), F.trim(F.regexp_replace("a.label", "<[^>]*>", "")).alias("label"))


# The parser.


class _Page(HTMLParser):
    """One pass over a page that gathers all that the signals need."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements with how many sinks each adds; the sinks now open; open elements by tag, and those that hide text.
        self.open: list[tuple[str, int]] = []
        self.sinks: list[list[str]] = []
        self.count: dict[str, int] = {}
        self.hidden = 0
        self.title: list[str] | None = None
        self.words: list[str] = []
        self.anchors: list[tuple[str, list[str]]] = []
        self.scripts: list[str] = []
        self.styles: list[str] = []
        self.metas: list[dict[str, str]] = []
        self.alts: list[str] = []
        self.manifest: str | None = None
        self.form = False
        self.h1: list[str] | None = None
        self.ld: list[list[str]] = []
        self.address: list[list[str]] = []
        self.places: dict[str, list[list[str]]] = {p: [] for p in ADDRESS_PLACES}
        self.body_seen = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        sinks: list[list[str]] = []
        if tag == "title" and self.title is None:
            self.title = []
            sinks.append(self.title)
        elif tag == "a" and "href" in a:
            self.anchors.append((a["href"], []))
            sinks.append(self.anchors[-1][1])
        elif tag == "script":
            if "src" in a:
                self.scripts.append(a["src"])
            if a.get("type") == "application/ld+json":
                self.ld.append([])
                sinks.append(self.ld[-1])
        elif tag == "link" and "href" in a:
            if a.get("rel") == "stylesheet":
                self.styles.append(a["href"])
            elif a.get("rel") == "manifest" and self.manifest is None:
                self.manifest = a["href"]
        elif tag == "meta":
            self.metas.append(a)
        elif tag == "img" and "alt" in a:
            self.alts.append(a["alt"])
        elif tag == "form":
            self.form = True
        elif tag == "h1" and self.h1 is None:
            self.h1 = []
            sinks.append(self.h1)
        elif tag == "address":
            self.address.append([])
            sinks.append(self.address[-1])
        names = {tag, *("." + c for c in a.get("class", "").split()), "#" + a.get("id", ""), f"[itemprop={a.get('itemprop', '')}]"}
        for place in names & self.places.keys():
            self.places[place].append([])
            sinks.append(self.places[place][-1])
        if tag not in _VOID:
            self.open.append((tag, len(sinks)))
            self.sinks += sinks
            self.count[tag] = self.count.get(tag, 0) + 1
            self.hidden += tag in _HIDING
            if tag == "body":
                self.body_seen = True

    def handle_endtag(self, tag: str) -> None:
        while self.count.get(tag):
            name, sinks = self.open.pop()
            del self.sinks[len(self.sinks) - sinks :]
            self.count[name] -= 1
            self.hidden -= name in _HIDING
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        for s in self.sinks:
            s.append(data)
        if not self.hidden:
            self.words.append(data)


def _squeezed(parts: list[str] | str | None) -> str:
    return " ".join((parts if isinstance(parts, str) else " ".join(parts or [])).split())


def _company(value: str) -> bool:
    low = value.lower()
    generic = any(low == g or low.startswith(g + " |") for g in T.GENERIC_TITLES)
    return 3 <= len(value.encode()) <= 80 and not generic and not any(t in low for t in T.NO_NAME) and value.count(" ") <= 8 and sum("0" <= c <= "9" for c in value) < 4


def _postal(value: str) -> bool:
    looks = re.search(T.STREET_NUMBER, value) and re.search(T.STREET_TYPE, value) or re.search(T.CITY_STATE_ZIP, value)
    return bool(looks) and not any(t in value.lower() for t in T.NO_ADDRESS)


def _phone(value: str) -> str:
    value = value.strip()
    while value.startswith("tel:"):
        value = value[4:]
    digits = re.sub("[^0-9]", "", re.split("[;?]", value)[0])
    return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits if len(digits) == 10 else ""


def _host(url: str) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url.strip())
    return m[1].lower() if m else ""


def _first(items: list[str], accept) -> str:
    return next((x for x in items if x and accept(x)), "")


def _schema_type(blocks: list[list[str]]) -> str:
    for block in blocks:
        try:
            value = json.loads("".join(block))
        except ValueError:
            continue
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, dict) and isinstance(item.get("@type"), str):
                return item["@type"]
    return ""


def signals_of(html: str | None, base: str) -> dict:
    """All signals of one page: the columns of ``SIGNALS``."""
    from urllib.parse import urljoin

    page = _Page()
    page.feed(html or "")
    page.close()
    text = _squeezed(page.words)
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, A to Z alone
    own = _host(base)

    def artifact(href: str, label: list[str]) -> dict | None:
        url = urljoin(base, href) if href else None
        return url and {"url": url, "is_internal": own != "" and _host(url) == own, "label": " ".join(label).strip()}

    anchors = [a for a in (artifact(h, label) for h, label in page.anchors) if a]
    metas = {}
    for m in page.metas:
        for key in ("name", "property"):
            metas.setdefault((key, m.get(key)), m.get("content"))
    meta_lines = [f"{next(m[k] for k in ('name', 'property', 'http-equiv', 'itemprop') if m.get(k))}={m.get('content', '')}" for m in page.metas if any(m.get(k) for k in ("name", "property", "http-equiv", "itemprop"))]
    title = " ".join(page.title or []).strip()
    hrefs = [h for h, _ in page.anchors]
    mails = [h[7:].split("?")[0] for h in hrefs if h.lower().startswith("mailto:")]
    mail = _first(mails, lambda x: "@" in x) or (m[0] if "@" in text and (m := re.search(T.EMAIL, text)) else "")
    phone = _first([_phone(h) for h in hrefs if h.lower().startswith("tel:")], bool) or (_phone(m[0]) if re.search(T.PHONE_END, text) and (m := re.search(T.PHONE, text)) else "")
    named = [_squeezed(metas.get(("property", "og:site_name"))), _squeezed(metas.get(("name", "application-name")))]
    named += [_first([_squeezed(x) for x in page.alts], lambda x: _company(x) and "logo" not in x.lower()), _squeezed(page.h1), _squeezed(re.split("[|\\-—:]", _squeezed(title))[0])]
    places = page.address + [x for p in ADDRESS_PLACES for x in page.places[p]]
    category = next((c for c, words in T.CATEGORIES if any(w in low for w in words)), "")
    year = re.search(T.COPYRIGHT, text)
    holds = lambda phrases: any(p in low for p in phrases)
    social = lambda d: _first([a["url"] for a in anchors], lambda u: d in u)
    return {
        "page_title": title, "text_content": text, "word_count": len(text.split()), "anchor_hrefs": anchors,
        "script_srcs": [a for a in (artifact(s, []) for s in page.scripts) if a], "stylesheet_hrefs": [a for a in (artifact(s, []) for s in page.styles) if a],
        "manifest_url": urljoin(base, page.manifest) if page.manifest else "", "meta_lines": meta_lines,
        "company_name": _first(named, _company), "phone_number": phone, "address": _first([_squeezed(p) for p in places], _postal), "category": category,
        "has_viewport": ("name", "viewport") in metas, "has_form": page.form,
        "has_tel_link": any(h.lower().startswith("tel:") for h in hrefs), "has_mailto_link": any(h.lower().startswith("mailto:") for h in hrefs),
        "is_parked_domain": holds(T.PARKED), "outbound_domain_count": len({_host(a["url"]) for a in anchors if not a["is_internal"]} - {""}),
        "schema_org_business_type": _schema_type(page.ld), "email_address": mail, "meta_description": _squeezed(metas.get(("name", "description"))),
        "social_linkedin": social("linkedin.com"), "social_facebook": social("facebook.com"), "social_instagram": social("instagram.com"),
        "copyright_year": int(year[1]) if year else 0, "has_booking_signal": holds(T.BOOKING), "has_cta_signal": holds(T.CALL_TO_ACTION),
        "has_hours_signal": holds(T.HOURS), "has_reviews_signal": holds(T.REVIEWS),
        "has_contact_page": any("contact" in f"{a['url']} {a['label']}".lower() for a in anchors),
    }


_LINK = "array<struct<url:string,is_internal:boolean,label:string>>"
SIGNALS = (
    f"page_title string, text_content string, word_count int, anchor_hrefs {_LINK}, script_srcs {_LINK}, stylesheet_hrefs {_LINK}, manifest_url string,"
    " meta_lines array<string>, company_name string, phone_number string, address string, category string, has_viewport boolean, has_form boolean,"
    " has_tel_link boolean, has_mailto_link boolean, is_parked_domain boolean, outbound_domain_count int, schema_org_business_type string,"
    " email_address string, meta_description string, social_linkedin string, social_facebook string, social_instagram string, copyright_year int,"
    " has_booking_signal boolean, has_cta_signal boolean, has_hours_signal boolean, has_reviews_signal boolean, has_contact_page boolean"
)


def page_signals(pages: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """H1-H22 in one parse of each page (page_id, url, html), in Arrow batches; html stays out of the result unless it is among the columns kept."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    signals = StructType.fromDDL(SIGNALS)
    own = to_arrow_schema(signals)
    before = StructType([*StructType.fromDDL("page_id long, url string"), *(pages.schema[c] for c in kept)])
    passed, out = before.fieldNames(), StructType([*before, *signals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                told = [signals_of(page, base or "") for page, base in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True)]
                found = pa.RecordBatch.from_pylist(told, schema=own)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *found.columns], [*passed, *own.names])

    return pages.select("page_id", "url", *dict.fromkeys(("html", *kept))).mapInArrow(run, out)


def confidences(final_url: Column, location: Column, category: Column) -> tuple[Column, Column]:
    """How sure place and category are. An empty target location is part of every URL."""
    return F.when(F.lower(final_url).contains(F.lower(location)), 0.8).otherwise(0.0), F.when(category == "", 0.0).otherwise(0.65)


def provenance(fields: dict[str, tuple[Column, Column]]) -> Column:
    """JSON that tells where company name, category, phone number and address come from (value, source URL)."""
    kinds = {"company_name": ("website_extracted", "medium"), "category": ("derived_internal", "medium"), "phone_number": ("website_extracted", "medium"), "address": ("website_extracted", "high")}

    def one(name: str) -> Column:
        value, source = fields[name]
        kind, sure = kinds[name]
        parts = [F.lit(kind).alias("source_class"), *([F.lit("website_text").alias("derived_from")] if name == "category" else []), F.lit(sure).alias("confidence"), source.alias("source_url")]
        return F.when(F.coalesce(value, F.lit("")) != "", F.struct(*parts)).alias(name)

    return F.to_json(F.struct(*map(one, kinds)), {"ignoreNullFields": "false"})


def first_nonempty(pages: DataFrame, fields: tuple[str, ...], key: str = "lead", order: str = "prio", source: str = "url") -> DataFrame:
    """Of each lead's pages in order, the first non-empty value of each field and the page it is from."""
    aggregates = []
    for f in fields:
        best = F.min(F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(order, f, source)))
        aggregates += [F.coalesce(best[f], F.lit("")).alias(f), F.coalesce(best[source], F.lit("")).alias(f"{f}_source")]
    return pages.groupBy(key).agg(*aggregates)
