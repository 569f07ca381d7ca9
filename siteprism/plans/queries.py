"""The engine's queries over the test tables, each with the SQL that must give the same rows.

Where the tables lack an operator's columns (robots.txt, gaps, detections), rows are derived from a table by
arithmetic on its keys, the same in both forms, so that every query runs over a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.config import Config
from siteprism.functions import html, text, urls
from siteprism.operators import compliance, console, discovery, evaluate, gate, match, match_sql, resolve, tiers, warehouse
from siteprism.plans.pipeline import process
from siteprism.sources import leads as landed
from siteprism.sources import packs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


# SQL fragments that several queries share.

_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_PATH = r"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
HOST, PATH = _HOST.format(u="url"), _PATH.format(u="url")
KEY = rf"regexp_replace({HOST}, '^(www\.)+', '')"
TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_STRIP = "html"
for _p in (r"(?is)<head\b.*?</head>", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<noscript\b.*?</noscript>", r"(?s)<!--.*?-->", "<[^>]*>"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', ' ', 'g')"
VISIBLE = rf"trim(regexp_replace({_STRIP}, '\s+', ' ', 'g'))"
WORDS = f"CASE WHEN {VISIBLE} = '' THEN 0 ELSE len(string_split({VISIBLE}, ' ')) END"
DENIED = "|".join(h.replace(".", r"\.") for h in urls.DENIED_HOSTS)
#: Two hosts of the test pages stand in for the list, which none of them is on.
TEST_DENIED = ("therha.example.com", "example.org")


# Pages: URLs.


@query(f"SELECT page_id, {HOST} AS host, {KEY} AS domain_key, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS netloc FROM pages")
def url_host(spark, sf_dir):
    """X1, X6, X8."""
    return table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("host"), urls.domain_key("url").alias("domain_key"), urls.netloc("url").alias("netloc"))


@query(
    rf"""SELECT page_id, CASE WHEN regexp_matches({HOST}, '(^|\.)({DENIED})$') OR regexp_matches(lower({PATH}), '^({'|'.join(urls.DENIED_PATHS)})(/|$)') THEN NULL
    ELSE regexp_replace(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || {PATH}, '/+$', '') END AS site FROM pages"""
)
def url_normalize(spark, sf_dir):
    """X2, X3."""
    return table(spark, sf_dir, "pages").select("page_id", urls.site_url("url").alias("site"))


@query(rf"SELECT page_id, url FROM pages WHERE NOT regexp_matches({KEY}, '(^|\.)({'|'.join(h.replace('.', chr(92) + '.') for h in TEST_DENIED)})$')")
def host_denylist_anti(spark, sf_dir):
    """F8 as an equi-anti-join over host suffixes."""
    denied = spark.createDataFrame([(h,) for h in TEST_DENIED], "denied string")
    return discovery.without_denied_hosts(table(spark, sf_dir, "pages").select("page_id", "url"), denied)


@query(f"SELECT page_id, regexp_matches(lower({PATH}), '^(/en|/de)(/|$)') AS denied FROM pages")
def path_denylist(spark, sf_dir):
    """F9 with a list that occurs in the test pages."""
    return table(spark, sf_dir, "pages").select("page_id", urls.path_denied(urls.path("url"), ("/en", "/de")).alias("denied"))


_RESULTS = f"r AS (SELECT page_id // 100 AS run, page_id % 100 // 20 AS page, page_id % 20 AS pos, url, CASE WHEN page_id % 13 = 0 THEN NULL ELSE {KEY} END AS domain FROM pages)"
_OUTCOME = "o AS (SELECT *, CASE WHEN domain IS NULL THEN 'non_canonical' WHEN row_number() OVER (PARTITION BY run, domain ORDER BY page, pos) = 1 THEN 'queued' ELSE 'duplicate' END AS outcome FROM r)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search results: runs of a hundred, twenty to a result page; every thirteenth is no web URL."""
    p = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("ftp://"), urls.host("url"))).otherwise(F.col("url"))
    return p.select(F.expr("page_id div 100").alias("run"), F.expr("page_id % 100 div 20").alias("page"), (F.col("page_id") % 20).alias("pos"), url.alias("url"))


@query(f"WITH {_RESULTS}, {_OUTCOME}, k AS (SELECT run, domain, row_number() OVER (PARTITION BY run ORDER BY page, pos) AS place FROM o WHERE outcome = 'queued') SELECT * FROM k WHERE place <= 12")
def discover_first_per_domain(spark, sf_dir):
    """W1, O6, U7, T8."""
    return discovery.first_per_domain(_results(spark, sf_dir), 12).select("run", "domain", "place")


@query(
    f"""WITH {_RESULTS}, {_OUTCOME}, b AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'queued' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
    p AS (SELECT *, min(before) OVER (PARTITION BY run, page) AS page_before FROM b)
    SELECT run, count(*) FILTER (WHERE before < 12 AND outcome = 'queued') AS queued, count(*) FILTER (WHERE page_before < 12) AS raw_results,
    count(*) FILTER (WHERE before < 12 AND outcome = 'non_canonical') AS non_canonical, count(*) FILTER (WHERE before < 12 AND outcome = 'duplicate') AS duplicates,
    count(DISTINCT page) FILTER (WHERE page_before < 12) AS pages FROM p GROUP BY run"""
)
def discover_counters(spark, sf_dir):
    """A6."""
    return discovery.counters(_results(spark, sf_dir), 12)


@query(
    """SELECT page_id, i - 1 AS pos, url || CASE WHEN i = 1 THEN '' ELSE '#2' END AS url, 'Title ' || page_id AS title FROM pages, (SELECT unnest([1, 2]) AS i) WHERE page_id % 7 <> 0"""
)
def search_json(spark, sf_dir):
    """Results out of search pages' JSON; broken JSON gives none."""
    p = table(spark, sf_dir, "pages")
    result = lambda u: F.struct(F.concat(F.lit(" "), u).alias("url"), F.concat_ws(" ", F.lit("Title"), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("description"))
    body = F.to_json(F.struct(F.struct(F.array(result(F.col("url")), result(F.concat("url", F.lit("#2")))).alias("results")).alias("web")))
    bodies = p.select("page_id", F.when(F.col("page_id") % 7 == 0, F.lit("{broken")).otherwise(body).alias("body"))
    return discovery.search_results(bodies).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "title")


# Pages: html.


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    """H1."""
    return table(spark, sf_dir, "pages").select("page_id", html.title_of("html").alias("title"))


_A = r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>(.*?)</a>".replace("\\\"", '"')
_ANCHORS = rf"""x AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '{_A}', 1)) AS href, unnest(regexp_extract_all(html, '{_A}', 2)) AS label, generate_subscripts(regexp_extract_all(html, '{_A}', 1), 1) - 1 AS pos FROM pages),
a AS (SELECT page_id, base, pos, lower(regexp_extract(base, '^([a-zA-Z]+://[^/?#]*)', 1)) || href AS url, trim(regexp_replace(label, '<[^>]*>', '', 'g')) AS label FROM x)"""


@query(f"WITH {_ANCHORS} SELECT page_id, CAST(pos AS BIGINT) AS pos, url, label FROM a")
def page_anchors(spark, sf_dir):
    """H3, X4, X5."""
    return html.anchors_of(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "label")


@query(f"WITH {_ANCHORS} SELECT page_id, count(*) AS anchors, count(DISTINCT url) AS links, count(DISTINCT CASE WHEN {_HOST.format(u='url')} <> {_HOST.format(u='base')} THEN {_HOST.format(u='url')} END) AS outbound FROM a GROUP BY page_id")
def anchor_counts(spark, sf_dir):
    """A1, U7."""
    a = html.anchors_of(table(spark, sf_dir, "pages"))
    outside = F.when(~urls.is_internal("base", "url"), urls.host("url"))
    return a.groupBy("page_id").agg(F.count("*").alias("anchors"), F.count_distinct("url").alias("links"), F.count_distinct(outside).alias("outbound"))


_TOKENS = {"denied": ("that", "und"), "scores": ((100, ("the",)), (80, ("tion", "que")), (70, ("sch",)), (60, ("ing", "con")), (40, ("en",)), (20, ("a",)))}


def _contains(expr: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in tokens) + ")"


_SCORE = f"CASE WHEN {_contains('j', _TOKENS['denied'])} THEN -1 ELSE " + " + ".join(f"CASE WHEN {_contains('j', t)} THEN {n} ELSE 0 END" for n, t in _TOKENS["scores"]) + " END"


@query(
    rf"""WITH {_ANCHORS}, l AS (SELECT page_id, base, pos, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS link, label FROM a),
    s AS (SELECT *, translate(trim({_PATH.format(u="link")}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ' || translate(label, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS j FROM l
    WHERE regexp_replace({_PATH.format(u="link")}, '/+$', '') NOT IN ('', regexp_replace({_PATH.format(u="base")}, '/+$', ''))),
    v AS (SELECT page_id, link, pos, {_SCORE} AS score FROM s), d AS (SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS n FROM v WHERE score > 0),
    t AS (SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link) AS place FROM d WHERE n = 1) SELECT * FROM t WHERE place <= 3"""
)
def internal_link_top3(spark, sf_dir):
    """X9, X10, W3, with tokens that occur in the test pages."""
    return discovery.priority_links(html.anchors_of(table(spark, sf_dir, "pages")), 3, **_TOKENS)


@query(f"SELECT page_id, CAST({WORDS} AS BIGINT) AS words, md5({VISIBLE}) AS text_md5 FROM pages")
def visible_text_words(spark, sf_dir):
    """H2, A15, H21."""
    p = table(spark, sf_dir, "pages").select("page_id", html.visible_text("html").alias("t"))
    return p.select("page_id", text.word_count("t").cast("long").alias("words"), F.md5("t").alias("text_md5"))


_LOW = "rejected_heuristic_low_word_count"
_FLAGSHIP = f"WITH w AS (SELECT page_id, {WORDS} AS n FROM pages) SELECT CASE WHEN n < 150 THEN '{_LOW}' WHEN page_id % 29 = 0 THEN 'rejected_heuristic_parked_domain' ELSE 'pending_tier_1' END AS pipeline_status, count(*) AS n FROM w GROUP BY 1"


@query(_FLAGSHIP)
def word_gate_counts(spark, sf_dir):
    """The flagship: pages through the gate to counts by status."""
    p = table(spark, sf_dir, "pages")
    lead = p.select(
        text.word_count(html.visible_text("html")).alias("word_count"), (F.col("page_id") % 29 == 0).alias("is_parked_domain"), F.lit(True).alias("crawl_allowed"), F.lit(True).alias("has_viewport"),
        F.expr("cast(array() as array<struct<url:string>>)").alias("script_srcs"), F.expr("cast(array() as array<struct<url:string>>)").alias("stylesheet_hrefs"),
    )
    return gate.gate(lead, Config()).groupBy(F.col("gate_status").alias("pipeline_status")).agg(F.count("*").alias("n"))


@query(
    f"""WITH h AS (SELECT {HOST} AS host, page_id, url, CASE WHEN page_id % 3 = 0 THEN {TITLE} ELSE '' END AS title FROM pages)
    SELECT host, coalesce(arg_min(title, page_id) FILTER (WHERE title <> ''), '') AS title, coalesce(arg_min(url, page_id) FILTER (WHERE title <> ''), '') AS title_source FROM h GROUP BY host"""
)
def first_nonempty(spark, sf_dir):
    """A7, J16."""
    p = table(spark, sf_dir, "pages")
    pages = p.select(urls.host("url").alias("host"), "page_id", "url", F.when(F.col("page_id") % 3 == 0, html.title_of("html")).otherwise("").alias("title"))
    return html.first_nonempty(pages, ("title",), "host", "page_id")


@query()
def html_signals(spark, sf_dir):
    """H1-H22 in one parse."""
    return html.page_signals(table(spark, sf_dir, "pages"))


# Documents: text.


@query(rf"SELECT doc_id, regexp_extract(text, '({text.EMAIL})', 1) AS email FROM documents WHERE regexp_matches(text, '{text.EMAIL}')")
def doc_email(spark, sf_dir):
    """H12."""
    return table(spark, sf_dir, "documents").select("doc_id", text.email("text").alias("email")).where("email <> ''")


@query(
    rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_extract(text, '({text.PHONE})', 1), '[^0-9]', '', 'g') AS n FROM documents)
    SELECT doc_id, CASE WHEN length(n) = 11 AND n[1] = '1' THEN n[2:] ELSE n END AS phone FROM d WHERE length(n) = 10 OR (length(n) = 11 AND n[1] = '1')"""
)
def doc_phone(spark, sf_dir):
    """H7."""
    return table(spark, sf_dir, "documents").select("doc_id", text.phone("text").alias("phone")).where("phone <> ''")


_LOWTEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"SELECT doc_id, {_contains(_LOWTEXT, text.BOOKING)} AS booking, {_contains(_LOWTEXT, text.CALL_TO_ACTION)} AS cta, {_contains(_LOWTEXT, text.HOURS)} AS hours, {_contains(_LOWTEXT, text.REVIEWS)} AS reviews, {_contains(_LOWTEXT, text.PARKED)} AS parked, {_contains(_LOWTEXT, ('license', 'reserved'))} AS legal FROM documents"
)
def doc_keyword_flags(spark, sf_dir):
    """H13, H18; and words that the documents have."""
    lists = {"booking": text.BOOKING, "cta": text.CALL_TO_ACTION, "hours": text.HOURS, "reviews": text.REVIEWS, "parked": text.PARKED, "legal": ("license", "reserved")}
    # a generator's output is computed once, so the text is lower-cased once for all lists
    low = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(F.struct(urls.ascii_lower("text").alias("low")))))
    return low.select("doc_id", *[text.holds_any("low", v).alias(k) for k, v in lists.items()])


_GROUPS = (("law", ("license", "rights reserved")), ("german", ("schkeit", "ung sch")), ("the", ("thshin", "therha")), ("que", ("queque",)))
_CASE = "CASE " + " ".join(f"WHEN {_contains(_LOWTEXT, w)} THEN '{n}'" for n, w in _GROUPS) + " ELSE '' END"


@query(f"SELECT {_CASE} AS category, count(*) AS n FROM documents GROUP BY 1")
def doc_category(spark, sf_dir):
    """H10, with keywords that occur."""
    return table(spark, sf_dir, "documents").groupBy(text.category("text", _GROUPS).alias("category")).agg(F.count("*").alias("n"))


@query(
    rf"""WITH t AS (SELECT page_id, {TITLE} AS title FROM pages), h AS (SELECT page_id, trim(regexp_replace(regexp_extract(regexp_replace(title, '\s+', ' ', 'g'), '^([^|\-—:]*)', 1), '\s+', ' ', 'g')) AS head FROM t)
    SELECT page_id, CASE WHEN strlen(head) BETWEEN 3 AND 80 AND length(head) - length(replace(head, ' ', '')) <= 8 AND len(regexp_extract_all(head, '[0-9]')) < 4
    AND NOT regexp_matches(lower(head), '^({"|".join(text.GENERIC_TITLES)})($| \|)') AND NOT {_contains("lower(head)", text.NO_NAME)} THEN head ELSE '' END AS company FROM h"""
)
def title_company(spark, sf_dir):
    """F20, F21, H8."""
    return table(spark, sf_dir, "pages").select("page_id", text.title_company(html.title_of("html")).alias("company"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 197) || '...' END AS shown, substr(text, 1, 4000) AS excerpt FROM documents")
def text_excerpts(spark, sf_dir):
    """P3, P7."""
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated("text").alias("shown"), tiers.excerpt("text", tiers.TEXT_CHARS).alias("excerpt"))


# Compliance.

_ROBOTS = (
    "User-agent: *\nDisallow: /", "User-agent: *\nDisallow: /private\n", "# all\nUser-Agent: other\nDisallow: /", "User-agent: siteprism # us\nDisallow: / # no", "",
    "User-agent: *\nUser-agent: other\nDisallow: /", "Disallow: /", "USER-AGENT:*\n\nDISALLOW:   /  ",
)
_ROBOTS_CLOSED = (True, False, False, True, False, False, False, True)


@query(
    "SELECT page_id, (page_id % 8 IN (0, 3, 7) AND page_id % 5 <> 0) AS closed FROM pages"
)
def robots_gate(spark, sf_dir):
    """eight bodies dealt over the pages; a file that doesn't exist allows."""
    body = F.element_at(F.array(*map(F.lit, _ROBOTS)), (F.col("page_id") % 8 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.struct((F.col("page_id") % 5 != 0).alias("exists"), body.alias("body")).alias("robots"))
    return p.select("page_id", (~compliance.crawl_eligibility("robots", "siteprism")["allowed"]).alias("closed"))


_OCTETS = "(c_custkey * 7919) % 256 AS a, (c_custkey * 104729) % 256 AS b, (c_custkey * 31) % 256 AS c, c_custkey % 256 AS d"


@query(
    f"""WITH o AS (SELECT c_custkey, {_OCTETS} FROM customer) SELECT c_custkey, a || '.' || b || '.' || c || '.' || d AS ip,
    (a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19))
    OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224 OR (a = 0 AND b = 0 AND c = 0 AND d = 0)) AS closed FROM o"""
)
def ip_gate(spark, sf_dir):
    """F3, over addresses dealt from customer keys."""
    o = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[x.replace("c_custkey % 256 AS d", "c_custkey % 256 AS d") for x in _OCTETS.split(", ")])
    ip = F.concat_ws(".", *[F.col(x).cast("string") for x in "abcd"])
    return o.select("c_custkey", ip.alias("ip"), compliance.ipv4_closed(ip).alias("closed"))


#: Addresses by the last digit of a key ({h}: the key in hexadecimal), and whether each is closed.
_IPV6 = (
    ("::1", True), ("fe80::{h}%eth0", True), ("[FD12:3456::{h}]", True), ("2001:db8::{h}", True), ("2606:4700::{h}", False), ("ff02::{h}", True), ("not an address {h}", False), ("2001:DB9:0:0:0:0:0:{h}", False),
    ("fec0::{h}", False), ("::ffff:10.0.0.1", False), ("febf:1:2:3:4:5:6:{h}", True), ("1:2:3:4:5:6:7:8:{h}", False), ("::", True), ("1::2::{h}", False),
)
_BY_KEY = "CASE c_custkey % 14 " + " ".join(f"WHEN {i} THEN replace('{a}', '{{h}}', lower(printf('%x', CAST(c_custkey % 65536 AS INTEGER))))" for i, (a, _) in enumerate(_IPV6)) + " END"


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ip = F.element_at(F.array(*[F.lit(a) for a, _ in _IPV6]), (k % 14 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.replace(ip, F.lit("{h}"), F.lower(F.hex(k % 65536))).alias("ip"))


@query(f"SELECT c_custkey, {_BY_KEY} AS ip, c_custkey % 14 IN ({', '.join(str(i) for i, (_, c) in enumerate(_IPV6) if c)}) AS closed FROM customer")
def ipv6_gate(spark, sf_dir):
    """F4, over addresses of all kinds dealt from customer keys."""
    return _addresses(spark, sf_dir).withColumn("closed", compliance.ipv6_closed("ip"))


_NETWORKS = ("2001:db8::/32", "2001::/16", "fd12:3456::/31", "fe80::/10", "::/0", "2606:4700::/28", "2606:4700::/127")


@query(
    f"""SELECT c_custkey, {_BY_KEY} AS ip, CASE c_custkey % 14 WHEN 1 THEN 'fe80::/10' WHEN 10 THEN 'fe80::/10' WHEN 2 THEN 'fd12:3456::/31' WHEN 3 THEN '2001:db8::/32' WHEN 7 THEN '2001::/16' WHEN 6 THEN NULL WHEN 11 THEN NULL WHEN 13 THEN NULL
    WHEN 4 THEN CASE WHEN c_custkey % 65536 < 2 THEN '2606:4700::/127' ELSE '2606:4700::/28' END ELSE '::/0' END AS network FROM customer"""
)
def ipv6_networks(spark, sf_dir):
    """F4 against a table of networks: an equi-join by prefix, the longest wins."""
    nets = spark.createDataFrame([(n,) for n in _NETWORKS], "network string")
    return compliance.longest_prefix(_addresses(spark, sf_dir), nets)


_REFERENCES = (
    ("../b/c.html?x=../y#z", "/b/c.html?x=../y#z"), ("./d", "/a/d"), ("../../../e/", "/e/"), (".", "/a/"), ("..", "/"), ("/f/./g/../h", "/f/h"), ("?q=1", "/a/b?q=1"), ("#t", "/a/b?k=1#t"), ("i/j/../..", "/a/"), ("k/..l/.m", "/a/k/..l/.m"),
    ("//other.example/../x", None), ("mailto:x@y.z", None), ("", None),
)


@query(
    "SELECT page_id, CASE page_id % 13 " + " ".join(f"WHEN {i} THEN lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || '{told}'" for i, (_, told) in enumerate(_REFERENCES) if told)
    + " WHEN 10 THEN lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://other.example/../x' WHEN 11 THEN 'mailto:x@y.z' END AS resolved FROM pages"
)
def url_references(spark, sf_dir):
    """References of every kind, dot segments worked off."""
    k = F.col("page_id")
    origin = F.concat(urls.scheme("url"), F.lit("://"), urls.netloc("url"))
    ref = F.element_at(F.array(*[F.lit(r) for r, _ in _REFERENCES]), (k % 13 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.resolve(F.concat(origin, F.lit("/a/b?k=1")), ref).alias("resolved"))


@query(
    """WITH u AS (SELECT c_custkey, c_custkey % 8 AS k FROM customer) SELECT c_custkey, CASE k WHEN 0 THEN 'disallowed_hostname: localhost' WHEN 1 THEN 'disallowed_hostname: a.local' WHEN 2 THEN 'unsupported_scheme: ftp'
    WHEN 3 THEN 'disallowed_ip: 10.0.0.1' WHEN 4 THEN 'invalid_url' WHEN 5 THEN 'disallowed_hostname: metadata.google.internal' END AS verdict, k IN (0, 1, 5) AS html FROM u"""
)
def fetch_gate(spark, sf_dir):
    """F5, F6, F7."""
    url = F.array(*map(F.lit, ("http://localhost/x", "https://a.local", "ftp://example.com/", "http://10.0.0.1:8080/", "no url", "http://u@metadata.google.internal/", "https://example.com/", "http://8.8.8.8/")))
    kind = F.array(*map(F.lit, ("text/html; charset=utf-8", "TEXT/HTML", "image/png", "application/json", "", "application/xhtml+xml", "text/plain", "video/mp4")))
    at = lambda a: F.element_at(a, (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", compliance.fetch_verdict(at(url)).alias("verdict"), compliance.supported_content_type(at(kind)).alias("html"))


# Leads derived from pages, and their evaluation.


def leads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lead for each page."""
    return leads_from_pages(table(spark, sf_dir, "pages"))


def leads_from_pages(pages: DataFrame) -> DataFrame:
    """Pages, a table or a stream, as leads; what they lack comes from arithmetic on page_id. ``LEADS`` is the same in SQL."""
    k = F.col("page_id")
    link = lambda u: F.array(F.struct(u.alias("url"), F.lit(False).alias("is_internal"), F.lit("").alias("label")))
    none = F.expr("cast(array() as array<struct<url:string,is_internal:boolean,label:string>>)")
    anchor = F.when(k % 4 == 0, link(F.lit("https://www.facebook.com/x"))).when(k % 4 == 1, link(F.lit("https://a.example/privacy"))).otherwise(none)
    script = F.when(k % 31 == 0, link(F.lit("https://static1.SQUARESPACE.com/a.js"))).when(k % 31 == 1, link(F.lit("/wp-content/a.js"))).when(k % 31 == 2, link(F.lit("https://code.jquery.com/jquery-3.6.0.min.js"))).otherwise(none)
    return pages.select(
        k.cast("string").alias("id"), k, F.concat(F.lit("run"), (k % 5).cast("string")).alias("run_id"), F.when(k % 37 == 0, F.lit("https://www.yelp.com/biz/x")).otherwise(F.col("url")).alias("source_url"),
        F.col("url").alias("final_url"), F.lit("search").alias("discovery_source"), F.lit("hvac").alias("target_industry"), F.when(k % 41 == 0, F.lit("  ")).otherwise(html.title_of("html")).alias("page_title"),
        text.word_count(html.visible_text("html")).alias("word_count"), (k % 2 == 0).alias("has_viewport"), (k % 3 == 0).alias("has_form"), (k % 8 == 0).alias("has_tel_link"), (k % 9 == 0).alias("has_mailto_link"),
        (k % 29 == 0).alias("is_parked_domain"), F.when(k % 11 == 0, 0).otherwise(2015 + k % 12).cast("int").alias("copyright_year"), (k % 7 == 0).alias("has_booking_signal"), (k % 5 < 2).alias("has_cta_signal"),
        (k % 4 == 1).alias("has_hours_signal"), (k % 6 == 0).alias("has_reviews_signal"), (k % 10 == 3).alias("has_contact_page"), F.when(k % 6 == 1, F.lit("5035551234")).when(k % 6 == 2, F.lit("  ")).alias("phone_number"),
        F.when(k % 14 == 5, F.lit("1 Main St")).alias("address"), F.when(k % 17 == 0, F.lit(False)).when(k % 19 != 0, F.lit(True)).alias("crawl_allowed"), F.when(k % 34 == 0, F.lit("robots_txt_disallow_all")).otherwise("").alias("crawl_disallowed_reason"),
        (k % 23 == 0).alias("is_no_website_opportunity"), anchor.alias("anchor_hrefs"), script.alias("script_srcs"), none.alias("stylesheet_hrefs"),
        F.struct((k % 2 == 1).alias("exists")).alias("robots_txt"), F.struct((k % 3 == 1).alias("exists")).alias("sitemap_xml"),
    )


LEADS = f"""l AS (SELECT page_id AS k, CAST(page_id AS VARCHAR) AS id, 'run' || (page_id % 5) AS run_id, page_id % 37 = 0 AS directory, page_id % 41 <> 0 AND {TITLE} <> '' AS titled, {WORDS} AS words,
page_id % 2 = 0 AS viewport, page_id % 3 = 0 AS form, page_id % 8 = 0 AS tel, page_id % 9 = 0 AS mailto, page_id % 29 = 0 AS parked, CASE WHEN page_id % 11 = 0 THEN 0 ELSE 2015 + page_id % 12 END AS year,
page_id % 7 = 0 AS booking, page_id % 5 < 2 AS cta, page_id % 4 = 1 AS hours, page_id % 6 = 0 AS reviews, page_id % 10 = 3 AS contact, page_id % 6 = 1 OR page_id % 8 = 0 AS phone, page_id % 14 = 5 AS address,
CASE WHEN page_id % 17 = 0 THEN false WHEN page_id % 19 <> 0 THEN true END AS crawl, page_id % 34 = 0 AS robots, page_id % 23 = 0 AS nosite, page_id % 4 = 0 AS social, page_id % 4 = 1 AS privacy, page_id % 31 = 0 AS builder FROM pages)"""
_OUT = "list_filter([CASE WHEN NOT viewport THEN 'missing_mobile_viewport' END, CASE WHEN NOT titled THEN 'missing_page_title' END, CASE WHEN year > 0 AND year <= 2023 THEN 'stale_copyright_' || year END], lambda x: x IS NOT NULL)"
_MISS = {
    "website_modernization": "list_filter([CASE WHEN NOT viewport THEN 'mobile_responsive_design' END, CASE WHEN NOT form THEN 'contact_form' END, CASE WHEN NOT cta THEN 'clear_primary_cta' END, CASE WHEN NOT privacy THEN 'privacy_policy' END], lambda x: x IS NOT NULL)",
    "voice_ai_agent": "list_filter([CASE WHEN NOT phone THEN 'phone_conversion_flow' END, CASE WHEN NOT booking THEN 'appointment_capture' END, CASE WHEN NOT hours THEN 'published_hours' END], lambda x: x IS NOT NULL)",
    "smma": "list_filter([CASE WHEN NOT social THEN 'social_presence_links' END, CASE WHEN NOT reviews THEN 'social_proof' END, CASE WHEN NOT cta THEN 'campaign_landing_cta' END], lambda x: x IS NOT NULL)",
}


def _gaps(campaign: str) -> str:
    return f"g AS (SELECT *, {_OUT} AS outd, {_MISS[campaign]} AS miss, NOT directory AND (phone OR address OR contact) AS real FROM l)"


@query(f"WITH {LEADS}, {_gaps('website_modernization')} SELECT id, array_to_string(outd, ',') AS outdated, array_to_string(miss, ',') AS missing FROM g")
def gap_arrays(spark, sf_dir):
    """X18, X19, X22."""
    return leads_of(spark, sf_dir).select("id", F.array_join(evaluate.outdated(2026), ",").alias("outdated"), F.array_join(evaluate.missing("website_modernization"), ",").alias("missing"))


@query(f"WITH {LEADS}, {_gaps('smma')} SELECT id, round(least(1.0::DOUBLE, 0.35::DOUBLE + 0.12::DOUBLE * len(miss) + 0.10::DOUBLE * len(outd)), 4) AS score, CASE WHEN social THEN 1 ELSE 0 END AS social FROM g")
def gap_score(spark, sf_dir):
    """X17, A3."""
    n = lambda c: F.size(c)
    return leads_of(spark, sf_dir).select("id", evaluate.score(n(evaluate.missing("smma")), n(evaluate.outdated(2026))).alias("score"), evaluate.social_links().alias("social"))


def _evaluated_sql(campaign: str) -> str:
    return f"""WITH {LEADS}, {_gaps(campaign)}, w AS (SELECT *, CASE WHEN nosite THEN 'n' WHEN crawl = false THEN 'c' WHEN parked THEN 'p' ELSE '' END AS why FROM g), q AS (SELECT *, why = '' AND real AND (len(miss) > 0 OR len(outd) >= 2) AS qualified FROM w)
    SELECT id, CASE why WHEN 'n' THEN 'excluded_no_website_opportunity' WHEN 'c' THEN 'excluded_crawl_disallowed' WHEN 'p' THEN 'rejected_parked_domain' ELSE CASE WHEN qualified THEN 'qualified_deterministic' ELSE 'rejected_deterministic' END END AS pipeline_status,
    CASE WHEN why = '' THEN round(least(1.0::DOUBLE, 0.35::DOUBLE + 0.12::DOUBLE * len(miss) + 0.10::DOUBLE * len(outd)), 4) ELSE 0.0::DOUBLE END AS score, qualified AS is_qualified_lead,
    CASE why WHEN 'n' THEN 'no_website_opportunity' WHEN 'c' THEN CASE WHEN robots THEN 'robots_txt_disallow_all' ELSE 'crawl_disallowed' END WHEN 'p' THEN 'parked_domain' ELSE CASE WHEN NOT qualified THEN 'deterministic_gate_reject' END END AS rejection_reason,
    why = '' AND booking AS has_booking_widget, why = '' AND viewport AS is_mobile_optimized, why = '' AND (phone OR mailto OR contact) AS has_clear_contact_info, why = '' AND real AS real FROM q"""


def _evaluated(spark: SparkSession, sf_dir: str, campaign: str) -> DataFrame:
    rows = evaluate.evaluate(leads_of(spark, sf_dir), Config(campaign=campaign))
    return rows.select("id", "pipeline_status", "score", "is_qualified_lead", "rejection_reason", "has_booking_widget", "is_mobile_optimized", "has_clear_contact_info", F.col("evaluation_flags.is_real_business_deterministic").alias("real"))


@query(_evaluated_sql("website_modernization"))
def qualify_status(spark, sf_dir):
    """F14-F17."""
    return _evaluated(spark, sf_dir, "website_modernization")


@query(_evaluated_sql("voice_ai_agent"))
def qualify_voice(spark, sf_dir):
    """F14-F17, X18."""
    return _evaluated(spark, sf_dir, "voice_ai_agent")


_GATE = "CASE WHEN crawl = false THEN 'rejected_compliance' WHEN words < 150 THEN 'rejected_heuristic_low_word_count' WHEN parked THEN 'rejected_heuristic_parked_domain' WHEN builder THEN 'rejected_heuristic_campaign_mismatch' ELSE 'pending_tier_1' END"


@query(rf"WITH {LEADS} SELECT id, {_GATE} AS gate_status, CASE WHEN {_GATE} = 'rejected_heuristic_campaign_mismatch' THEN 'squarespace\.com' END AS signature, CASE WHEN {_GATE} = 'pending_tier_1' THEN k % 31 = 1 END AS is_wordpress FROM l")
def gate_status(spark, sf_dir):
    """F10-F13, X23, D1."""
    return gate.gate(leads_of(spark, sf_dir), Config()).select("id", "gate_status", F.col("gate_flags.rejection_signature").alias("signature"), F.col("gate_flags.is_wordpress").alias("is_wordpress"))


_PROCESSED = f"""{LEADS}, {_gaps('website_modernization')}, p AS (SELECT *, {_GATE} AS gs, CASE WHEN nosite THEN 'excluded_no_website_opportunity' WHEN parked THEN 'rejected_parked_domain' WHEN real AND (len(miss) > 0 OR len(outd) >= 2) THEN 'qualified_deterministic' ELSE 'rejected_deterministic' END AS ds FROM g)"""


@query(f"WITH {_PROCESSED} SELECT run_id, CASE WHEN gs = 'pending_tier_1' THEN ds ELSE gs END AS pipeline_status, count(*) AS n FROM p GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    """A9 over the whole write path."""
    return warehouse.status_counts(process(leads_of(spark, sf_dir), Config()))


@query(
    f"""WITH {_PROCESSED}, s AS (SELECT run_id, CASE WHEN gs = 'pending_tier_1' THEN ds ELSE gs END AS s FROM p) SELECT run_id, count(*) AS discovered, count(*) FILTER (WHERE s = 'rejected_deterministic') AS rejected,
    count(*) FILTER (WHERE starts_with(s, 'excluded_')) AS skipped, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'qualified_deterministic') AS persisted FROM s GROUP BY run_id"""
)
def status_class_counters(spark, sf_dir):
    """A8."""
    return warehouse.console_counters(process(leads_of(spark, sf_dir), Config()))


@query(
    f"""WITH {_PROCESSED} SELECT id, CASE WHEN gs <> 'pending_tier_1' THEN gs WHEN ds = 'excluded_no_website_opportunity' THEN 'tier2_queued' ELSE 'tier2_queued' END AS pipeline_status,
    CASE WHEN gs <> 'pending_tier_1' THEN NULL WHEN ds <> 'qualified_deterministic' THEN 'deterministic_path_not_qualified' ELSE 'score_v2_missing' END AS tier1_skip_reason FROM p"""
)
def final_status(spark, sf_dir):
    """F18, F19 and the status that results with the tiers on."""
    config = Config(llm_enabled=True, signals_v2=True, scoring_v2=True, tier2_industries=("hvac",))
    return process(leads_of(spark, sf_dir), config).select("id", "pipeline_status", "tier1_skip_reason")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'deterministic_path_not_qualified' WHEN o_orderkey % 7 = 0 THEN 'score_v2_missing' WHEN (o_orderkey % 100) / 100.0::DOUBLE < 0.55 THEN 'score_v2_below_threshold'
    WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'unsupported_industry' END AS skip1, CASE WHEN o_orderpriority <> '5-LOW' THEN 'unsupported_industry' END AS skip2 FROM orders"""
)
def tier_skips(spark, sf_dir):
    """F18, F19 over orders as leads."""
    o = table(spark, sf_dir, "orders")
    config = Config(llm_enabled=True, signals_v2=True, scoring_v2=True, tier1_industries=("1-urgent", "2-high"), tier2_industries=("5-low",))
    status = F.when(F.col("o_orderstatus") == "F", "qualified_deterministic").otherwise("rejected_deterministic")
    score = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100) / 100.0)
    campaign, industry = F.lit("smma"), F.concat(F.lit(" "), "o_orderpriority")
    return o.select("o_orderkey", tiers.tier1_skip_reason(status, score, campaign, industry, config).alias("skip1"), tiers.tier2_skip_reason(campaign, industry, config).alias("skip2"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Own' WHEN c_custkey % 3 = 0 THEN c_name ELSE NULL END AS company_name, CASE WHEN c_custkey % 3 = 0 THEN 'tier2_complete' WHEN c_custkey % 3 = 1 THEN 'tier2_failed' ELSE 'tier2_queued' END AS pipeline_status,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 = 0 ELSE false END AS has_booking_widget, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS gaps FROM customer"""
)
def tier2_enrich(spark, sf_dir):
    """J14, S18."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    no = F.lit(False)
    leads = c.select(
        k.alias("id"), F.when(k % 2 == 0, "Own").alias("company_name"), *[F.lit("").alias(x) for x in ("category", "phone_number", "address", "overall_digital_health")], F.lit("tier2_queued").alias("pipeline_status"),
        *[no.alias(x) for x in ("has_booking_widget", "is_mobile_optimized", "has_clear_contact_info")], F.array(F.lit("old")).alias("identified_service_gaps"), F.array(F.lit("old")).alias("missing_critical_features"),
    )
    profile = F.struct(F.col("c_name").alias("business_name"), *[F.lit("").alias(x) for x in ("category", "phone_number", "address")])
    gaps = F.struct((k % 5 == 0).alias("has_online_booking"), no.alias("is_mobile_optimized"), no.alias("has_clear_contact_info"), F.array(F.lit("new")).alias("outdated_indicators"), F.array(F.lit("new")).alias("missing_critical_features"))
    output = F.struct(profile.alias("business_profile"), gaps.alias("service_gaps"), F.lit("summary").alias("operator_summary"), F.lit(0.5).alias("confidence"))
    results = c.where("c_custkey % 3 <> 2").select(k.alias("id"), F.when(k % 3 == 1, "tier2_failed").otherwise("tier2_complete").alias("status"), F.when(k % 3 == 0, output).alias("output"))
    return tiers.enrich(leads, results).select("id", "company_name", "pipeline_status", "has_booking_widget", F.array_join("identified_service_gaps", ",").alias("gaps"))


@query()
def tier_calls(spark, sf_dir):
    """Both tiers' calls with the stand-in models."""
    lead = process(leads_of(spark, sf_dir), Config()).where("pipeline_status = 'qualified_deterministic'")
    empty = {c: F.lit("") for c in ("initial_url", "timestamp", "target_location", "company_name", "category", "text_content", "raw_html")}
    lead = lead.withColumns(empty)
    lead = lead.withColumn("context", tiers.context(Config()))
    return tiers.call_tier(lead, "tier1", tiers.stub_gate, Config()).unionByName(tiers.call_tier(lead, "tier2", tiers.stub_enrichment, Config()))


# Stored rows.


@query("SELECT o_orderkey AS id, CAST(o_custkey % 100 AS VARCHAR) AS run_id, o_totalprice AS score FROM orders ORDER BY o_orderdate DESC, id LIMIT 25")
def recent_topk(spark, sf_dir):
    """O1, O2 (a top-k report)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("string").alias("run_id"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"))
    return warehouse.newest(o, 25).drop("created_at")


@query("SELECT id, run_id FROM (SELECT o_orderkey AS id, o_custkey % 100 AS run_id, o_orderdate FROM orders) WHERE run_id = 7 ORDER BY o_orderdate DESC, id LIMIT 50")
def run_leads_topk(spark, sf_dir):
    """O3, F23 (a top-k report)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return warehouse.newest(o.where("run_id = 7"), 50, 200).drop("created_at")


@query("SELECT event_id AS id, event_type AS pipeline_status, value AS score FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 50")
def status_topk(spark, sf_dir):
    """O4 (a top-k report)."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("pipeline_status"), F.col("value").alias("score"))
    return warehouse.best_in_status(e, "purchase")


@query("SELECT o_custkey % 100 AS run_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost FROM orders GROUP BY 1")
def cost_by_run(spark, sf_dir):
    """A10, in cents."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("run_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("llm_processing_cost"))
    return warehouse.cost_by_run(o)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0")
def json_prop_filter(spark, sf_dir):
    """P2, X21."""
    e = table(spark, sf_dir, "events").withColumn("m", landed.json_object("props"))
    return e.select("event_id", F.col("m")["k"].cast("int").alias("k")).where("k % 3 = 0")


_STATES = "('tier1_skipped'), ('tier1_passed'), ('tier2_complete'), ('tier1_rejected'), ('tier2_failed'), ('tier2_queued'), ('tier2_running'), (''), ('other')"


@query(
    f"""WITH s AS (SELECT * FROM (VALUES {_STATES}) t(s)) SELECT o_orderkey % 10 AS bucket, s, CASE WHEN s = '' OR contains(s, 'skipped') THEN 'skipped' WHEN contains(s, 'passed') OR contains(s, 'complete') THEN 'passed'
    WHEN contains(s, 'rejected') OR contains(s, 'failed') THEN 'failed' WHEN contains(s, 'queued') OR contains(s, 'running') THEN 'running' ELSE 'pending' END AS state, count(*) AS n FROM orders JOIN s ON true GROUP BY 1, 2, 3"""
)
def tier_states(spark, sf_dir):
    """P8. (Nine constant statuses stand beside every order.)"""
    statuses = F.array(*[F.lit(x.strip("()'")) for x in _STATES.split(", ")])
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("bucket"), F.explode(statuses).alias("s"))
    return o.groupBy("bucket", "s", console.tier_state(F.col("s")).alias("state")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_PROCESSED}, s AS (SELECT *, CASE WHEN gs = 'pending_tier_1' THEN ds ELSE gs END AS s FROM p)
    SELECT id, 'done,' || CASE WHEN coalesce(crawl, true) THEN 'done' ELSE 'rejected' END || ',' || CASE WHEN starts_with(s, 'excluded_') OR NOT coalesce(crawl, true) THEN 'skipped' ELSE 'done' END || ',' ||
    CASE WHEN starts_with(s, 'excluded_') THEN 'skipped' WHEN s = 'qualified_deterministic' THEN 'done' ELSE 'rejected' END || ',skipped,skipped,' || CASE WHEN s = 'qualified_deterministic' THEN 'done' ELSE 'skipped' END AS states FROM s"""
)
def lead_timeline(spark, sf_dir):
    """P9."""
    rows = process(leads_of(spark, sf_dir), Config())
    states = console.timeline(F.col("pipeline_status"), F.col("crawl_allowed"), F.col("is_qualified_lead"), F.lit("tier1_skipped"), F.lit(None).cast("string"))
    return rows.select("id", F.array_join(F.transform(states, lambda s: s["state"]), ",").alias("states"))


@query(f"WITH {LEADS} SELECT id, array_to_string(list_filter([CASE WHEN viewport THEN 'has_viewport' END, CASE WHEN form THEN 'has_form' END, CASE WHEN tel THEN 'has_tel_link' END], lambda x: x IS NOT NULL), ',') AS evidence, row_number() OVER (PARTITION BY run_id ORDER BY k) - 1 AS index FROM l")
def console_view(spark, sf_dir):
    """P10, P12, W4."""
    rows = leads_of(spark, sf_dir).withColumns({"created_at": -F.col("page_id"), "company_name": F.lit(""), "initial_url": F.lit(""), "target_location": F.lit(None).cast("string"), "pipeline_status": F.lit(""), "score": F.lit(0.0)})
    ev = rows.select(F.col("id").alias("e_id"), F.array_join(console.evidence(("has_viewport", "has_form", "has_tel_link")), ",").alias("evidence"))
    return console.view(rows).join(ev, F.col("id") == F.col("e_id")).select("id", "evidence", F.col("index").cast("long").alias("index"))


# Technologies.

_HTML_PATTERNS = [("Tracker Page", r"track\(\d+\)"), ("Middle Dot", "&middot;"), ("Fine Print", r"&copy; \w+"), ("Stars", r"\*\*\*")]


@query(" UNION ALL ".join(rf"SELECT page_id, '{n}' AS name, regexp_extract(html, '(?i){p}') AS matched_value FROM pages WHERE regexp_matches(html, '(?i){p}')" for n, p in _HTML_PATTERNS))
def sig_match(spark, sf_dir):
    """J1, X16, P7, as an equi-join by source with the pattern as the rest."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("lead"), F.lit("html").alias("source"), F.lit(None).cast("string").alias("qualifier"), F.lit("raw_html").alias("field"), F.col("html").alias("text"))
    rows = [(n, "t", "html", None, i, r, 100, None) for i, (n, r) in enumerate(_HTML_PATTERNS)]
    found = match.match_joined(p, spark.createDataFrame(rows, packs.PATTERN))
    return found.select(F.col("lead").cast("long").alias("page_id"), "name", "matched_value")


@query(" UNION ALL ".join(rf"SELECT page_id, '{n}' AS name, regexp_extract(html, '(?i){p}') AS matched_value FROM pages WHERE regexp_matches(html, '(?i){p}')" for n, p in _HTML_PATTERNS))
def sig_match_generated(spark, sf_dir):
    """J1 with an expression generated for each pattern."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("lead"), F.lit("html").alias("source"), F.lit(None).cast("string").alias("qualifier"), F.lit("raw_html").alias("field"), F.col("html").alias("text"))
    rows = [dict(name=n, pack="t", source="html", qualifier=None, idx=i, regex=r, confidence=100, version=None) for i, (n, r) in enumerate(_HTML_PATTERNS)]
    return match.match_generated(p, rows).select(F.col("lead").cast("long").alias("page_id"), "name", "matched_value")


@query(" UNION ALL ".join(rf"SELECT page_id, '{n}' AS name, regexp_extract(html, '(?i){p}') AS matched_value FROM pages WHERE regexp_matches(html, '(?i){p}')" for n, p in _HTML_PATTERNS))
def sig_match_sql(spark, sf_dir):
    """The matcher as a table function, called from SQL beside the pages."""
    rows = [dict(name=n, pack="t", source="html", qualifier=None, idx=i, regex=r, confidence=100, version=None) for i, (n, r) in enumerate(_HTML_PATTERNS)]
    match_sql.register(spark, rows, "match_html_signatures")
    return spark.sql("SELECT p.page_id, m.name, m.matched_value FROM {pages} p, LATERAL match_html_signatures('html', CAST(NULL AS STRING), p.html) m WHERE NOT m.failed", pages=table(spark, sf_dir, "pages"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 5000 AS n, o_orderkey % 10 AS minor FROM orders) SELECT id, 'T' || n AS name, CASE WHEN n % 3 = 1 THEN CAST(minor AS VARCHAR) END AS version,
    'REF-' || lpad(CAST(n AS VARCHAR), 4, '0') || CASE n % 3 WHEN 0 THEN '-x' WHEN 1 THEN '-x' || minor ELSE '' END AS matched_value FROM t WHERE n < 3000"""
)
def sig_prefilter(spark, sf_dir):
    """Three thousand patterns in Arrow batches, each tried only where its literals occur."""
    kinds = (lambda i: (f"ref-{i:04d}-x", None), lambda i: (rf"(?:ref|see)-{i:04d}-x(\d+)", "\\1"), lambda i: (rf"\b[rq]ef-{i:04d}\b", None))
    rows = [dict(zip(("regex", "version"), kinds[i % 3](i))) | {"name": f"T{i}", "pack": "t", "source": "text", "qualifier": None, "idx": 0, "confidence": 100} for i in range(3000)]
    k = F.col("o_orderkey")
    said = F.concat(F.lit("please see REF-"), F.lpad((k % 5000).cast("string"), 4, "0"), F.lit("-x"), (k % 10).cast("string"), F.lit(" of "), "o_orderpriority")
    stacks = table(spark, sf_dir, "orders").select(k.cast("string").alias("lead"), F.lit("text").alias("source"), F.lit(None).cast("string").alias("qualifier"), F.lit("text_content").alias("field"), said.alias("text"))
    return match.match_batched(stacks, rows).select(F.col("lead").cast("long").alias("id"), "name", "version", "matched_value")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leads with headers, cookies and meta lines made from their columns."""
    k = F.col("o_orderkey")
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    headers = F.array(
        header("Server", F.when(k % 3 == 0, F.lit("cloudflare")).otherwise("nginx/1.18")), header("Set-Cookie", F.concat(F.lit("_ga=GA"), k.cast("string"), F.lit("; Path=/"))),
        header("set-cookie", F.when(k % 2 == 0, F.lit("__CF_BM=1")).otherwise("__cf_bm=2; Secure")), header("X-Powered-By", F.concat(F.lit("PHP/7."), (k % 10).cast("string"))), header("Via", F.lit("1.1 proxybox/2")),
    )
    meta = F.array(F.concat(F.lit("generator=WordPress 6."), (k % 10).cast("string")), F.lit("Generator=Other"), F.lit("og:type=site"))
    # the table may be one file of one part; a lead's arrays are much work
    orders = table(spark, sf_dir, "orders").select(k).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return orders.select(k.cast("string").alias("id"), headers.alias("response_headers"), meta.alias("meta_lines"))


def _sig(spark: SparkSession, stacks: DataFrame, patterns: list[tuple]) -> DataFrame:
    rows = [dict(zip(("name", "source", "qualifier", "regex", "version"), p)) | {"pack": "t", "idx": i, "confidence": 100} for i, p in enumerate(patterns)]
    return match.match_generated(stacks, rows).select(F.col("lead").cast("long").alias("id"), "name", "version", "matched_value", "field")


@query(
    """SELECT o_orderkey AS id, 'Cloudflare' AS name, NULL AS version, 'cloudflare' AS matched_value, 'response_headers[server]' AS field FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'PHP', '7.' || o_orderkey % 10, 'PHP/7.' || o_orderkey % 10, 'response_headers[x-powered-by]' FROM orders UNION ALL SELECT o_orderkey, 'Any', NULL, 'Via: 1', 'response_headers[*]' FROM orders
    UNION ALL SELECT o_orderkey, 'Box', NULL, 'proxybox', 'dns_header[via]' FROM orders"""
)
def sig_headers(spark, sf_dir):
    """J2, J5, A5, X15."""
    stacks = match.header_haystacks(_requests(spark, sf_dir))
    return _sig(spark, stacks, [("Cloudflare", "headers", "SERVER", "cloudflare", None), ("PHP", "headers", "X-Powered-By", r"php/?([\d.]+)?", "\\1"), ("Any", "headers", None, r"via: \d", None), ("Box", "dns_header", "Via", "proxybox", None), ("No", "dns_header", "Location", ".*", None)])


@query(
    """SELECT o_orderkey AS id, 'Google Analytics' AS name, NULL AS version, 'GA' || o_orderkey AS matched_value, 'set_cookie[_ga]' AS field FROM orders
    UNION ALL SELECT o_orderkey, 'Cloudflare Bot Management', NULL, '2', 'set_cookie[__cf_bm]' FROM orders WHERE o_orderkey % 2 = 1"""
)
def sig_cookies(spark, sf_dir):
    """J3."""
    stacks = match.header_haystacks(_requests(spark, sf_dir))
    return _sig(spark, stacks, [("Google Analytics", "cookies", "_ga", "ga.*", None), ("Cloudflare Bot Management", "cookies", "__cf_bm", ".*", None)])


@query("SELECT o_orderkey AS id, 'WordPress' AS name, '6.' || o_orderkey % 10 AS version, 'WordPress 6.' || o_orderkey % 10 AS matched_value, 'meta[generator]' AS field FROM orders")
def sig_meta(spark, sf_dir):
    """J4."""
    return _sig(spark, match.meta_haystacks(_requests(spark, sf_dir)), [("WordPress", "meta", "generator", r"^WordPress ?([\d.]+)?", "\\1"), ("Not", "meta", "GENERATOR", ".*", None)])


_FOUND_ROWS = "n AS name"
FOUND = """f AS (SELECT l_orderkey AS lead, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS seq, 't' || (l_partkey % 12) AS name, CASE WHEN l_suppkey % 5 = 0 THEN 'b' ELSE 'a' END AS pack, l_partkey % 12 % 4 AS cat,
CAST(l_quantity AS INTEGER) * 2 AS confidence, CASE WHEN l_returnflag = 'R' THEN '1.0' END AS version, CASE WHEN l_linestatus = 'F' THEN 'headers' ELSE 'html' END AS source FROM lineitem)"""
EDGES = "('t1', 'excludes', 't2', NULL, 0), ('t2', 'excludes', 't1', NULL, 0), ('t3', 'excludes', 't9', NULL, 0), ('t4', 'requires', 't5', NULL, 0), ('t6', 'requires', 't4', NULL, 0), ('t6', 'requires', 't7', NULL, 1), ('t8', 'requires_category', NULL, 1, 0), ('t8', 'requires_category', NULL, 2, 1), ('t5', 'implies', 't0', NULL, 0), ('t10', 'implies', 't0', NULL, 0), ('t10', 'implies', 'x1', NULL, 1)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detections: an order is a lead."""
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lead"), seq.alias("seq"), F.concat(F.lit("t"), (F.col("l_partkey") % 12).cast("string")).alias("name"), F.when(F.col("l_suppkey") % 5 == 0, "b").otherwise("a").alias("pack"),
        F.array((F.col("l_partkey") % 12 % 4).cast("int")).alias("categories"), (F.col("l_quantity").cast("int") * 2).alias("confidence"), F.when(F.col("l_returnflag") == "R", "1.0").alias("version"),
        F.when(F.col("l_linestatus") == "F", "headers").otherwise("html").alias("source"), F.lit("p").alias("pattern_id"),
    )


def _edge(spark: SparkSession) -> DataFrame:
    return values(spark, EDGES, "name, kind, target, category, pos")


def _tech(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("t0", "z", [7])], "name string, pack string, categories array<int>")


_EXCL = f"WITH {FOUND}, e AS (SELECT * FROM (VALUES {EDGES}) t(name, kind, target, category, pos)), x AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g JOIN e ON g.name = e.name AND e.kind = 'excludes' WHERE g.lead = f.lead AND e.target = f.name))"


@query(f"{_EXCL} SELECT lead, name, count(*) AS n FROM x GROUP BY 1, 2")
def resolve_excludes(spark, sf_dir):
    """J6."""
    return resolve.excludes(_found(spark, sf_dir), _edge(spark)).groupBy("lead", "name").agg(F.count("*").alias("n"))


def _round(a: str, b: str) -> str:
    return f"""{b} AS (SELECT * FROM {a} WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.name = {a}.name AND e.kind = 'requires' AND NOT EXISTS (SELECT 1 FROM {a} g WHERE g.lead = {a}.lead AND g.name = e.target))
    AND (NOT EXISTS (SELECT 1 FROM e WHERE e.name = {a}.name AND e.kind = 'requires_category') OR EXISTS (SELECT 1 FROM e JOIN {a} g ON g.lead = {a}.lead AND g.cat = e.category WHERE e.name = {a}.name AND e.kind = 'requires_category')))"""


_REQ = _EXCL.replace("x AS (SELECT * FROM f WHERE", "x0 AS (SELECT * FROM f WHERE").replace("g.lead = f.lead AND e.target = f.name))", "false))") + ", " + ", ".join(_round(f"x{i}", f"x{i + 1}") for i in range(5))


@query(f"{_REQ} SELECT lead, name, count(*) AS n FROM x5 GROUP BY 1, 2")
def resolve_requires(spark, sf_dir):
    """J7, J8, A4."""
    return resolve.requires(_found(spark, sf_dir), _edge(spark)).groupBy("lead", "name").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FOUND}, e AS (SELECT * FROM (VALUES {EDGES}) t(name, kind, target, category, pos)), i AS (SELECT lead, target, f.pack, confidence, f.name AS parent, row_number() OVER (PARTITION BY lead, target ORDER BY seq, pos) AS n FROM f JOIN e USING (name)
    WHERE kind = 'implies' AND NOT EXISTS (SELECT 1 FROM f g WHERE g.lead = f.lead AND g.name = e.target)) SELECT lead, target AS name, CASE WHEN target = 't0' THEN 'z' ELSE pack END AS pack, least(confidence, 50) AS confidence, 'implied:' || parent || '->' || target AS pattern_id FROM i WHERE n = 1"""
)
def resolve_implies(spark, sf_dir):
    """The rows that are added."""
    return resolve.implies(_found(spark, sf_dir), _edge(spark), _tech(spark)).where("source = 'implied'").select("lead", "name", "pack", "confidence", "pattern_id")


@query(f"WITH {FOUND}, o AS (SELECT *, row_number() OVER (PARTITION BY lead, name, pack ORDER BY confidence DESC, version IS NULL, seq) AS n FROM f) SELECT lead, name, pack, seq, confidence, version FROM o WHERE n = 1")
def dedup_best(spark, sf_dir):
    """A2, W5."""
    return resolve.best(_found(spark, sf_dir)).select("lead", "name", "pack", "seq", "confidence", "version")


_RULES = [(0, "t1", "a", ["headers"], 30, False), (1, "t1", "a", ["headers", "html"], 40, True), (2, "t3", "b", ["html"], 20, True)]
_CAP = "CASE WHEN name = 't1' AND pack = 'a' AND source = 'headers' THEN 30 WHEN name = 't1' AND pack = 'a' THEN 40 WHEN name = 't3' AND pack = 'b' AND source = 'html' THEN 20 END"
_NEEDS = "((name = 't1' AND pack = 'a' AND source = 'html') OR (name = 't3' AND pack = 'b' AND source = 'html'))"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "ord int, name string, pack string, sources array<string>, cap int, corroborate boolean")


@query(f"WITH {FOUND} SELECT lead, seq, name FROM f WHERE NOT ((name = 't1' AND pack = 'b') OR (name = 't5' AND pack = 'a'))")
def blocklist_suppress(spark, sf_dir):
    """J10."""
    return resolve.suppress(_found(spark, sf_dir), spark.createDataFrame([("t1", "b"), ("t5", "a")], "name string, pack string")).select("lead", "seq", "name")


@query(f"WITH {FOUND} SELECT lead, seq, name, least(confidence, coalesce({_CAP}, confidence)) AS confidence, {_NEEDS} AS needs_other FROM f")
def blocklist_downgrade(spark, sf_dir):
    """J11."""
    return resolve.downgrade(_found(spark, sf_dir), _rules(spark)).select("lead", "seq", "name", "confidence", "needs_other")


@query(f"WITH {FOUND}, c AS (SELECT *, count(DISTINCT name) OVER (PARTITION BY lead) AS names FROM f) SELECT lead, seq, name FROM c WHERE names > 1 OR NOT ({_NEEDS} OR name IN ('t2', 't8'))")
def blocklist_corroborate(spark, sf_dir):
    """J12, U5."""
    names = spark.createDataFrame([("t2",), ("t8",)], "name string")
    return resolve.corroborate(resolve.downgrade(_found(spark, sf_dir), _rules(spark)), names).select("lead", "seq", "name")


@query()
def match_leads(spark, sf_dir):
    """The matcher from pages to resolved detections, with the own pack and blocklist."""
    rows = leads_of(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("raw_html")), "page_id")
    rows = rows.withColumns({"text_content": html.visible_text("raw_html"), "response_headers": F.expr("array(named_struct('key', 'Via', 'value', 'proxybox/1.2'))"), "meta_lines": F.array(F.lit("generator=WordPress 6.1")), "robots_txt": F.struct(F.lit(True).alias("exists"), F.lit("Sitemap: x").alias("body"))})
    return resolve.nested(match.match_leads(rows, packs.default_pack(), packs.blocklist()))


# Packs.


@query("WITH e AS (SELECT p_brand AS file, p_size % 20 AS category FROM part) SELECT file, count(*) AS n_in, count(*) FILTER (WHERE category IN (1, 6, 11)) AS n_out FROM e GROUP BY ROLLUP (file)")
def pack_stats(spark, sf_dir):
    """A11, A12, S21, J15, U6."""
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("name"), F.array(F.col("p_size") % 20).alias("cats"))
    keep = spark.createDataFrame([(1,), (6,), (11,)], "category int")
    return packs.retention(e, packs.filter_entries(e, keep))


@query("SELECT * FROM (VALUES (1), (6), (77), (99)) t(category) EXCEPT SELECT DISTINCT p_size % 20 FROM part")
def pack_except(spark, sf_dir):
    """U4."""
    keep = spark.createDataFrame([(1,), (6,), (77,), (99,)], "category int")
    return packs.unknown_categories(keep, table(spark, sf_dir, "part").select((F.col("p_size") % 20).alias("category")))


# Beyond parity.


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def ext_hourly_events(spark, sf_dir):
    """Tumbling windows over events; beyond the reference's own operators."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")
