"""Queries over encoded pages, leads on the wire and landed, the fixed lists, the search source and run states, each with its SQL."""

from __future__ import annotations

import contextlib
import time

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.functions import dom, html, text, urls
from siteprism.plans.queries import LEADS, leads_of, query, table
from siteprism.plans.read_queries import _pages_stream, _stored_stream
from siteprism.sources import leads as landed
from siteprism.sources import pack_rows, search, wire
from siteprism.sources.shared import fresh_path
from siteprism.streaming import calls, states

_PIECES = r"""s AS (SELECT page_id, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages)"""
_COUNT = "CAST(len(regexp_extract_all({c}, '{p}')) AS INTEGER)"


@query(
    f"""WITH {_PIECES} SELECT page_id, {_COUNT.format(c='nav', p='<li>')} AS nav_items, {_COUNT.format(c='nav', p='<a href=')} AS nav_links, {_COUNT.format(c='article', p='<p>')} AS paragraphs, {_COUNT.format(c='article', p='<b>')} AS bold,
    {_COUNT.format(c='html', p='<footer>')} AS footers, {_COUNT.format(c='html', p='class="ad"')} AS ads, contains(html, '<html lang="en">') AS english, {_COUNT.format(c='html', p='<h1>')} + {_COUNT.format(c='html', p='<title>')} AS titles FROM s"""
)
def dom_select(spark, sf_dir):
    """Selectors over every page's nodes: how many elements each means."""
    rows = dom.with_nodes(table(spark, sf_dir, "pages").select("page_id", "html"))
    n = lambda selector: F.size(dom.select(F.col("nodes"), selector))
    return rows.select(
        "page_id", n("nav > ul > li").alias("nav_items"), n("nav li a[href]").alias("nav_links"), n("article p").alias("paragraphs"), n("body article p b").alias("bold"), n("footer").alias("footers"),
        n("div.ad").alias("ads"), (n('html[lang="en"]') > 0).alias("english"), n("article > h1, head title").alias("titles"),
    )


def _named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, whose heads and bodies name a company on another rung of the ladder by page_id."""
    k = F.col("page_id")
    n = (k % 100).cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = (
        F.when(k % 6 == 0, c('<meta property="og:site_name" content="  North&amp;Co\n Works ', n, ' ">')).when(k % 6 == 1, c('<meta property="og:site_name" content="Home"><meta name="application-name" content="Blue App ', n, '">'))
        .when(k % 6 == 4, c('<meta name="application-name" content="404 | x">')).otherwise(F.lit(""))
    )
    body = (
        F.when(k % 6 == 2, c('<img alt="Acme Logo"><img alt="Hi"><img alt="Gable Roofing ', n, '"><h1>Other name</h1>')).when(k % 6 == 3, c("<h1><span>Stone</span> &amp; <i>Sons</i> ", n, "</h1>"))
        .when(k % 6 >= 4, F.lit("<h1>ab</h1>")).otherwise(F.lit(""))
    )
    title = F.when(k % 6 == 4, c("<title>Corner Bakery ", n, " | Fresh | Daily</title>")).when(k % 6 == 5, F.lit("<title>Welcome | x</title>")).otherwise(F.lit(""))
    page = F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), title, head))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(page, F.lit("<body>"), F.concat(F.lit("<body>"), body)).alias("html"))


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'North&Co Works ' || page_id % 100 WHEN 1 THEN 'Blue App ' || page_id % 100 WHEN 2 THEN 'Gable Roofing ' || page_id % 100
    WHEN 3 THEN 'Stone & Sons ' || page_id % 100 WHEN 4 THEN 'Corner Bakery ' || page_id % 100 ELSE '' END AS company FROM pages"""
)
def dom_company(spark, sf_dir):
    """H8: every rung of the ladder, by selectors over the page's nodes."""
    return dom.with_nodes(_named_pages(spark, sf_dir)).select("page_id", dom.company_name(F.col("nodes")).alias("company"))


_PLACES = (
    ("<address>12 Main</address><address>{k} Main<br>Street</address><footer>1 Low Road</footer>", "{k} Main Street"), ("<footer>9 Oak Ave, copyright</footer><div class=\"x contact y\">{k} Oak Avenue,\n Portland, OR 97201</div>", "{k} Oak Avenue, Portland, OR 97201"),
    ("<p itemprop='address'>{k} <b>Pine</b> Rd</p>", "{k} Pine Rd"), ("<div class=\"location\">1 Low Road</div><div id=\"contact\">{k} Elm Court</div>", "{k} Elm Court"), ("<div class=\"address\">no street</div>", ""),
    ("<div id=\"footer\">{k} Hill Drive</div>", "{k} Hill Drive"), ("<div class=\"contact-us\"><p>{k}</p><p>Bay Lane</p></div>", "{k} Bay Lane"), ("<div class=\"locations\">call us, {k} Sea Way</div><i class=\"address\">{k} Sea Way</i>", "{k} Sea Way"),
)


@query("SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN replace('{told}', '{{k}}', CAST(page_id % 1000 AS VARCHAR))" for i, (_, told) in enumerate(_PLACES)) + " END AS address FROM pages")
def dom_address(spark, sf_dir):
    """The eleven places in their order, whatever their order on the page."""
    k = F.col("page_id")
    added = F.replace(F.element_at(F.array(*[F.lit(markup) for markup, _ in _PLACES]), (k % 8 + 1).cast("int")), F.lit("{k}"), (k % 1000).cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<article>"), F.concat(added, F.lit("<article>"))).alias("html"))
    return dom.with_nodes(pages).select("page_id", dom.address(F.col("nodes")).alias("address"))


_ADDED = (
    "<meta name=\"description\" content=\" all  of {k} \"><meta http-equiv=\"refresh\"><meta name=\"\" property=\"og:x\" content=\"y\"><meta name=\"viewport\" content=\"w\">"
    "<script type=\"application/ld+json\">{broken</script><script type=\"application/ld+json\">[3, {\"@type\": 4}, {\"@type\": \"Type{k}\"}]</script><script src=\"/s{k}.js\"></script>"
    "<link rel=\"stylesheet\" href=\"//cdn.example/c{k}.css\"><link rel=\"manifest\" href=\"/m{k}.json\"><link rel=\"manifest\" href=\"/other.json\">"
)
_SIGNED = "page_id % 3 = 0"
_ORIGIN = "lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1))"


@query(
    f"""SELECT page_id, CASE WHEN {_SIGNED} THEN 'all of ' || page_id ELSE '' END AS description, CASE WHEN {_SIGNED} THEN 'Type' || page_id ELSE '' END AS kind, {_SIGNED} AS viewport, {_SIGNED} AS form,
    CASE WHEN {_SIGNED} THEN {_ORIGIN} || '/s' || page_id || '.js' END AS script, CASE WHEN {_SIGNED} THEN lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://cdn.example/c' || page_id || '.css' END AS style,
    CASE WHEN {_SIGNED} THEN {_ORIGIN} || '/m' || page_id || '.json' ELSE '' END AS manifest, CASE WHEN {_SIGNED} THEN 'description= all  of ' || page_id || ' ;refresh=;og:x=y;viewport=w' ELSE '' END AS meta,
    CASE WHEN {_SIGNED} THEN 'https://www.facebook.com/' || page_id ELSE '' END AS facebook, CASE WHEN page_id % 3 = 1 THEN 'https://linkedin.com/in/x' ELSE '' END AS linkedin, page_id % 3 = 1 AS contact,
    CAST(len(regexp_extract_all(html, '<a href=')) + CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS anchors FROM pages"""
)
def dom_signals(spark, sf_dir):
    """What the head and the links of a page tell, by selectors."""
    k = F.col("page_id")
    head = F.when(k % 3 == 0, F.replace(F.lit(_ADDED), F.lit("{k}"), k.cast("string"))).otherwise(F.lit(""))
    social = F.concat(F.lit('<form></form><a href="https://www.facebook.com/'), k.cast("string"), F.lit('">F</a><a href="https://www.facebook.com/second">G</a>'))
    body = F.when(k % 3 == 0, social).when(k % 3 == 1, F.lit('<a href="https://linkedin.com/in/x">L</a><a href="/us">How to CONTACT us</a>')).otherwise(F.lit(""))
    page = F.replace(F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))), F.lit("<body>"), F.concat(F.lit("<body>"), body))
    got = dom.signals(table(spark, sf_dir, "pages").select("page_id", "url", page.alias("html")))
    first = lambda c: F.try_element_at(c, F.lit(1))["url"]
    lines = F.filter("meta_lines", lambda m: ~m.startswith("charset"))
    return got.select(
        "page_id", F.col("meta_description").alias("description"), F.col("schema_org_business_type").alias("kind"), F.col("has_viewport").alias("viewport"), F.col("has_form").alias("form"), first("script_srcs").alias("script"),
        first("stylesheet_hrefs").alias("style"), F.col("manifest_url").alias("manifest"), F.array_join(lines, ";").alias("meta"), F.col("social_facebook").alias("facebook"), F.col("social_linkedin").alias("linkedin"),
        F.col("has_contact_page").alias("contact"), F.size("anchor_hrefs").alias("anchors"),
    )


# Leads on the wire and landed.


@query(
    """SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN CAST(page_id AS VARCHAR) END AS id, CASE WHEN page_id % 7 <> 3 THEN url END AS final_url, CASE WHEN page_id % 7 <> 3 THEN CAST(page_id - 40 AS INTEGER) END AS words,
    CASE WHEN page_id % 7 <> 3 THEN page_id % 3 = 0 END AS has_form, CASE WHEN page_id % 7 <> 3 THEN CAST(page_id % 4 AS INTEGER) END AS links, CASE WHEN page_id % 7 <> 3 THEN md5(html) END AS html_md5,
    CASE WHEN page_id % 7 <> 3 THEN CAST(page_id / 8 AS FLOAT) END AS sure, CASE WHEN page_id % 7 <> 3 AND page_id % 2 = 0 THEN 'User-agent: ' || page_id END AS robots, page_id % 7 = 3 AS refused FROM pages"""
)
def wire_leads(spark, sf_dir):
    """Each page as a lead in a batch of one, encoded, every seventh cut off, and decoded; what is cut off is refused alone."""
    k = F.col("page_id")
    link = F.struct(F.col("url"), (k % 2 == 0).alias("is_internal"), F.lit("é").alias("label"))
    robots = F.struct(F.lit("/robots.txt").alias("path"), F.lit(200).alias("http_status"), F.lit(True).alias("exists"), F.lit("text/plain").alias("content_type"), F.concat(F.lit("User-agent: "), k.cast("string")).alias("body"))
    own = {
        "id": k.cast("string"), "final_url": F.col("url"), "word_count": (k - 40).cast("int"), "has_form": k % 3 == 0, "anchor_hrefs": F.array_repeat(link, (k % 4).cast("int")), "raw_html": F.col("html"),
        "location_confidence": (k / 8).cast("float"), "robots_txt": F.when(k % 2 == 0, robots),
    }
    kinds = wire.raw_lead()
    lead = F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    sent = wire.encoded(table(spark, sf_dir, "pages").select("page_id", F.struct(F.array(lead).alias("leads")).alias("record")))
    cut = sent.withColumn("value", F.when(k % 7 == 3, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")))
    got = wire.decoded(cut, wire.lead_batch()).select("page_id", F.get("record.leads", F.lit(0)).alias("l"), F.col("error").isNotNull().alias("refused"))
    return got.select(
        "page_id", "l.id", "l.final_url", F.col("l.word_count").alias("words"), "l.has_form", F.when(F.col("l").isNotNull(), F.size("l.anchor_hrefs")).alias("links"), F.md5("l.raw_html").alias("html_md5"),
        F.col("l.location_confidence").alias("sure"), F.col("l.robots_txt.body").alias("robots"), "refused",
    )


@query(
    f"""WITH {LEADS} SELECT id, run_id, CAST(words AS INTEGER) AS word_count, viewport AS has_viewport, crawl AS crawl_allowed, CASE WHEN k % 3 = 0 THEN '{{"source":"' || id || '"}}' ELSE '{{}}' END AS provider_provenance,
    k / 4 AS location_confidence, CAST(CASE WHEN k % 4 IN (0, 1) THEN 1 ELSE 0 END AS INTEGER) AS links, '' AS company_name FROM l"""
)
def landed_leads(spark, sf_dir):
    """Leads landed as batches of one, streamed with the wire's defaults, stored batch by batch, and read back as stored records."""
    k = F.col("page_id")
    rows = leads_of(spark, sf_dir).withColumns(
        {"provider_provenance_json": F.when(k % 3 == 0, F.to_json(F.struct(F.col("id").alias("source")))).when(k % 3 == 1, "[broken"), "location_confidence": (k / 4).cast("float"), "category_confidence": F.lit(0).cast("float")}
    )
    at = fresh_path(spark, "landed")
    landed.write_landed(rows.select(*[c for c in wire.LEAD_FIELDS if c in rows.columns]), at)
    back = landed.stored(_stored_stream(spark, landed.stream_landed(spark, at)))
    return back.select("id", "run_id", "word_count", "has_viewport", "crawl_allowed", "provider_provenance", "location_confidence", F.size("anchor_hrefs").alias("links"), "company_name")


@query("SELECT page_id, CAST(length(html) AS INTEGER) AS size, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS anchors, regexp_matches(html, '<form[ >]') AS has_form, md5(html) AS html_md5 FROM pages")
def landed_html(spark, sf_dir):
    """Pages landed as a file each, read as whole files and parsed."""
    groups = landed.write_html(table(spark, sf_dir, "pages").select("page_id", "html"), fresh_path(spark, "html"))
    page = F.expr("left(raw_html, length(raw_html) - 1)")  # the writer ends each file's line
    page_id = F.regexp_extract("id", r"page_id=(-?\d+)", 1).try_cast("long").alias("page_id")
    return landed.read_html(spark, groups, lambda leads: leads.select(page_id, F.length(page).alias("size"), F.size("anchor_hrefs").alias("anchors"), "has_form", F.md5(page).alias("html_md5")))


@query("""SELECT '{"event_id":' || event_id || ',"kind":"' || event_type || '","odd":' || CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"note":"\\"n' || event_id % 3 || '\\""' END || '}' AS value FROM events""")
def json_lines(spark, sf_dir):
    """A JSON text for each row, quotes escaped, nulls left out."""
    k = F.col("event_id")
    note = F.when(k % 3 != 0, F.concat(F.lit('"n'), (k % 3).cast("string"), F.lit('"')))
    return landed.to_json_lines(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), (k % 2 == 1).alias("odd"), note.alias("note")))


# The fixed lists, with hits on every entry.

_HOSTS, _PATHS = urls.DENIED_HOSTS, urls.DENIED_PATHS
_LISTED = "[" + ", ".join(f"'{h}'" for h in _HOSTS) + "]"


@query(
    f"""WITH u AS (SELECT c_custkey, CAST(c_custkey // 4 % {len(_HOSTS)} AS INTEGER) AS i, c_custkey % 4 AS kind, CAST(c_custkey // 3 % {len(_PATHS)} AS INTEGER) AS j, c_custkey % 3 AS tail FROM customer)
    SELECT c_custkey, kind IN (0, 1) AS host_denied, tail < 2 AS path_denied,
    CASE WHEN kind > 1 AND tail = 2 THEN 'https://' || CASE kind WHEN 2 THEN 'not' || {_LISTED}[i + 1] ELSE {_LISTED}[i + 1] || '.example' END || [{', '.join(f"'{p}'" for p in _PATHS)}][j + 1] || '-x' END AS site FROM u"""
)
def fixed_lists(spark, sf_dir):
    """Every host and path of the fixed lists: itself, below it, and what only looks like it."""
    k = F.col("c_custkey")
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (F.expr(f"c_custkey div {by}") % len(items) + 1).cast("int"))
    h, p = pick(_HOSTS, 4), pick(_PATHS, 3)
    named = F.when(k % 4 == 0, F.concat(F.lit("WWW."), F.upper(h))).when(k % 4 == 1, F.concat(F.lit("shop."), h)).when(k % 4 == 2, F.concat(F.lit("not"), h)).otherwise(F.concat(h, F.lit(".example")))
    path = F.when(k % 3 == 0, F.upper(p)).when(k % 3 == 1, F.concat(p, F.lit("/x"))).otherwise(F.concat(p, F.lit("-x")))
    u = F.concat(F.lit("https://"), named, path)
    return table(spark, sf_dir, "customer").select("c_custkey", urls.host_denied(urls.host(u)).alias("host_denied"), urls.path_denied(urls.path(u)).alias("path_denied"), urls.site_url(u).alias("site"))


_WORDS = tuple(w for _, words in text.CATEGORIES for w in words)
_TOKENS = (*urls.LINK_DENIED, *(t for _, tokens in urls.LINK_SCORES for t in tokens), "plain")
_SAID = "(SELECT c_custkey, 'we do ' || [" + ", ".join(f"'{w}'" for w in _WORDS) + f"][c_custkey % {len(_WORDS)} + 1] || ' and more' AS t, [" + ", ".join(f"'{t}'" for t in _TOKENS) + f"][c_custkey % {len(_TOKENS)} + 1] AS a, [" + ", ".join(f"'{t}'" for t in _TOKENS) + f"][c_custkey // 7 % {len(_TOKENS)} + 1] AS b FROM customer)"
_HELD = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_LINK = "'/' || a || ' ' || b"


@query(
    f"""SELECT c_custkey, CASE {' '.join(f"WHEN {_HELD('t', words)} THEN '{name}'" for name, words in text.CATEGORIES)} ELSE '' END AS category,
    CASE WHEN {_HELD(_LINK, urls.LINK_DENIED)} THEN -1 ELSE {' + '.join(f"CASE WHEN {_HELD(_LINK, tokens)} THEN {points} ELSE 0 END" for points, tokens in urls.LINK_SCORES)} END AS score FROM {_SAID}"""
)
def fixed_words(spark, sf_dir):
    """Every category's keywords, and every pair of two tokens that make or mar a link."""
    k = F.col("c_custkey")
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (F.expr(f"c_custkey div {by}") % len(items) + 1).cast("int"))
    said = F.concat(F.lit("We do "), F.upper(pick(_WORDS, 1)), F.lit(" and more"))
    score = urls.link_score(F.concat(F.lit("/"), pick(_TOKENS, 1)), pick(_TOKENS, 7))
    return table(spark, sf_dir, "customer").select(k, text.category(said).alias("category"), score.alias("score"))


# The search source, and states of runs.


@query("SELECT CAST(page_id // 100 AS VARCHAR) AS run, CAST(page_id % 100 // 20 AS INTEGER) AS page, CAST(page_id % 20 AS INTEGER) AS pos, url, 'Title ' || page_id AS title FROM pages WHERE page_id // 100 % 3 = 0 OR page_id % 100 // 20 < 2")
def search_source(spark, sf_dir):
    """Landed result pages (twenty to a page, five to a run) read by the data source; of three runs one is read whole, one up to an empty page, one up to a page that says there are no more."""
    k = F.col("page_id")
    run, page = F.expr("page_id div 100"), F.expr("page_id % 100 div 20")
    result = F.struct((k % 20).alias("pos"), F.struct(F.concat(F.lit(" "), "url", F.lit("\t")).alias("url"), F.concat(F.lit("Title "), k.cast("string")).alias("title")).alias("r"))
    pages = table(spark, sf_dir, "pages").select(run.alias("run"), page.alias("page"), result.alias("result")).groupBy("run", "page").agg(F.transform(F.array_sort(F.collect_list("result")), lambda x: x["r"]).alias("results"))
    empty = (F.col("run") % 3 == 1) & (F.col("page") == 2)
    more = ~((F.col("run") % 3 == 2) & (F.col("page") == 1))
    results = F.when(empty, F.slice("results", 1, 0)).otherwise(F.col("results"))
    body = F.to_json(F.struct(F.struct(results.alias("results")).alias("web"), F.struct(more.alias("more_results_available")).alias("query")))
    at = fresh_path(spark, "search")
    pages.select("run", "page", body.alias("value")).write.partitionBy("run", "page").text(at)
    search.register(spark)
    return spark.read.format("site_search").option("path", at).option("query", "hvac in Portland").option("limit", 100).option("pages", 5).load().select("run", "page", "pos", "url", "title")


@query("SELECT 'whole' AS run_id, 'completed' AS status, count(*) AS rows FROM pages UNION ALL SELECT 'broken', 'failed', 0")
def stream_run_states(spark, sf_dir):
    """The pages as a stream that ends and one whose first batch fails, and what the listener wrote of both."""
    at = fresh_path(spark, "runs")
    listener = states.RunStates(spark, f"{at}/states")
    spark.streams.addListener(listener)

    def broken(batch: DataFrame, n: int) -> None:
        raise ValueError(f"batch {n} is not taken")

    try:
        for name, take in (("whole", lambda batch, n: batch.write.format("noop").mode("overwrite").save()), ("broken", broken)):
            rows = _pages_stream(spark, sf_dir).select("page_id")
            stream = rows.writeStream.queryName(name).foreachBatch(take).option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start()
            with contextlib.suppress(StreamingQueryException):
                stream.awaitTermination()
        for _ in range(120):  # listeners are told a little later
            with contextlib.suppress(AnalysisException):  # nothing is written yet
                if states.recorded(spark, f"{at}/states").where("state <> 'running'").count() == 2:
                    break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    return states.states(states.recorded(spark, f"{at}/states")).select("run_id", "status", "rows")


@query(
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'dead_letter' ELSE 'done' END AS status, CASE WHEN page_id % 7 = 0 THEN 5 WHEN page_id % 5 = 0 THEN 3 WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS attempt,
    CASE WHEN page_id % 7 <> 0 THEN 'reply ' || page_id END AS reply FROM pages"""
)
def stream_limited_calls(spark, sf_dir):
    """The pages as a queue of calls whose replies have landed: some come at a later attempt, some never; timers try them again as the clock moves."""
    k = F.col("page_id")
    reply = F.to_json(F.struct(F.concat(F.lit("reply "), k.cast("string")).alias("text")))
    at_attempt = F.when(k % 7 == 0, 99).when(k % 5 == 0, 3).when(k % 3 == 0, 2).otherwise(1)
    replies = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i == at_attempt, reply))
    clock = lambda second: F.timestamp_seconds(F.lit(1_700_000_000 + second))
    at = fresh_path(spark, "calls")
    table(spark, sf_dir, "pages").select(k.cast("string").alias("id"), F.struct(replies.alias("replies")).alias("context"), clock(0).alias("at")).coalesce(1).write.parquet(f"{at}/queue/0")
    for i, second in enumerate((30, 60, 120, 240, 480, 960), 1):  # what comes later moves the clock
        spark.range(1).select(F.lit(f"later {i}").alias("id"), F.struct(F.array(F.lit("{}")).alias("replies")).alias("context"), clock(second).alias("at")).write.parquet(f"{at}/queue/{i}")
    before = spark.conf.get(calls.PROVIDER[0])
    spark.conf.set(*calls.PROVIDER)
    try:
        queue = spark.readStream.schema("id string, context struct<replies:array<string>>, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{at}/queue/*")
        done = calls.limited_calls(queue, calls.replayed, shares=4, rate=1e9)
        done.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(calls.PROVIDER[0], before)
    got = spark.read.schema(calls.RESULT).parquet(f"{at}/out").where("id not like 'later%'")
    return got.select(F.col("id").cast("long").alias("page_id"), "status", "attempt", F.get_json_object("output", "$.text").alias("reply"))


# Packs that are tables.

_ENTRIES = "e AS (SELECT p_partkey AS k, p_partkey // 2 AS n, CASE WHEN p_partkey % 2 = 1 THEN 'two' ELSE 'one' END AS pack, p_partkey % 5 AS kind FROM part), c AS (SELECT * FROM e WHERE kind IN (0, 1, 3) QUALIFY row_number() OVER (PARTITION BY n ORDER BY pack DESC) = 1)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the entries of two packs, two to a name; of five one has a broken pattern, one none that counts here, and one is no JSON."""
    k = F.col("p_partkey")
    n = k.cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    entry = (
        F.when(k % 5 == 0, c('{"cats":[1],"html":["p', n, '","(bad"],"headers":{"X-', n, '":"","Y":4}}')).when(k % 5 == 1, c('{"scriptSrc":"s', n, r"\\;version:\\1\\;confidence:50", '"}')).when(k % 5 == 2, F.lit('{"js":{"a":"b"}}'))
        .when(k % 5 == 3, c('{"text":"t', n, r"\\;confidence:500", '","meta":{"gen":"m', n, r'\\;confidence:x"}}')).otherwise(F.lit("{"))
    )
    return table(spark, sf_dir, "part").select((k % 2).alias("ord"), F.when(k % 2 == 1, "two").otherwise("one").alias("pack"), F.concat(F.lit("T"), F.expr("p_partkey div 2").cast("string")).alias("name"), entry.alias("entry"))


@query(
    f"""WITH {_ENTRIES} SELECT 'T' || n AS name, pack, 'html' AS source, NULL AS qualifier, 0 AS idx, 'p' || k AS regex, 100 AS confidence, NULL AS version FROM c WHERE kind = 0
    UNION ALL SELECT 'T' || n, pack, 'headers', 'X-' || k, 1, '.*', 100, NULL FROM c WHERE kind = 0 UNION ALL SELECT 'T' || n, pack, 'script_src', NULL, 0, 's' || k, 50, '\\1' FROM c WHERE kind = 1
    UNION ALL SELECT 'T' || n, pack, 'text', NULL, 0, 't' || k, 100, NULL FROM c WHERE kind = 3 UNION ALL SELECT 'T' || n, pack, 'meta', 'gen', 1, 'm' || k, 100, NULL FROM c WHERE kind = 3"""
)
def pack_patterns(spark, sf_dir):
    """Entries of two packs as rows to patterns; of a name those of the last pack that has a usable one."""
    found = pack_rows.patterns(pack_rows.overridden(_entries(spark, sf_dir)))
    return found.where("not invalid").drop("invalid").select("name", "pack", "source", "qualifier", "idx", "regex", "confidence", "version")


@query(f"WITH {_ENTRIES} SELECT pack, count(*) AS total, count(*) FILTER (WHERE kind IN (0, 1, 3)) AS loaded, count(*) FILTER (WHERE kind = 2) AS empty, 2 * count(*) FILTER (WHERE kind IN (0, 3)) + count(*) FILTER (WHERE kind = 1) AS patterns, count(*) FILTER (WHERE kind = 0) AS invalid FROM e GROUP BY pack")
def pack_counts(spark, sf_dir):
    """What loading each pack came to."""
    return pack_rows.stats(_entries(spark, sf_dir))


@query("""SELECT p_partkey, 'script_src' AS source, 0 AS idx, '/([0-9][0-9.a-z_\\-]+)/lib' || p_partkey || '\\.js' AS regex, '\\1' AS version FROM part UNION ALL SELECT p_partkey, 'html', 1, 'Lib v([0-9][0-9.a-z_\\-]+)', '\\1' FROM part WHERE p_partkey % 2 = 0""")
def library_patterns(spark, sf_dir):
    """Entries of vulnerable libraries as rows to patterns with versions."""
    k = F.col("p_partkey")
    uri = F.array(F.concat(F.lit("/§§version§§/lib"), k.cast("string"), F.lit("\\.js")))
    entry = F.to_json(F.struct(F.struct(uri.alias("uri"), F.when(k % 2 == 0, F.array(F.lit("Lib v§§version§§"))).alias("filecontent"), F.array(F.lit("f()")).alias("func")).alias("extractors")))
    rows = table(spark, sf_dir, "part").select(F.lit("retirejs").alias("pack"), k.cast("string").alias("name"), pack_rows.library_entry(entry).alias("entry"))
    return pack_rows.patterns(rows).select(F.col("name").cast("long").alias("p_partkey"), "source", "idx", "regex", "version")


# Fields of a lead that a text or a URL tells.

_ADDRESSES = (("{k} Main Street", True), ("Suite {k}, Oak avenue", True), ("Portland, OR 97201-{k}", True), ("Street of none", False), ("{k} Elm Road. All rights reserved", False), ("call us at {k} Low Lane", False), ("", False))


@query(
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 2000 + c_custkey % 100 WHEN 1 THEN 2000 + c_custkey % 100 WHEN 2 THEN 2000 + c_custkey % 100 ELSE 0 END AS year, c_custkey % 7 IN (0, 1, 2) AS postal, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'https://final.example/Portland/' || c_custkey WHEN c_custkey % 3 = 1 THEN 'https://source.example/' || c_custkey ELSE '' END AS picked, "
    "CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 3 THEN 0.8 ELSE 0.0 END::DOUBLE AS place_sure, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE 0.65 END::DOUBLE AS category_sure FROM customer"
)
def lead_fields(spark, sf_dir):
    """Copyright years, postal addresses, the URL that counts, and how sure place and category are."""
    k = F.col("c_custkey")
    n = k.cast("string")
    year = F.lpad((k % 100).cast("string"), 2, "0")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    notice = F.when(k % 5 == 0, c("x © 20", year, " Acme, © 2001")).when(k % 5 == 1, c("COPYRIGHT20", year)).when(k % 5 == 2, c("copyright\n 20", year, "-2030")).when(k % 5 == 3, F.lit("(c) 2019 © 1999"))
    place = F.replace(F.element_at(F.array(*[F.lit(a) for a, _ in _ADDRESSES]), (k % 7 + 1).cast("int")), F.lit("{k}"), F.lpad((k % 10000).cast("string"), 4, "0"))
    final, source = F.when(k % 3 == 0, c("https://final.example/Portland/", n)).when(k % 3 == 1, F.lit("")), F.when(k % 3 == 1, c("https://source.example/", n))
    sure = html.confidences(urls.pick_url(final, source), F.when(k % 4 == 3, "").otherwise("PORTLAND"), F.when(k % 2 == 0, "").otherwise("hvac"))
    return table(spark, sf_dir, "customer").select(k, text.copyright_year(notice).alias("year"), text.postal_address(place).alias("postal"), urls.pick_url(final, source).alias("picked"), sure[0].alias("place_sure"), sure[1].alias("category_sure"))
