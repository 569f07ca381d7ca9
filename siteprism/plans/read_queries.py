"""Further queries: the read API, run states, packs, technologies in the write path, and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.config import Config
from siteprism.functions import html, urls
from siteprism.operators import discovery, match, tiers, warehouse
from siteprism.plans.pipeline import process
from siteprism.plans.queries import _PROCESSED, HOST, leads_from_pages, leads_of, query, table
from siteprism.sources import leads as landed
from siteprism.sources import packs
from siteprism.sources.shared import shared_dir
from siteprism.streaming import stream

#: The stored leads in SQL: ids, the final status, and a creation time that many share.
_STORED = f"""{_PROCESSED}, st AS (SELECT p.*, page_url, TIMESTAMP '2026-01-01' + to_hours(CAST(k % 50 AS INTEGER)) AS created_at, 'Company ' || k % 20 AS company,
CASE WHEN gs = 'pending_tier_1' THEN ds ELSE gs END AS status, CASE WHEN gs = 'pending_tier_1' AND ds NOT LIKE 'excluded%' AND ds <> 'rejected_parked_domain' THEN round(least(1.0::DOUBLE, 0.35::DOUBLE + 0.12::DOUBLE * len(miss) + 0.10::DOUBLE * len(outd)), 4) ELSE 0.0::DOUBLE END AS score
FROM p JOIN (SELECT page_id, CASE WHEN page_id % 37 = 0 THEN 'https://www.yelp.com/biz/x' ELSE url END AS page_url FROM pages) u ON u.page_id = p.k)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed leads with what storing adds."""
    rows = process(leads_of(spark, sf_dir), Config())
    hours = F.make_dt_interval(hours=(F.col("page_id") % 50).cast("int"))
    none = F.lit(None).cast("string")
    return rows.withColumns(
        {"created_at": F.lit("2026-01-01").cast("timestamp") + hours, "company_name": F.concat(F.lit("Company "), (F.col("page_id") % 20).cast("string")), "target_location": F.lit("Portland"), "tier1_result": none, "tier2_result": none}
    )


# The read API.


@query(f"WITH {_STORED} SELECT id, run_id, status AS pipeline_status, score FROM st ORDER BY created_at DESC, id LIMIT 50")
def read_recent_leads(spark, sf_dir):
    """GET /leads/recent, P5, O1 (a top-k report)."""
    return warehouse.recent_leads(stored(spark, sf_dir), 50).select("id", "run_id", "pipeline_status", "score")


@query(f"WITH {_STORED} SELECT id, run_id, company AS company_name, status AS pipeline_status, score, words AS word_count FROM st WHERE id = '7'")
def read_lead_by_id(spark, sf_dir):
    """GET /leads/{id}, P5 (a lookup by key is the feature)."""
    return warehouse.lead_by_id(stored(spark, sf_dir), "7").select("id", "run_id", "company_name", "pipeline_status", "score", "word_count")


@query(f"WITH {_STORED} SELECT id, status AS pipeline_status, score FROM st WHERE run_id = 'run3' ORDER BY created_at DESC, id LIMIT 200")
def read_run_leads(spark, sf_dir):
    """GET /runs/{id}/leads, J13, O3 (a top-k report of one run that exists)."""
    rows = stored(spark, sf_dir)
    runs = rows.select(F.col("run_id").alias("id")).distinct()
    return warehouse.leads_for_run(rows, runs, "run3", 200).select("id", "pipeline_status", "score")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 4 = 3 THEN 'queued' WHEN n_nationkey % 4 = 0 THEN 'running' WHEN n_nationkey % 4 = 1 THEN 'completed' ELSE 'failed' END AS status FROM nation ORDER BY n_regionkey DESC, id LIMIT 20")
def read_recent_runs(spark, sf_dir):
    """GET /runs, T7 (a top-k report): nations as runs, three of four with an exit code or under way."""
    n = F.col("n_nationkey")
    runs = table(spark, sf_dir, "nation").select(n.cast("string").alias("id"), F.lit("queued").alias("status"), F.col("n_regionkey").alias("created_at"), n)
    exits = runs.where(n % 4 != 3).select(F.col("id").alias("run_id"), F.when(n % 4 == 1, 0).when(n % 4 == 2, 3).alias("exit_code"))
    return warehouse.recent_runs(warehouse.with_status(runs.drop("n_nationkey"), exits), 20).select("id", "status")


@query("SELECT n_nationkey AS run_id, count(c_custkey) AS leads FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def run_leads_join(spark, sf_dir):
    """Every nation as a run, customers as leads."""
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return warehouse.leads_by_run(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id")), runs)


@query(
    f"""WITH {_STORED} SELECT id, company AS company_name FROM st WHERE contains({HOST.replace('url', 'page_url')}, 'example.org') OR contains(lower(company), 'example.org') OR contains('hvac', 'example.org')
    ORDER BY created_at DESC, id LIMIT 200"""
)
def console_search(spark, sf_dir):
    """F24, O7, X8 (a top-k report)."""
    return warehouse.search_leads(stored(spark, sf_dir), " Example.ORG ", limit=200).select("id", "company_name")


@query(f"WITH {_STORED} SELECT id FROM st WHERE status = 'qualified_deterministic' AND (contains(lower(company), 'company 1') OR contains({HOST.replace('url', 'page_url')}, 'company 1')) ORDER BY created_at DESC, id LIMIT 200")
def console_search_status(spark, sf_dir):
    """F24 with a status (a top-k report)."""
    return warehouse.search_leads(stored(spark, sf_dir), "company 1", "qualified_deterministic", 200).select("id")


_TECHS = "CASE page_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['WordPress'] ELSE ['PHP', 'WordPress'] END"


def _with_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    one = lambda n: F.struct(F.lit(n).alias("name"))
    listed = F.when(k % 3 == 1, F.array(one("WordPress"))).when(k % 3 == 2, F.array(one("PHP"), one("WordPress"))).otherwise(F.expr("cast(array() as array<struct<name:string>>)"))
    return table(spark, sf_dir, "pages").select(k.cast("string").alias("id"), (k % 7).alias("created_at"), listed.alias("technologies"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS id, list_contains({_TECHS}, 'PHP') AS uses FROM pages")
def technology_filter(spark, sf_dir):
    """F25."""
    return _with_technologies(spark, sf_dir).select("id", warehouse.uses_technology("technologies", "PHP").alias("uses"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE len({_TECHS}) > 0 ORDER BY page_id % 7 DESC, id LIMIT 5")
def technology_recent(spark, sf_dir):
    """O5 (a top-k report)."""
    return warehouse.with_technologies(_with_technologies(spark, sf_dir)).select("id")


# Discovery and provenance.


@query("SELECT page_id, page_id % 4 = 0 AS more FROM pages")
def search_more(spark, sf_dir):
    """S3: whether a search page says that there are more, over whole, partial and broken JSON."""
    k = F.col("page_id")
    body = F.when(k % 4 == 0, F.lit('{"query":{"more_results_available":true}}')).when(k % 4 == 1, F.lit('{"query":{"more_results_available":false}}')).when(k % 4 == 2, F.lit("{}")).otherwise("{broken")
    return table(spark, sf_dir, "pages").select(k, discovery.more_available(body).alias("more"))


@query("SELECT 'r1' AS run_id, 'https://shop.example.com' AS website_url, 'direct_url' AS discovery_source, 'hvac' AS target_industry")
def direct_run(spark, sf_dir):
    """S4."""
    return discovery.direct_candidate(spark, "https://Shop.Example.com/", "hvac", "Portland", "r1").select("run_id", "website_url", "discovery_source", "target_industry")


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'no url' ELSE {HOST} END AS host FROM pages")
def console_hosts(spark, sf_dir):
    """X8."""
    u = F.when(F.col("page_id") % 3 == 0, F.lit("no url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.console_host(u).alias("host"))


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'website_extracted' END AS company_class, CASE WHEN page_id % 2 = 0 THEN url END AS company_url, 'derived_internal' AS category_class,
    'website_text' AS category_from, CASE WHEN page_id % 3 = 0 THEN 'high' END AS address_confidence FROM pages"""
)
def lead_provenance(spark, sf_dir):
    """P11."""
    k, u = F.col("page_id"), F.col("url")
    told = html.provenance({"company_name": (F.when(k % 2 == 0, F.lit("A")), u), "category": (F.lit("hvac"), u), "phone_number": (F.lit(""), u), "address": (F.when(k % 3 == 0, F.lit("1 Main St")), u)})
    at = lambda path: F.get_json_object("p", "$." + path)
    rows = table(spark, sf_dir, "pages").select("page_id", told.alias("p"))
    return rows.select("page_id", at("company_name.source_class").alias("company_class"), at("company_name.source_url").alias("company_url"), at("category.source_class").alias("category_class"), at("category.derived_from").alias("category_from"), at("address.confidence").alias("address_confidence"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -2147483648 WHEN c_custkey % 3 = 1 THEN 2147483647 ELSE CAST(c_custkey AS INTEGER) END AS n FROM customer")
def saturated_counts(spark, sf_dir):
    """X25."""
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", landed.saturated(F.when(k % 3 == 0, k - 10**10).when(k % 3 == 1, k + 10**10).otherwise(k)).alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'passed' END AS tier1, CASE WHEN page_id % 3 = 0 THEN 'done' END AS tier2, page_id % 2 = 0 AS has_tier1 FROM pages")
def tier_summary(spark, sf_dir):
    """Stages that weren't run leave no key."""
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", tiers.llm_summary(F.when(k % 2 == 0, F.lit("passed")), F.when(k % 3 == 0, F.lit("done"))).alias("s"))
    return rows.select("page_id", F.get_json_object("s", "$.tier1").alias("tier1"), F.get_json_object("s", "$.tier2").alias("tier2"), F.contains("s", F.lit("tier1")).alias("has_tier1"))


# Packs and technologies.


@query("SELECT * FROM (VALUES ('A', 'one', 1), ('B', 'two', 2), ('C', 'two', 1), ('D', 'three', 1)) t(name, pack, patterns)")
def packs_overridden(spark, sf_dir):
    """Of three packs the last one that has a technology gives it, all its patterns and none of the others'."""
    made = []
    for label, entries in (("one", {"A": "a", "B": "b"}), ("two", {"B": ["x", "y"], "C": "c", "D": "d"}), ("three", {"D": "e"})):
        pack = packs.Pack()
        for name, patterns in entries.items():
            packs.add_entry(pack, packs.Stats(label), name, {"html": patterns}, label)
        made.append(pack)
    _, pattern, _ = packs.tables(spark, packs.overridden(*made))
    return pattern.groupBy("name", "pack").agg(F.count("*").cast("int").alias("patterns"))


#: What the small pack tells of the leads made below, after resolving and the blocklist: WordPress by script or generator, PHP by
#: header with a version or else implied, MySQL implied, Squarespace by script, Cloudflare by header, and jQuery where it has company.
_TECH_SQL = r"""t AS (SELECT CAST(page_id AS VARCHAR) AS lead, page_id % 31 = 0 AS squarespace, page_id % 31 = 1 AS script, page_id % 31 = 2 AS jquery, page_id % 5 = 0 AS generator, page_id % 7 = 0 AS php, page_id % 3 = 0 AS cloudflare, page_id % 10 AS minor FROM pages),
found AS (SELECT lead, 'WordPress' AS name, 100 AS confidence, CASE WHEN generator THEN '6.' || minor END AS version FROM t WHERE script OR generator
UNION ALL SELECT lead, 'PHP', CASE WHEN php THEN 100 ELSE 50 END, CASE WHEN php THEN '8.' || minor END FROM t WHERE php OR script OR generator
UNION ALL SELECT lead, 'MySQL', 50, NULL FROM t WHERE script OR generator UNION ALL SELECT lead, 'Squarespace', 100, NULL FROM t WHERE squarespace
UNION ALL SELECT lead, 'Cloudflare', 30, NULL FROM t WHERE cloudflare UNION ALL SELECT lead, 'jQuery', 40, '3.6.0' FROM t WHERE jquery AND (generator OR php OR cloudflare))"""


def _tech_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tech_columns(leads_of(spark, sf_dir))


def _tech_columns(leads: DataFrame) -> DataFrame:
    k = F.col("page_id")
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    none = F.lit(None).cast("string")
    version = lambda text: F.concat(F.lit(text), (k % 10).cast("string"))
    sent = F.array(header("Server", F.when(k % 3 == 0, F.lit("cloudflare")).otherwise("nginx")), header("X-Powered-By", F.when(k % 7 == 0, version("PHP/8.")).otherwise(none)))
    return leads.withColumns(
        {
            "raw_html": F.lit("<p>plain</p>"), "text_content": F.lit("plain"), "response_headers": sent, "meta_lines": F.array(F.when(k % 5 == 0, version("generator=WordPress 6.")).otherwise("author=x")),
            "robots_txt": F.struct(F.lit(True).alias("exists"), F.lit("User-agent: *").alias("body")),
        }
    )


def _fingerprints() -> packs.Pack:
    return packs.overridden(packs.fingerprint_pack(), packs.fingerprint_pack(packs.HERE / "local", "local_biz"))


@query(f"WITH {_TECH_SQL} SELECT * FROM found")
def technologies_found(spark, sf_dir):
    """Leads through the matcher, resolver and blocklist, every detection."""
    return match.match_leads(_tech_leads(spark, sf_dir), _fingerprints(), packs.blocklist()).select("lead", "name", "confidence", "version")


@query(f"WITH {_PROCESSED}, {_TECH_SQL}, n AS (SELECT lead, string_agg(name, ',' ORDER BY name) AS names FROM found GROUP BY 1) SELECT id, CASE WHEN gs = 'pending_tier_1' THEN coalesce(names, '') END AS technologies, CASE WHEN gs <> 'rejected_compliance' THEN 'website_modernization' END AS campaign, 'website_modernization' AS campaign_type FROM p LEFT JOIN n ON n.lead = p.id")
def write_path_technologies(spark, sf_dir):
    """The whole write path with technologies, and the flags of gate and evaluation as one struct."""
    rows = process(_tech_leads(spark, sf_dir), Config(signals_v2=True), _fingerprints(), packs.blocklist())
    names = F.array_join(F.array_sort(F.transform("technologies", lambda t: t["name"])), ",")
    return rows.select("id", names.alias("technologies"), F.col("heuristic_flags.campaign").alias("campaign"), F.col("heuristic_flags.campaign_type").alias("campaign_type"))


# Page signals that regular pages tell by regular expressions too.


@query(
    r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS raw_title, regexp_matches(html, '(?i)<form[\s>]') AS has_form, regexp_matches(html, '(?i)<meta[^>]*name="viewport"') AS has_viewport,
    regexp_matches(html, '(?i)<a\b[^>]*href="tel:') AS has_tel_link, regexp_matches(html, '(?i)<a\b[^>]*href="mailto:') AS has_mailto_link, CAST(len(regexp_extract_all(html, '(?i)<a\b[^>]*href="[^"]')) AS INTEGER) AS anchors FROM pages"""
)
def html_signal_flags(spark, sf_dir):
    """H11, H12 and the number of H3 by the parser, on pages that regular expressions can tell as well (H3-H6 whole: dom_signals)."""
    got = html.page_signals(table(spark, sf_dir, "pages")).select("page_id", "has_form", "has_viewport", "has_tel_link", "has_mailto_link", F.size("anchor_hrefs").alias("anchors"))
    return got.join(table(spark, sf_dir, "pages").select("page_id", html.title_of("html").alias("raw_title")), "page_id")


# Streaming.


def _pages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as a stream of files; the glob takes one file or a folder of them."""
    batch = table(spark, sf_dir, "pages")
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 100).parquet(f"{sf_dir}/pages*.parquet")


def _stored_stream(spark: SparkSession, rows: DataFrame, batch=lambda b: b) -> DataFrame:
    """A stream stored batch by batch in the shared folder until its source is read, and read back."""
    at = f"{shared_dir(spark)}/siteprism/stream-{uuid.uuid4().hex}"
    stream.store(rows, f"{at}/rows", f"{at}/state", batch).awaitTermination()
    return spark.read.parquet(f"{at}/rows").drop("batch")


@query(f"WITH {_PROCESSED} SELECT id, CASE WHEN gs = 'pending_tier_1' THEN ds ELSE gs END AS pipeline_status FROM p")
def stream_evaluate(spark, sf_dir):
    """Leads as a file stream through the whole write path, stored batch by batch and read back."""
    rows = stream.evaluated(leads_from_pages(_pages_stream(spark, sf_dir)), Config())
    return _stored_stream(spark, rows.select("id", "pipeline_status"))


@query(f"WITH {_PROCESSED}, {_TECH_SQL}, n AS (SELECT lead, string_agg(name || ':' || confidence || ':' || coalesce(version, ''), ',' ORDER BY name) AS names FROM found GROUP BY 1) SELECT id, CASE WHEN gs = 'pending_tier_1' THEN ds ELSE gs END AS pipeline_status, CASE WHEN gs = 'pending_tier_1' THEN coalesce(names, '') END AS technologies, CASE WHEN gs = 'pending_tier_1' THEN 0 END AS failures FROM p LEFT JOIN n ON n.lead = p.id")
def stream_technologies(spark, sf_dir):
    """Leads as a stream with the pack, their technologies resolved within the row."""
    rows = stream.evaluated(_tech_columns(leads_from_pages(_pages_stream(spark, sf_dir))), Config(signals_v2=True), _fingerprints(), packs.blocklist())
    told = F.array_sort(F.transform("technologies", lambda t: F.concat_ws(":", t["name"], t["confidence"].cast("string"), F.coalesce(t["version"], F.lit("")))))
    return _stored_stream(spark, rows.select("id", "pipeline_status", F.array_join(told, ",").alias("technologies"), F.col("matcher_failures").alias("failures")))


@query(f"SELECT DISTINCT CAST(page_id // 100 AS VARCHAR) AS run_id, {HOST} AS domain FROM pages")
def stream_first_in_run(spark, sf_dir):
    """A run's domains, each once, from a stream with state under a watermark."""
    rows = _pages_stream(spark, sf_dir).select(F.expr("cast(page_id div 100 as string)").alias("run_id"), urls.host("url").alias("domain"), F.lit("2026-01-01").cast("timestamp").alias("at"))
    return _stored_stream(spark, stream.first_in_run(rows).select("run_id", "domain"))


@query("SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 3 = 0 THEN 'tier2_failed' ELSE 'tier2_complete' END AS status FROM pages WHERE page_id % 2 = 0")
def stream_tier2(spark, sf_dir):
    """What is queued for tier 2, called by four tasks at a time with retries; what fails for good is told so."""
    k = F.col("page_id")
    status = F.when(k % 2 == 0, "tier2_queued").otherwise("tier1_rejected")
    rows = _pages_stream(spark, sf_dir).select(k.cast("string").alias("id"), status.alias("pipeline_status"), F.struct((k % 3 == 0).alias("broken"), (k % 5 == 0).alias("flaky")).alias("context"))
    calls = stream.call_in_parallel(4, lambda b: tiers.call_tier(b, "tier2", FlakyModel(), Config(), attempts=2, per_minute=1e9))
    return _stored_stream(spark, stream.queued(rows), calls).select("id", "status")


class FlakyModel:
    """Fails always on broken leads, and on flaky ones the first time."""

    def __init__(self) -> None:
        self.seen = 0

    def __call__(self, context: dict) -> dict:
        self.seen += 1
        if context["broken"] or context["flaky"] and self.seen % 2:
            self.seen = 1 if context["flaky"] and not context["broken"] else 0
            raise RuntimeError("not now")
        self.seen = 0
        return {"confidence": 0.5}
