"""Discovery of candidates: search pages to unique sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteprism.functions import urls
from siteprism.functions.text import squeeze
from siteprism.schemas import CANDIDATE

_BODY = "struct<web:struct<results:array<struct<url:string,title:string,description:string>>>>"


def fetch_target(limit: int, pages: int) -> int:
    """How many results a run asks the search for."""
    return min(max(limit * pages, 20), pages * 20)


def search_results(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Url, title, description and position of each result in a page's JSON body, beside the page's columns.

    Trimmed; results without a URL go; broken JSON gives no rows.
    """
    found = F.from_json(body, _BODY)["web"]["results"]
    rows = bodies.select(*[c for c in bodies.columns if c != body], F.posexplode(found).alias("pos", "r"))
    text = lambda k: F.trim(F.coalesce(F.col(f"r.{k}"), F.lit("")))
    return rows.select(*[c for c in rows.columns if c != "r"], text("url").alias("url"), text("title").alias("title"), text("description").alias("description")).where("url <> ''")


def more_available(body: Column | str) -> Column:
    """S3."""
    return F.coalesce(F.get_json_object(body, "$.query.more_results_available") == "true", F.lit(False))


def direct_candidate(spark: SparkSession, url: str, industry: str, location: str, run_id: str) -> DataFrame:
    """The one candidate of a run on a given URL; ValueError where that is no site's."""
    one = spark.range(1).select(F.lit(run_id).alias("run_id"), urls.site_url(F.lit(url)).alias("website_url")).first()
    if one.website_url is None:
        raise ValueError(f"not a website: {url}")
    row = (run_id, one.website_url, "direct_url", industry, location, "{}", "", False)
    return spark.createDataFrame([row], CANDIDATE)


def _steps(results: DataFrame) -> DataFrame:
    """Each result (run, page, pos, url) with its site, domain, and what became of it, before any limit."""
    rows = results.withColumn("site", urls.site_url("url")).withColumn("domain", urls.domain_key("site"))
    first = F.row_number().over(W.partitionBy("run", "domain").orderBy("page", "pos")) == 1
    return rows.withColumn("outcome", F.when(F.col("domain").isNull(), "non_canonical").when(first, "queued").otherwise("duplicate"))


def first_per_domain(results: DataFrame, limit: int) -> DataFrame:
    """The first result of each domain in a run, in arrival order, up to ``limit`` in a run."""
    kept = _steps(results).where("outcome = 'queued'")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("run").orderBy("page", "pos"))).where(F.col("place") <= limit)


def counters(results: DataFrame, limit: int) -> DataFrame:
    """Run, queued, raw_results, non_canonical, duplicates, pages; counting stops where the limit is reached.

    A page counts if the limit wasn't reached before it; its results count until it is.
    """
    order = W.partitionBy("run").orderBy("page", "pos").rowsBetween(W.unboundedPreceding, -1)
    queued = (F.col("outcome") == "queued").cast("int")
    rows = _steps(results).withColumn("before", F.coalesce(F.sum(queued).over(order), F.lit(0)))
    rows = rows.withColumn("page_before", F.min("before").over(W.partitionBy("run", "page")))
    seen, read = F.col("before") < limit, F.col("page_before") < limit
    count = lambda c: F.count_if(c)
    return rows.groupBy("run").agg(
        count(seen & (F.col("outcome") == "queued")).alias("queued"), count(read).alias("raw_results"),
        count(seen & (F.col("outcome") == "non_canonical")).alias("non_canonical"), count(seen & (F.col("outcome") == "duplicate")).alias("duplicates"),
        F.count_distinct(F.when(read, F.col("page"))).alias("pages"),
    )


def candidates(results: DataFrame, industry: str, location: str, limit: int, source: str = "search") -> DataFrame:
    """The candidate rows that a run queues."""
    rows = first_per_domain(results, limit)
    told = F.to_json(F.struct(F.lit(source).alias("provider"), F.lit(f"{industry} in {location}").alias("query"), F.lit(True).alias("transient_only"), F.lit(False).alias("provider_payload_stored"), F.col("page"), F.col("domain").alias("domain_key")))
    return rows.select(
        F.col("run").cast("string").alias("run_id"), F.col("site").alias("website_url"), F.lit(source).alias("discovery_source"), F.lit(industry).alias("target_industry"),
        F.lit(location).alias("target_location"), told.alias("provider_provenance_json"), F.lit("").alias("provider_fsq_id"), F.lit(False).alias("is_no_website_opportunity"),
    )


def without_denied_hosts(df: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """F8 against a table (column denied): rows whose host and all hosts above it are absent from it.

    Every host becomes its suffixes, so that the theta anti-join is an equi-join and any list size works.
    """
    h = F.regexp_replace(urls.host(url), r"^(www\.)+", "")
    parts = F.split(h, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hit = df.select(h.alias("_h"), F.explode(above).alias("denied")).distinct().join(hosts.select("denied").distinct(), "denied", "left_semi").select("_h").distinct()
    return df.withColumn("_h", h).join(hit, "_h", "left_anti").drop("_h")


def priority_links(links: DataFrame, top: int = 3, **tokens: tuple) -> DataFrame:
    """The best internal links of each page (page_id, base, url, label): page_id, link, score, place.

    Internal, on the page's host, with a path of its own, scoring above zero; distinct; best score first, then
    by URL. ``tokens`` replace the token lists of the score (denied, scores).
    """
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    # each stage is computed once: filters on what a generator makes are not pushed into its expressions
    once = lambda df, *cols: df.select("page_id", "base", "pos", "label", F.inline(F.array(F.struct(*cols))))
    rows = once(links.where(urls.is_internal("base", "url")), urls.link_target("url").alias("link"), bare(urls.path("base")).alias("here")).where("link is not null")
    rows = once(rows, "link", "here", bare(urls.path("link")).alias("own"), F.trim(urls.path("link")).alias("path")).where("own <> '' and own <> here")
    score = urls.link_score(urls.ascii_lower("path"), urls.ascii_lower(squeeze("label")), **tokens)
    # of several labels the first in the page counts, as the link is taken up once
    best = once(rows, "link", score.alias("score")).where("score > 0").withColumn("again", F.row_number().over(W.partitionBy("page_id", "link").orderBy("pos"))).where("again = 1")
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "link"))
    return best.withColumn("place", place).where(F.col("place") <= top).select("page_id", "link", "score", "place")
