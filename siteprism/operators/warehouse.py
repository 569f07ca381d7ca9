"""The stored tables and the queries over them (S16-S19, O1-O7, A8-A10, A14, J13, F23-F25, the HTTP surface)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteprism import schemas
from siteprism.config import RunRequest

LIST = (
    "id", "run_id", "created_at", "company_name", "source_url", "target_industry", "target_location", "pipeline_status", "score",
    "is_qualified_lead", "rejection_reason", "overall_digital_health", "heuristic_flags", "deterministic_evidence", "tier1_result",
    "tier2_result", "identified_service_gaps", "missing_critical_features",
)
DETAIL = (
    "id", "created_at", "timestamp", "source_url", "initial_url", "final_url", "discovery_source", "target_industry", "target_location",
    "company_name", "category", "phone_number", "address", "pipeline_status", "score", "is_qualified_lead", "rejection_reason",
    "overall_digital_health", "heuristic_flags", "deterministic_evidence", "tier1_result", "tier2_result", "llm_output",
    "full_llm_payload", "identified_service_gaps", "missing_critical_features", "crawl_allowed", "crawl_disallowed_reason",
    "http_status", "is_https", "redirect_count", "content_type", "page_title", "provider_provenance", "website_provenance", "robots_txt",
    "sitemap_xml", "word_count", "has_viewport", "has_form", "has_tel_link", "has_mailto_link", "is_parked_domain",
    "outbound_domain_count", "schema_org_business_type", "email_address", "meta_description", "social_linkedin", "social_facebook",
    "social_instagram", "copyright_year", "has_booking_signal", "has_cta_signal", "has_hours_signal", "has_reviews_signal",
    "has_contact_page", "run_id",
)


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def newest(df: DataFrame, limit: int, most: int = 50, key: str = "id", at: str = "created_at") -> DataFrame:
    """O1, O2: newest rows first, ties by key; planned as a top-k without a full sort."""
    return df.orderBy(F.desc(at), key).limit(clamp(limit, most))


def recent_leads(leads: DataFrame, limit: int = 10) -> DataFrame:
    """GET /leads/recent: the projection reaches the scan, so page bodies aren't read."""
    return newest(leads.select(*LIST), limit)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return newest(runs, limit)


def lead_by_id(leads: DataFrame, lead_id: str) -> DataFrame:
    """GET /leads/{id}; LookupError where there is none."""
    return _found(leads.where(F.col("id") == lead_id).select(*[c for c in DETAIL if c in leads.columns]), lead_id)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return _found(runs.where(F.col("id") == run_id), run_id)


def _found(df: DataFrame, key: str) -> DataFrame:
    if df.isEmpty():
        raise LookupError(f"{key} not found")
    return df


def leads_for_run(leads: DataFrame, runs: DataFrame, run_id: str, limit: int = 50) -> DataFrame:
    """The newest leads of a run that exists; LookupError for another."""
    run_by_id(runs, run_id)
    return newest(leads.where(F.col("run_id") == run_id).select(*LIST), limit, 200)


def best_in_status(leads: DataFrame, status: str, limit: int = 50) -> DataFrame:
    """O4."""
    return leads.where(F.col("pipeline_status") == status).orderBy(F.desc("score"), "id").limit(limit)


def uses_technology(technologies: str, name: str) -> Column:
    """the array of detections holds one of that name."""
    return F.coalesce(F.exists(technologies, lambda t: t["name"] == name), F.lit(False))


def with_technologies(leads: DataFrame, limit: int = 5) -> DataFrame:
    """O5."""
    return newest(leads.where(F.size("technologies") > 0), limit)


def search_leads(leads: DataFrame, text: str = "", status: str | None = None, limit: int = 50) -> DataFrame:
    """The console's search over host, company and industry, newest first; blank text finds all."""
    from siteprism.functions.urls import console_host

    q = text.strip().lower()
    rows = leads if status is None else leads.where(F.col("pipeline_status") == status)
    if q:
        low = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
        rows = rows.where(low(console_host("source_url")) | low(F.col("company_name")) | low(F.col("target_industry")))
    return newest(rows, limit, 200)


def status_counts(leads: DataFrame) -> DataFrame:
    """A9."""
    return leads.groupBy("run_id", "pipeline_status").agg(F.count("*").alias("n"))


def console_counters(leads: DataFrame) -> DataFrame:
    """Counts of status classes, a row for each run."""
    s = F.col("pipeline_status")
    return leads.groupBy("run_id").agg(
        F.count("*").alias("discovered"), F.count_if(s == "rejected_deterministic").alias("rejected"), F.count_if(s.startswith("excluded_")).alias("skipped"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "qualified_deterministic").alias("persisted"),
    )


def cost_by_run(leads: DataFrame) -> DataFrame:
    """A10."""
    return leads.groupBy("run_id").agg(F.sum("llm_processing_cost").alias("cost"))


def page_count(page: DataFrame) -> int:
    """A14."""
    return page.count()


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Leads by run, and runs."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.leads ({schemas.LEADS}) USING parquet PARTITIONED BY (run_id)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.evaluation_runs ({schemas.RUNS}) USING parquet")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for t in ("leads", "evaluation_runs"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{t}")


def append(leads: DataFrame, path: str) -> None:
    """One commit for a whole batch."""
    leads.write.mode("append").partitionBy("run_id").parquet(path)


def latest(versions: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """Parquet rows aren't changed; a change is a new version, and this is the view of the last ones.

    Of versions of one time the greatest by their other columns stands, so that reruns agree.
    """
    order = W.partitionBy(key).orderBy(F.desc(at), F.desc(F.to_json(F.struct(*versions.columns))))
    return versions.withColumn("_v", F.row_number().over(order)).where("_v = 1").drop("_v")


def updated(rows: DataFrame, changes: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """Rows with the changes' values in ``columns`` where the changes have the key."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, F.col(key) == F.col("_k"), "left")
    return out.withColumns({c: F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def create_run(spark: SparkSession, request: RunRequest, run_id: str, now: str) -> DataFrame:
    """POST /runs/...: the row of a new run, queued. ``now`` is given, as rows must repeat."""
    r = request
    row = spark.createDataFrame([(run_id, r.input_mode, "queued", r.target_industry, r.target_location, r.direct_url, r.candidate_limit, r.max_pages, r.campaign, r.llm_enabled)], "id string, input_mode string, status string, target_industry string, target_location string, direct_url string, candidate_limit int, max_pages int, campaign_type string, llm_enabled boolean")
    return row.withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("updated_at", F.lit(now).cast("timestamp"))


def run_status(exit_code: int | None) -> str:
    """T7."""
    return "running" if exit_code is None else "completed" if exit_code == 0 else "failed"


def with_status(runs: DataFrame, exits: DataFrame) -> DataFrame:
    """Runs with the status that their process' exit code (run_id, exit_code; null while it runs) gives; others as they are."""
    told = F.when(F.col("exit_code").isNull(), "running").when(F.col("exit_code") == 0, "completed").otherwise("failed")
    return updated(runs, exits.select(F.col("run_id").alias("id"), told.alias("status")), ("status",))


def leads_by_run(leads: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run with how many leads it has, none included."""
    counts = leads.groupBy("run_id").agg(F.count("*").alias("leads"))
    return runs.select(F.col("id").alias("run_id")).join(counts, "run_id", "left").withColumn("leads", F.coalesce("leads", F.lit(0)))


def health() -> dict[str, str]:
    """GET /metrics."""
    return {"status": "ok"}
