"""The deterministic evaluation of a lead as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.config import Config
from siteprism.functions.urls import netloc

#: Hosts of directories, and of social networks as parts of links.
DIRECTORY_HOSTS = ("yelp.", "facebook.", "instagram.", "tripadvisor.")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "youtube.com", "pinterest.com", "tiktok.com")

#: What an excluded lead is told, by reason.
EXCLUDED = {
    "no_website": "Discovery-only opportunity without a canonical website. Excluded from website evaluator.",
    "crawl": "Website excluded from deterministic evaluation because crawl was not allowed.",
    "parked": "Domain appears to be parked or for sale.",
}
QUALIFIED = "Real local business with actionable deterministic gaps."
UNQUALIFIED = "Either not enough business evidence or not enough campaign-relevant gaps."


def flag(name: str) -> Column:
    """A boolean of the wire record: null counts as false."""
    return F.coalesce(F.col(name), F.lit(False))


def filled(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""


def _links(test) -> Column:
    return F.coalesce(F.exists("anchor_hrefs", test), F.lit(False))


def has_privacy() -> Column:
    """An anchor whose label or URL speaks of privacy."""
    return _links(lambda a: F.lower(F.concat_ws(" ", a["label"], a["url"])).contains("privacy"))


def social_links() -> Column:
    """A3: how many anchors lead to a social network."""
    hits = F.filter("anchor_hrefs", lambda a: a["url"].rlike("|".join(h.replace(".", r"\.") for h in SOCIAL_HOSTS)))
    return F.coalesce(F.size(hits), F.lit(0))


def directory_like() -> Column:
    """F14."""
    return netloc(F.coalesce(F.col("source_url"), F.lit(""))).rlike("|".join(h.replace(".", r"\.") for h in DIRECTORY_HOSTS))


def phone_signal() -> Column:
    return filled("phone_number") | flag("has_tel_link")


def real_business() -> Column:
    """F15."""
    return ~directory_like() & (phone_signal() | filled("address") | flag("has_contact_page"))


def outdated(as_of_year: int) -> Column:
    """Markers of an outdated site, in order."""
    year = F.coalesce(F.col("copyright_year"), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(~flag("has_viewport"), "missing_mobile_viewport"),
            F.when(~filled("page_title"), "missing_page_title"),
            F.when((year > 0) & (year <= as_of_year - 3), F.concat(F.lit("stale_copyright_"), year.cast("string"))),
        )
    )


def missing(campaign: str) -> Column:
    """Features that a campaign misses, in order; none for an unknown campaign."""
    rules = {
        "website_modernization": [(~flag("has_viewport"), "mobile_responsive_design"), (~flag("has_form"), "contact_form"), (~flag("has_cta_signal"), "clear_primary_cta"), (~has_privacy(), "privacy_policy")],
        "voice_ai_agent": [(~phone_signal(), "phone_conversion_flow"), (~flag("has_booking_signal"), "appointment_capture"), (~flag("has_hours_signal"), "published_hours")],
        "smma": [(social_links() == 0, "social_presence_links"), (~flag("has_reviews_signal"), "social_proof"), (~flag("has_cta_signal"), "campaign_landing_cta")],
    }.get(campaign, [])
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules])) if rules else F.expr("cast(array() as array<string>)")


def score(n_missing: Column, n_outdated: Column) -> Column:
    """X17."""
    return F.round(F.least(F.lit(1.0), F.lit(0.35) + 0.12 * n_missing + 0.10 * n_outdated), 4)


def evaluate(leads: DataFrame, config: Config) -> DataFrame:
    """the leads with the twelve columns of an evaluation.

    Exclusions come first, in order: no website, crawl not allowed (a null is no ban), parked. An excluded
    lead has no gaps, score 0 and false for everything.
    """
    lead = leads.withColumns({"_out": outdated(config.as_of_year), "_miss": missing(config.campaign), "_real": real_business()})
    reason = (
        F.when(flag("is_no_website_opportunity"), "no_website")
        .when(F.col("crawl_allowed") == F.lit(False), "crawl")
        .when(flag("is_parked_domain"), "parked")
    )
    lead = lead.withColumn("_why", reason)
    scored = F.col("_why").isNull()
    qualified = scored & F.col("_real") & ((F.size("_miss") > 0) | (F.size("_out") >= 2))
    none = F.expr("cast(array() as array<string>)")
    crawl_reason = F.coalesce(F.nullif(F.col("crawl_disallowed_reason"), F.lit("")), F.lit("crawl_disallowed"))
    robots, sitemap = F.coalesce(F.col("robots_txt.exists"), F.lit(False)), F.coalesce(F.col("sitemap_xml.exists"), F.lit(False))
    told = {"has_contact_page": flag("has_contact_page"), "has_privacy_policy": has_privacy(), "has_contact_form": flag("has_form"), "has_cta": flag("has_cta_signal"), "has_booking_widget": flag("has_booking_signal"), "has_hours_signal": flag("has_hours_signal"), "has_reviews_signal": flag("has_reviews_signal"), "robots_txt_accessible": robots, "sitemap_xml_accessible": sitemap}
    evidence = F.struct(
        netloc(F.coalesce(F.col("source_url"), F.lit(""))).alias("source_host"), F.coalesce("discovery_source", F.lit("")).alias("discovery_source"), F.col("crawl_allowed"),
        F.when(F.coalesce(F.col("_why"), F.lit("")) != "parked", F.coalesce("crawl_disallowed_reason", F.lit(""))).alias("crawl_disallowed_reason"),
        F.when(F.coalesce(F.col("_why"), F.lit("")) != "parked", flag("is_no_website_opportunity")).alias("is_no_website_opportunity"),
        F.when(F.col("_why") == "parked", F.lit(True)).alias("is_parked_domain"), *[F.when(scored, c).alias(k) for k, c in told.items()],
    )
    flags = F.struct(F.lit(config.campaign).alias("campaign_type"), F.col("target_industry"), (scored & F.col("_real")).alias("is_real_business_deterministic"))
    return lead.withColumns(
        {
            "pipeline_status": F.when(F.col("_why") == "no_website", "excluded_no_website_opportunity").when(F.col("_why") == "crawl", "excluded_crawl_disallowed").when(F.col("_why") == "parked", "rejected_parked_domain").when(qualified, "qualified_deterministic").otherwise("rejected_deterministic"),
            "score": F.when(scored, score(F.size("_miss"), F.size("_out"))).otherwise(0.0),
            "is_qualified_lead": qualified,
            "has_booking_widget": scored & flag("has_booking_signal"),
            "is_mobile_optimized": scored & flag("has_viewport"),
            "has_clear_contact_info": scored & (phone_signal() | flag("has_mailto_link") | flag("has_contact_page")),
            "overall_digital_health": F.when(F.col("_why") == "no_website", EXCLUDED["no_website"]).when(F.col("_why") == "crawl", EXCLUDED["crawl"]).when(F.col("_why") == "parked", EXCLUDED["parked"]).when(qualified, QUALIFIED).otherwise(UNQUALIFIED),
            "rejection_reason": F.when(F.col("_why") == "no_website", "no_website_opportunity").when(F.col("_why") == "crawl", crawl_reason).when(F.col("_why") == "parked", "parked_domain").when(~qualified, "deterministic_gate_reject"),
            "identified_service_gaps": F.when(scored, F.col("_out")).otherwise(none),
            "missing_critical_features": F.when(scored, F.col("_miss")).otherwise(none),
            "evaluation_flags": flags,
            "deterministic_evidence": evidence,
        }
    ).drop("_out", "_miss", "_real", "_why")
