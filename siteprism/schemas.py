"""Schemas, as DDL, of everything that is read or stored; nothing is ever inferred."""

from __future__ import annotations

import re

#: A link, script or stylesheet of a page.
URL_ARTIFACT = ("url string, is_internal boolean, label string")
ROOT_FILE = ("path string, http_status int, exists boolean, content_type string, body string")
HEADER = ("key string, value string")

CANDIDATE = ("run_id string, website_url string, discovery_source string, target_industry string, target_location string,"
    " provider_provenance_json string, provider_fsq_id string, is_no_website_opportunity boolean"
)

_SIGNALS = (
    "word_count int, has_viewport boolean, has_form boolean, has_tel_link boolean, has_mailto_link boolean, is_parked_domain boolean,"
    " outbound_domain_count int, schema_org_business_type string, email_address string, meta_description string,"
    " social_linkedin string, social_facebook string, social_instagram string, copyright_year int, has_booking_signal boolean,"
    " has_cta_signal boolean, has_hours_signal boolean, has_reviews_signal boolean, has_contact_page boolean"
)
PAGE_SIGNALS = (_SIGNALS)

_LINKS = "array<struct<url:string,is_internal:boolean,label:string>>"
_HEADERS = "array<struct<key:string,value:string>>"
_ROOT = "struct<path:string,http_status:int,exists:boolean,content_type:string,body:string>"

RAW_LEAD = ("id string, timestamp string, run_id string, source_url string, initial_url string, final_url string,"
    " discovery_source string, target_industry string, target_location string,"
    " crawl_allowed boolean, crawl_disallowed_reason string, is_no_website_opportunity boolean, provider_fsq_id string,"
    " company_name string, category string, phone_number string, address string,"
    " provider_provenance_json string, website_provenance_json string, location_confidence float, category_confidence float,"
    " http_status int, is_https boolean, redirect_count int, fetch_duration_ms int, response_size_bytes int, content_type string,"
    f" response_headers {_HEADERS}, raw_html string, text_content string, page_title string,"
    f" anchor_hrefs {_LINKS}, script_srcs {_LINKS}, stylesheet_hrefs {_LINKS}, robots_txt {_ROOT}, sitemap_xml {_ROOT}, manifest_url string, "
    + _SIGNALS
)
#: A batch on the wire: leads in an array.
LEAD_BATCH = "leads array<struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", RAW_LEAD) + ">>"

DETECTION = ("name string, pack string, categories array<int>, confidence int, version string, source string, matched_field string,"
    " matched_value string, pattern_id string, cpe string, pricing array<string>, saas boolean, oss boolean, website string"
)

RUNS = ("id string, input_mode string, status string, target_industry string, target_location string, direct_url string,"
    " candidate_limit int, max_pages int, campaign_type string, llm_enabled boolean, created_at timestamp, updated_at timestamp"
)

LEADS = ("id string, timestamp string, run_id string, source_url string, initial_url string, final_url string, discovery_source string,"
    " target_industry string, target_location string, crawl_allowed boolean, crawl_disallowed_reason string,"
    " is_no_website_opportunity boolean, provider_fsq_id string, provider_provenance string, website_provenance string,"
    " location_confidence double, category_confidence double, company_name string, category string, phone_number string, address string,"
    " http_status int, is_https boolean, redirect_count int, fetch_duration_ms int, response_size_bytes int, content_type string,"
    f" page_title string, manifest_url string, raw_html string, text_content string, response_headers {_HEADERS}, anchor_hrefs {_LINKS},"
    f" script_srcs {_LINKS}, stylesheet_hrefs {_LINKS}, robots_txt {_ROOT}, sitemap_xml {_ROOT}, {_SIGNALS},"
    " pipeline_status string, score double, heuristic_flags string, deterministic_evidence string, is_qualified_lead boolean,"
    " has_booking_widget boolean, is_mobile_optimized boolean, has_clear_contact_info boolean, overall_digital_health string,"
    " rejection_reason string, identified_service_gaps array<string>, missing_critical_features array<string>,"
    " tier1_result string, tier2_result string, llm_output string, full_llm_payload string, llm_processing_cost double,"
    " created_at timestamp, updated_at timestamp"
)

#: Every value of leads.pipeline_status that is ever written.
STATUSES = (
    "rejected_compliance", "rejected_heuristic_low_word_count", "rejected_heuristic_parked_domain", "rejected_heuristic_campaign_mismatch",
    "excluded_no_website_opportunity", "excluded_crawl_disallowed", "rejected_parked_domain", "qualified_deterministic",
    "rejected_deterministic", "tier1_rejected", "tier1_passed", "tier1_failed_fallback", "tier2_queued", "tier2_running",
    "tier2_complete", "tier2_failed",
)
