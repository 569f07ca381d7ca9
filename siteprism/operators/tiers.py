"""The two later tiers: who is eligible, what they are given, and how a status results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.config import Config

#: Characters of text and of html that a tier is given.
TEXT_CHARS, HTML_CHARS = 4000, 12000
VERSIONS = {"input": "lead_eval_context.v1", "tier1": "tier1_gate.v1", "tier2": "tier2_enrichment.v1"}


def tier1_skip_reason(status: Column, score_v2: Column, campaign: Column, industry: Column, config: Config) -> Column:
    """why tier 1 is not run, the first of nine reasons, or null."""
    off = [(not config.llm_enabled, "llm_pipeline_disabled"), (not config.tier1_enabled, "tier1_disabled"), (not config.signals_v2, "signals_v2_required"), (not config.scoring_v2, "scoring_v2_required")]
    out = F.when(F.lit(off[0][0]), off[0][1])
    for when, why in off[1:]:
        out = out.when(F.lit(when), why)
    out = out.when(F.coalesce(status, F.lit("")) != "qualified_deterministic", "deterministic_path_not_qualified").when(score_v2.isNull(), "score_v2_missing").when(score_v2 < config.tier1_min_score, "score_v2_below_threshold")
    return _supported(out, campaign, industry, config.tier1_campaigns, config.tier1_industries)


def tier2_skip_reason(campaign: Column, industry: Column, config: Config) -> Column:
    """why tier 2 is not run, the first of four reasons, or null. Neither score nor tier 1 matters."""
    out = F.when(F.lit(not config.llm_enabled), "llm_pipeline_disabled").when(F.lit(not config.tier2_enabled), "tier2_disabled")
    return _supported(out, campaign, industry, config.tier2_campaigns, config.tier2_industries)


def _supported(out: Column, campaign: Column, industry: Column, campaigns: tuple[str, ...], industries: tuple[str, ...]) -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    if campaigns:
        out = out.when(~low(campaign).isin(*campaigns), "unsupported_campaign")
    if industries:
        out = out.when(~low(industry).isin(*industries), "unsupported_industry")
    return out


def final_status(deterministic: Column, llm_enabled: Column, tier1_status: Column, verdict: Column, tier2_skip: Column) -> Column:
    """The status of a lead after both tiers: rejected by tier 1, queued for tier 2, or what came before."""
    return (
        F.when(~llm_enabled, deterministic)
        .when((tier1_status == "tier1_rejected") | (F.coalesce(verdict, F.lit("")) == "reject"), "tier1_rejected")
        .when(tier2_skip.isNull(), "tier2_queued")
        .when(tier1_status.isin("tier1_failed_fallback", "tier1_passed"), tier1_status)
        .otherwise(deterministic)
    )


def excerpt(c: Column | str, limit: int) -> Column:
    return F.substring(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 1, limit)


def context(config: Config) -> Column:
    """The versioned struct that a tier is given."""
    text = lambda *names: [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]
    return F.struct(
        F.lit(VERSIONS["input"]).alias("payload_version"),
        F.struct(F.coalesce("id", F.lit("")).alias("lead_id"), *text("run_id", "source_url", "initial_url", "final_url", "timestamp")).alias("lead"),
        F.struct(F.lit(config.campaign).alias("campaign_type"), *text("target_industry", "target_location", "discovery_source", "company_name", "category", "phone_number", "address")).alias("business"),
        F.coalesce("pipeline_status", F.lit("")).alias("pipeline_status"), F.coalesce("is_qualified_lead", F.lit(False)).alias("is_qualified_lead"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.struct(excerpt("text_content", TEXT_CHARS).alias("text_excerpt"), excerpt("raw_html", HTML_CHARS).alias("html_excerpt"), *text("page_title")).alias("snippets"),
    )


RECORD = "stage string, status string, model string, prompt_version string, payload_version string, error string, output string"


def call_tier(leads: DataFrame, stage: str, call: Callable[[dict], dict], config: Config, attempts: int = 1, per_minute: float | None = None) -> DataFrame:
    """Id and the stage record of ``call`` on each lead's context (column context); one failure stays one lead's.

    Tier 1 fails open (a pass, as a fallback); tier 2 fails to ``tier2_failed``, each after so many ``attempts``.
    ``call`` is shipped to the workers: it takes and returns a dictionary. A task begins at most ``per_minute``
    calls a minute: with ``stream.call_in_parallel`` that is a limit's share of each task.
    """
    model = config.tier1_model if stage == "tier1" else config.tier2_model
    fallback = {"verdict": "pass", "confidence": 0.0, "is_real_local_business": True, "is_niche_match": True, "business_type_guess": "unknown"}

    def one(text: str) -> tuple[str, str | None, dict | None]:
        try:
            for left in reversed(range(attempts)):
                if per_minute:
                    time.sleep(60 / per_minute)
                try:
                    got = call(json.loads(text))
                    break
                except Exception:
                    if not left:
                        raise
        except Exception as e:  # whatever a caller's function raises
            return ("tier1_failed_fallback", str(e), fallback | {"rationale_short": str(e)}) if stage == "tier1" else ("tier2_failed", str(e), None)
        if stage == "tier2":
            return "tier2_complete", None, got
        return "tier1_rejected" if got.get("verdict") == "reject" else "tier1_passed", None, got

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [one(x) for x in part["ctx"]]
            yield pd.DataFrame({"id": part["id"], "stage": stage, "status": [r[0] for r in rows], "model": model, "prompt_version": VERSIONS[stage], "payload_version": VERSIONS["input"], "error": [r[1] for r in rows], "output": [r[2] and json.dumps(r[2]) for r in rows]})

    return leads.select("id", F.to_json("context").alias("ctx")).mapInPandas(run, "id string, " + RECORD)


def stub_gate(ctx: dict) -> dict:
    """A deterministic stand-in for a model: passes what has a company name or a phone number."""
    real = bool(ctx["business"].get("company_name") or ctx["business"].get("phone_number"))
    return {"verdict": "pass" if real else "reject", "rejection_code": None if real else "no_business_evidence", "confidence": 0.9 if real else 0.6, "is_real_local_business": real, "is_niche_match": True, "business_type_guess": ctx["business"].get("category") or "unknown", "rationale_short": "evidence of a business" if real else "no evidence of a business", "supporting_facts": []}


def stub_enrichment(ctx: dict) -> dict:
    b = ctx["business"]
    return {"business_profile": {"business_name": b.get("company_name") or "Unnamed", "category": b.get("category") or b.get("target_industry"), "phone_number": b.get("phone_number"), "address": b.get("address")}, "service_gaps": {"has_online_booking": False, "is_mobile_optimized": True, "has_clear_contact_info": bool(b.get("phone_number")), "outdated_indicators": [], "missing_critical_features": []}, "operator_summary": "stub", "confidence": 0.5}


ENRICHMENT = "business_profile struct<business_name:string,category:string,phone_number:string,address:string>, service_gaps struct<has_online_booking:boolean,is_mobile_optimized:boolean,has_clear_contact_info:boolean,outdated_indicators:array<string>,missing_critical_features:array<string>>, operator_summary string, confidence double"


def enrich(leads: DataFrame, results: DataFrame) -> DataFrame:
    """Leads with tier 2 results (id, status, output as ENRICHMENT struct or null).

    An output fills business fields that are empty and replaces gap flags and lists; without one only the
    status changes; leads without a result stay as they are.
    """
    r = results.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("output").alias("_o"))
    has = F.col("_o").isNotNull()
    fill = lambda c, k: F.when(has & (F.coalesce(F.col(c), F.lit("")) == "") & (F.coalesce(F.col(f"_o.business_profile.{k}"), F.lit("")) != ""), F.col(f"_o.business_profile.{k}")).otherwise(F.col(c))
    put = lambda c, k: F.when(has, F.col(k)).otherwise(F.col(c))
    new = {
        "company_name": fill("company_name", "business_name"), "category": fill("category", "category"), "phone_number": fill("phone_number", "phone_number"), "address": fill("address", "address"),
        "has_booking_widget": put("has_booking_widget", "_o.service_gaps.has_online_booking"), "is_mobile_optimized": put("is_mobile_optimized", "_o.service_gaps.is_mobile_optimized"),
        "has_clear_contact_info": put("has_clear_contact_info", "_o.service_gaps.has_clear_contact_info"), "identified_service_gaps": put("identified_service_gaps", "_o.service_gaps.outdated_indicators"),
        "missing_critical_features": put("missing_critical_features", "_o.service_gaps.missing_critical_features"), "overall_digital_health": put("overall_digital_health", "_o.operator_summary"),
        "pipeline_status": F.when(has, "tier2_complete").otherwise(F.coalesce("_status", "pipeline_status")),
    }
    return leads.join(r, F.col("id") == F.col("_id"), "left").withColumns(new).drop("_id", "_status", "_o")


def llm_summary(tier1: Column, tier2: Column) -> Column:
    """What both stages told, without keys of stages that weren't run."""
    return F.to_json(F.struct(tier1.alias("tier1"), tier2.alias("tier2")), {"ignoreNullFields": "true"})
