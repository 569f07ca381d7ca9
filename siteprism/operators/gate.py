"""The heuristic gate as one ordered CASE, and the registry of campaign evaluators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.config import CAMPAIGNS, Config

#: Site builders whose assets reject a lead, in the order in which they are tried.
REJECTED_BUILDERS = {"website_modernization": (r"squarespace\.com", r"cdn\.shopify\.com", r"wix\.com", r"weebly\.com"), "voice_ai_agent": (), "smma": ()}

#: Functions from nothing to named flag columns, by campaign; ``register_evaluator`` adds to them.
EVALUATORS: dict[str, list[Callable[[], dict[str, Column]]]] = {c: [] for c in CAMPAIGNS}


def register_evaluator(campaign: str) -> Callable[[Callable[[], dict[str, Column]]], Callable[[], dict[str, Column]]]:
    def add(f: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
        EVALUATORS[campaign].append(f)
        return f

    return add


def asset_urls() -> Column:
    """The URLs of a lead's scripts and stylesheets."""
    empty = F.expr("cast(array() as array<string>)")
    return F.concat(F.coalesce(F.col("script_srcs.url"), empty), F.coalesce(F.col("stylesheet_hrefs.url"), empty))


@register_evaluator("website_modernization")
def modernization_flags() -> dict[str, Column]:
    """Viewport and a blog engine's paths."""
    return {
        "missing_mobile_viewport": ~F.coalesce(F.col("has_viewport"), F.lit(False)),
        "is_wordpress": F.exists(asset_urls(), lambda u: u.contains("wp-content") | u.contains("wp-includes")),
    }


def _finds(pattern: str) -> Callable[[Column], Column]:
    return lambda u: u.rlike("(?i)" + pattern)


def rejection_signature(campaign: str) -> Column:
    """the first of the campaign's patterns found in any asset URL, or null."""
    hits = [F.when(F.exists(asset_urls(), _finds(p)), F.lit(p)) for p in REJECTED_BUILDERS[campaign]]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def gate(leads: DataFrame, config: Config) -> DataFrame:
    """adds gate_status and gate_flags; ``pending_tier_1`` passes.

    Compliance first, then words, parking, site builder. ValueError for an unknown campaign. Flags gather up to
    the gate that rejects; a campaign's evaluators run only on what passes.
    """
    if config.campaign not in REJECTED_BUILDERS:
        raise ValueError(f"unknown campaign {config.campaign}")
    words, parked = F.coalesce(F.col("word_count"), F.lit(0)), F.coalesce(F.col("is_parked_domain"), F.lit(False))
    signature = rejection_signature(config.campaign)
    status = (
        F.when(F.col("crawl_allowed") == F.lit(False), "rejected_compliance")
        .when(words < config.min_words, "rejected_heuristic_low_word_count")
        .when(parked, "rejected_heuristic_parked_domain")
        .when(signature.isNotNull(), "rejected_heuristic_campaign_mismatch")
        .otherwise("pending_tier_1")
    )
    out = leads.withColumn("gate_status", status)
    reached = lambda *s: F.col("gate_status").isin(*s)
    flags = [
        F.when(~reached("rejected_compliance"), F.lit(config.campaign)).alias("campaign"),
        F.when(~reached("rejected_compliance"), words).alias("word_count"),
        F.when(reached("rejected_heuristic_parked_domain"), F.lit(True)).alias("parked_domain"),
        F.when(reached("rejected_heuristic_campaign_mismatch"), signature).alias("rejection_signature"),
    ]
    for f in EVALUATORS[config.campaign]:
        flags += [F.when(reached("pending_tier_1"), c).alias(k) for k, c in f().items()]
    return out.withColumn("gate_flags", F.struct(*flags))
