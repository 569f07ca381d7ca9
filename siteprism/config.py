"""Settings of an evaluation, and how text from the environment becomes them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

CAMPAIGNS = ("website_modernization", "voice_ai_agent", "smma")
#: Other names of campaigns.
CAMPAIGN_ALIASES = {
    "website": "website_modernization",
    "website_creation": "website_modernization",
    "website_rebuild": "website_modernization",
    "voice_ai": "voice_ai_agent",
    "voice_agent": "voice_ai_agent",
    "voice_ai_agent": "voice_ai_agent",
    "smma": "smma",
    "social_media_management": "smma",
    "social_media_marketing": "smma",
}


def campaign_type(value: str | None) -> str:
    """X11: a campaign by any of its names; unknown names come back normalised."""
    if not value:
        return CAMPAIGNS[0]
    name = "_".join(re.findall("[a-z0-9]+", value.lower()))
    return CAMPAIGN_ALIASES.get(name, name)


def truthy(value: str | None) -> bool:
    """X12."""
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


def number(value: str | None, default: float) -> float:
    """X12."""
    try:
        return default if value is None else float(value)
    except ValueError:
        return default


def listed(value: str | None) -> tuple[str, ...]:
    """Comma-separated, trimmed, in lower case, without blanks."""
    return tuple(x.strip() for x in (value or "").lower().split(",") if x.strip())


@dataclass(frozen=True)
class Config:
    """What an evaluation runs with. ``as_of_year`` stands for the clock, so that results repeat."""

    campaign: str = CAMPAIGNS[0]
    as_of_year: int = 2026
    min_words: int = 150
    llm_enabled: bool = False
    signals_v2: bool = False
    scoring_v2: bool = False
    tier1_enabled: bool = True
    tier2_enabled: bool = True
    tier1_min_score: float = 0.55
    tier1_model: str = "tier1-model"
    tier2_model: str = "tier2-model"
    tier1_campaigns: tuple[str, ...] = ()
    tier1_industries: tuple[str, ...] = ()
    tier2_campaigns: tuple[str, ...] = ()
    tier2_industries: tuple[str, ...] = ()
    robots_agent: str = "siteprism"

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "SITEPRISM_") -> Config:
        get = lambda k, d=None: env.get(prefix + k, d)
        return cls(
            campaign=campaign_type(get("CAMPAIGN")),
            llm_enabled=truthy(get("LLM")), signals_v2=truthy(get("SIGNALS_V2")), scoring_v2=truthy(get("SCORING_V2")),
            tier1_enabled=get("TIER1_ENABLED", "true").lower() != "false", tier2_enabled=get("TIER2_ENABLED", "true").lower() != "false",
            tier1_min_score=number(get("TIER1_MIN_SCORE"), 0.55),
            tier1_campaigns=listed(get("TIER1_CAMPAIGNS")), tier1_industries=listed(get("TIER1_INDUSTRIES")),
            tier2_campaigns=listed(get("TIER2_CAMPAIGNS")), tier2_industries=listed(get("TIER2_INDUSTRIES")),
        )


@dataclass(frozen=True)
class RunRequest:
    """a request for a run, checked when it is made."""

    target_industry: str = ""
    target_location: str = ""
    direct_url: str = ""
    candidate_limit: int = 10
    max_pages: int = 5
    campaign: str = CAMPAIGNS[0]
    llm_enabled: bool = False
    input_mode: str = field(default="discover")

    def __post_init__(self) -> None:
        if self.input_mode == "url":
            if not re.match(r"https?://[^/\s]+", self.direct_url):
                raise ValueError("direct_url must be an http(s) URL")
        elif not self.target_industry.strip() or not self.target_location.strip():
            raise ValueError("target_industry and target_location must not be empty")
        if not 1 <= self.candidate_limit <= 50:
            raise ValueError("candidate_limit must be 1 to 50")
        if not 1 <= self.max_pages <= 10:
            raise ValueError("max_pages must be 1 to 10")
