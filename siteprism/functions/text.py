"""Functions of visible text as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteprism.functions.urls import ascii_lower

#: Phrases of parked domains and of page signals, and keywords of categories in order.
PARKED = ("this domain is for sale", "buy this domain", "parked free", "under construction", "coming soon")
BOOKING = ("book now", "schedule", "reserve", "appointment", "calendly")
CALL_TO_ACTION = ("free estimate", "request quote", "contact us", "get a quote", "call now")
HOURS = ("hours", "open today")
REVIEWS = ("testimonial", "testimonials", "review", "reviews")
CATEGORIES = (
    ("hvac", ("hvac", "heating", "cooling", "air conditioning", "furnace")),
    ("plumbing", ("plumb", "plumbing", "water heater", "drain cleaning")),
    ("dentist", ("dentist", "dental", "teeth cleaning", "orthodontic")),
    ("auto_detailing", ("auto detailing", "ceramic coating", "paint correction", "car detail")),
    ("roofing", ("roofing", "roofer", "roof repair", "roof replacement")),
    ("landscaping", ("landscaping", "lawn care", "hardscape", "irrigation")),
)
#: Titles that name no company, and phrases that no company name holds.
GENERIC_TITLES = ("home", "welcome", "index", "untitled", "untitled document", "new page", "page not found", "404", "403", "error")
NO_NAME = ("call us", "contact us", "request service", "book now", "learn more", "read more", "click here", "home", "welcome")
#: Patterns of e-mail addresses, phone numbers, postal addresses and copyright lines.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}"
#: What every such number ends in.
PHONE_END = r"\d{3}[\s\-.]?\d{4}"
STREET_NUMBER = r"\b\d{1,6}\b"
STREET_TYPE = r"(?i)\b(st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|ln|lane|ct|court|way|pkwy|parkway|pl|place)\b"
CITY_STATE_ZIP = r"(?i)\b[a-z .'-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"
NO_ADDRESS = ("copyright", "all rights reserved", "call us", "request service", "contact us", "license")
COPYRIGHT = r"(?i)(?:copyright|©)\s*(20\d{2})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_any(text: Column | str, phrases: tuple[str, ...]) -> Column:
    """The text in ASCII lower case holds one of the phrases."""
    return holds_any(ascii_lower(text), phrases)


def holds_any(low: Column | str, phrases: tuple[str, ...]) -> Column:
    """The same for a text that is in lower case already: plain searches, no regular expression."""
    return F.coalesce(reduce(Column.__or__, [F.contains(_col(low), F.lit(p)) for p in phrases]), F.lit(False))


def squeeze(c: Column | str) -> Column:
    """White space made single, and trimmed; Unicode spaces too."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def word_count(c: Column | str) -> Column:
    """A15."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(r"(?U)\S+")), F.lit(0))


def email(c: Column | str) -> Column:
    """The first address in the text, or empty."""
    return F.coalesce(F.regexp_extract(_col(c), f"({EMAIL})", 1), F.lit(""))


def clean_phone(c: Column | str) -> Column:
    """H7: ten digits of a candidate, or empty; a leading 1 of eleven goes."""
    head = F.regexp_replace(F.trim(_col(c)), r"^(tel:)+", "")
    digits = F.regexp_replace(F.regexp_extract(head, r"^([^;?]*)", 1), r"[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(F.length(digits) == 10, digits).otherwise("")


def phone(c: Column | str) -> Column:
    """H7: the first number in the text, cleaned."""
    return F.coalesce(clean_phone(F.regexp_extract(_col(c), f"({PHONE})", 1)), F.lit(""))


def category(c: Column | str, groups: tuple[tuple[str, tuple[str, ...]], ...] = CATEGORIES) -> Column:
    """The first group with a keyword in the text, or empty."""
    out = None
    for name, words in groups:
        out = F.when(has_any(c, words), name) if out is None else out.when(has_any(c, words), name)
    return out.otherwise("")


def copyright_year(c: Column | str) -> Column:
    """The first year after a copyright mark, or 0."""
    return F.coalesce(F.regexp_extract(_col(c), COPYRIGHT, 1).try_cast("int"), F.lit(0))


def generic_title(c: Column | str) -> Column:
    """F21."""
    low = ascii_lower(c)
    return low.rlike("^(" + "|".join(GENERIC_TITLES) + r")($| \|)")


def company_candidate(c: Column | str) -> Column:
    """a text that may name a company."""
    text = squeeze(c)
    size = F.octet_length(text)
    fits = size.between(3, 80) & (F.regexp_count(text, F.lit(" ")) <= 8) & (F.regexp_count(text, F.lit("[0-9]")) < 4)
    return F.coalesce(fits & ~generic_title(text) & ~has_any(text, NO_NAME), F.lit(False))


def postal_address(c: Column | str) -> Column:
    """a text that looks like a postal address."""
    text = _col(c)
    looks = (text.rlike(STREET_NUMBER) & text.rlike(STREET_TYPE)) | text.rlike(CITY_STATE_ZIP)
    return F.coalesce(looks & ~has_any(text, NO_ADDRESS), F.lit(False))


def title_company(c: Column | str) -> Column:
    """H8, last step: the title's head before a bar, hyphen, dash or colon, where it may name a company."""
    head = squeeze(F.regexp_extract(squeeze(c), r"^([^|\-—:]*)", 1))
    return F.when(company_candidate(head), head).otherwise("")


def truncated(c: Column | str, limit: int = 200) -> Column:
    """At most ``limit`` characters, the last three dots where cut."""
    text = _col(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))
