"""URL functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts (and all below them) and first path parts that discovery never takes.
DENIED_HOSTS = (
    "angi.com", "angieslist.com", "bbb.org", "birdeye.com", "chamberofcommerce.com", "facebook.com", "foursquare.com",
    "healthgrades.com", "homeadvisor.com", "houzz.com", "instagram.com", "mapquest.com", "manta.com", "nextdoor.com",
    "opencare.com", "superpages.com", "thumbtack.com", "tripadvisor.com", "webmd.com", "yellowpages.com", "yelp.com", "zocdoc.com",
)
DENIED_PATHS = ("/search", "/find", "/directory", "/directories", "/listing", "/listings", "/profile", "/profiles", "/providers", "/business", "/biz")

#: Tokens that make an internal link useless, and what other tokens add to its score.
LINK_DENIED = (
    "privacy", "terms", "policy", "login", "sign in", "signin", "account", "cart", "checkout", "careers", "jobs", "blog", "news",
    "article", "tag/", "/feed",
)
LINK_SCORES = (
    (100, ("contact",)), (80, ("about", "our story", "company")), (70, ("service", "repair", "install")),
    (60, ("location", "areas", "service-area")), (40, ("team", "staff")), (20, ("faq", "financing")),
)

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(_col(c), _UPPER, _LOWER)


def scheme(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.trim(_col(u)), _SCHEME, 1))


def netloc(u: Column | str) -> Column:
    """Host with port and user, in lower case."""
    return F.lower(F.regexp_extract(F.trim(_col(u)), _SCHEME[:-3] + r"://([^/?#]*)", 2))


def host(u: Column | str) -> Column:
    """Host in lower case, empty where there is none."""
    return F.regexp_replace(F.regexp_replace(netloc(u), "^.*@", ""), ":[0-9]*$", "")


def path(u: Column | str) -> Column:
    return F.regexp_extract(F.trim(_col(u)), _SCHEME + r"[^/?#]*([^?#]*)", 2)


def domain_key(u: Column | str) -> Column:
    """Host without any leading ``www.``; null where there is no host."""
    return F.nullif(F.regexp_replace(host(u), r"^(www\.)+", ""), F.lit(""))


def host_denied(h: Column, denied: tuple[str, ...] = DENIED_HOSTS) -> Column:
    """F8: the host or one above it is on the list; a constant pattern, compiled once."""
    return F.regexp_replace(h, r"^(www\.)+", "").rlike("(^|\\.)(" + "|".join(x.replace(".", r"\.") for x in denied) + ")$")


def path_denied(p: Column, denied: tuple[str, ...] = DENIED_PATHS) -> Column:
    """F9."""
    return ascii_lower(p).rlike("^(" + "|".join(denied) + ")(/|$)")


def _canonical(u: Column | str) -> Column:
    s = scheme(u)
    place = F.when(s == "http", F.regexp_replace(netloc(u), ":80$", "")).otherwise(F.regexp_replace(netloc(u), ":443$", ""))
    return F.when(s.isin("http", "https") & (host(u) != ""), F.regexp_replace(F.concat(s, F.lit("://"), place, path(u)), "/+$", ""))


def site_url(u: Column | str) -> Column:
    """Canonical http(s) URL without query and fragment; null where denied or not a web URL."""
    return F.when(~host_denied(host(u)) & ~path_denied(path(u)), _canonical(u))


def link_target(u: Column | str) -> Column:
    """As ``site_url`` without the lists."""
    return _canonical(u)


def without_dots(p: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments worked off one by one; above the root is the root."""
    segments = F.split(p, "/")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
    ended = F.element_at(segments, -1).isin(".", "..")
    out = F.array_join(F.when(ended, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(p.rlike(r"/\.\.?(/|$)"), out).otherwise(p)


def resolve(base: Column | str, raw: Column | str) -> Column:
    """Absolute, protocol-relative, root-relative, query, fragment and plain relative references, dot segments worked off; null for none."""
    b, r = F.trim(_col(base)), F.trim(_col(raw))
    s, place, p = scheme(b), netloc(b), path(b)
    root = F.concat(s, F.lit("://"), place)
    folder = F.regexp_replace(F.when(p == "", F.lit("/")).otherwise(p), "[^/]*$", "")
    own = F.regexp_extract(r, "^[^?#]*", 0)
    rest = F.substring(r, F.length(own) + 1, F.length(r))
    return (
        F.when(r.isNull() | (r == "") | (s == ""), None)
        .when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), r)
        .when(r.startswith("//"), F.concat(s, F.lit(":"), r))
        .when(r.startswith("/"), F.concat(root, without_dots(own), rest))
        .when(r.startswith("?"), F.concat(root, p, r))
        .when(r.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), r))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def is_internal(base: Column | str, u: Column | str) -> Column:
    """Equal hosts; a subdomain is another host, and what has no host is never internal."""
    return F.coalesce((host(base) != "") & (host(base) == host(u)), F.lit(False))


def pick_url(final: Column | str, source: Column | str) -> Column:
    """X7."""
    return F.coalesce(F.nullif(_col(final), F.lit("")), _col(source), F.lit(""))


def console_host(u: Column | str) -> Column:
    """Host, or the text itself where it is no URL."""
    return F.coalesce(F.nullif(host(u), F.lit("")), _col(u))


def _has(text: Column, tokens: tuple[str, ...]) -> Column:
    """One constant pattern for all tokens: compiled once, and little code."""
    return text.rlike("|".join(re.escape(t) for t in tokens))


def link_score(p: Column, label: Column, denied: tuple[str, ...] = LINK_DENIED, scores: tuple[tuple[int, tuple[str, ...]], ...] = LINK_SCORES) -> Column:
    """What a link's path and label promise; -1 where a denied token occurs, else the sum over groups."""
    joined = F.concat_ws(" ", p, label)
    total = F.lit(0)
    for points, tokens in scores:
        total = total + F.when(_has(joined, tokens), points).otherwise(0)
    return F.when(_has(joined, denied), -1).otherwise(total)
