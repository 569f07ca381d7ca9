"""Crawl compliance as column expressions (F1-F7, S5 and S6 limits)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.functions.urls import ascii_lower, host, scheme

#: Bytes of a page and of a root file, and redirects, that a fetch may take at most.
PAGE_BYTES, ROOT_FILE_BYTES, REDIRECTS = 2_000_000, 250_000, 5
#: IPv4 ranges that must never be fetched, as one pattern: unspecified, private, shared, loopback, link-local,
#: documentation, benchmarking, multicast and reserved.
CLOSED_IPV4 = (
    r"^(0\.0\.0\.0$|10\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.0\.2\.|192\.168\."
    r"|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|22[4-9]\.|2[3-5]\d\.)"
)
CLOSED_IPV6 = ("::1/128", "::/128", "ff00::/8", "fc00::/7", "fe80::/10", "2001:db8::/32")


def robots_disallow_all(body: Column | str, agent: str) -> Column:
    """whether a robots.txt closes the whole site to everyone or to ``agent``.

    The last user-agent line before a rule decides whom it is for; comments and blanks don't count; only
    ``disallow: /`` is looked at. A fold over the lines, in the JVM.
    """
    body = F.col(body) if isinstance(body, str) else body
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(ascii_lower(x), "(?s)#.*$", "")))
    start = F.struct(F.lit(False).alias("mine"), F.lit(False).alias("closed"))

    def step(acc: Column, line: Column) -> Column:
        who = F.trim(F.substring(line, 12, 1_000_000))
        names = line.startswith("user-agent:")
        rule = line.startswith("disallow:") & (F.trim(F.substring(line, 10, 1_000_000)) == "/")
        return F.struct(
            F.when(names, who.isin("*", agent.lower())).otherwise(acc["mine"]).alias("mine"),
            (acc["closed"] | (~names & acc["mine"] & rule)).alias("closed"),
        )

    return F.aggregate(lines, start, step)["closed"]


def crawl_eligibility(robots: Column | str, agent: str) -> Column:
    """struct<allowed, reason> from the robots.txt struct; one that is null or missing allows."""
    robots = F.col(robots) if isinstance(robots, str) else robots
    closed = F.coalesce(robots["exists"], F.lit(False)) & robots_disallow_all(robots["body"], agent)
    return F.struct((~closed).alias("allowed"), F.when(closed, "robots_txt_disallow_all").otherwise("").alias("reason"))


def is_ipv4(h: Column) -> Column:
    return h.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")


def ipv4_closed(h: Column | str) -> Column:
    """private, local, shared, test, multicast and reserved addresses."""
    h = F.col(h) if isinstance(h, str) else h
    return F.coalesce(is_ipv4(h) & h.rlike(CLOSED_IPV4), F.lit(False))


def ipv6_hex(h: Column | str) -> Column:
    """an IPv6 address (in brackets or not, with a zone, with an IPv4 address at its end) as 32 hexadecimal digits; null for anything else."""
    h = F.col(h) if isinstance(h, str) else h
    low = F.regexp_replace(ascii_lower(F.regexp_replace(h, r"^[\[\]]+|[\[\]]+$", "")), "%[^%]+$", "")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = rf"(?<=:){octet}\.{octet}\.{octet}\.{octet}$"
    two = lambda i: F.lpad(F.lower(F.conv(F.regexp_extract(low, v4, i), 10, 16)), 2, "0")
    head = F.regexp_replace(low, v4, "")
    low = F.when(low.rlike(v4), F.concat(head, two(1), two(2), F.lit(":"), two(3), two(4))).otherwise(low)
    halves = F.split(low, "::")
    groups = lambda half: F.when(half == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(half, ":"))
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.expr("cast(array() as array<string>)"))
    n = F.size(left) + F.size(right)
    fits = F.when(F.size(halves) == 1, n == 8).otherwise((F.size(halves) == 2) & (n < 8)) & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    full = lambda half: F.array_join(F.transform(half, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(fits, F.concat(full(left), F.repeat(F.lit("0000"), 8 - n), full(right)))


def network_pattern(network: str) -> str:
    """A regular expression for the hexadecimal digits of the addresses in an IPv6 network."""
    net = ipaddress.IPv6Network(network)
    whole, bits = divmod(net.prefixlen, 4)
    digits = net.network_address.exploded.replace(":", "")
    if not bits:
        return digits[:whole]
    low = int(digits[whole], 16)
    return digits[:whole] + "[" + "".join(f"{x:x}" for x in range(low, low + (1 << 4 - bits))) + "]"


def ipv6_closed(h: Column | str) -> Column:
    """closed IPv6 addresses, with or without brackets; false for anything else."""
    return F.coalesce(ipv6_hex(h).rlike("^(" + "|".join(map(network_pattern, CLOSED_IPV6)) + ")"), F.lit(False))


def _bits(digits: Column) -> Column:
    """Hexadecimal digits as so many times four zeros and ones."""
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def longest_prefix(addresses: DataFrame, networks: DataFrame, address: str = "ip") -> DataFrame:
    """F4 against a table: every address row with ``network``, the smallest one (network: IPv6 prefix/length) that it is in, or null.

    Each address becomes its prefixes of the lengths that the table has (129 at most), so that the search is an
    equi-join however many networks there are. Networks and addresses that are none match nothing.
    """
    parts = networks.select("network", F.split("network", "/").alias("p")).select("network", ipv6_hex(F.get("p", F.lit(0))).alias("digits"), F.get("p", F.lit(1)).try_cast("int").alias("size"))
    held = parts.where(F.col("digits").isNotNull() & F.col("size").between(0, 128)).select("network", "size", F.expr("size as _size"), _bits(F.col("digits")).alias("bits"))
    held = held.select("network", F.col("_size"), F.substring(F.col("bits"), F.lit(1), F.col("size")).alias("_prefix")).dropDuplicates(["_size", "_prefix"])
    sizes = sorted(r._size for r in held.select("_size").distinct().collect())
    told = addresses.select(F.col(address).alias("_ip")).distinct().select("_ip", _bits(ipv6_hex("_ip")).alias("_bits")).where("_bits is not null")
    tried = told.select("_ip", "_bits", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.expr("cast(array() as array<int>)")).alias("_size"))
    found = tried.select("_ip", "_size", F.substring(F.col("_bits"), F.lit(1), F.col("_size")).alias("_prefix")).join(held, ["_size", "_prefix"])
    best = found.groupBy("_ip").agg(F.max_by("network", "_size").alias("network"))
    return addresses.join(best, F.col(address) == F.col("_ip"), "left").drop("_ip")


def hostname_closed(h: Column | str) -> Column:
    """names of the machine itself, of the local net and of cloud metadata."""
    low = ascii_lower(F.trim(F.col(h) if isinstance(h, str) else h))
    return low.isin("localhost", "metadata.google.internal") | low.endswith(".localhost") | low.endswith(".local")


def fetch_verdict(u: Column | str) -> Column:
    """why a URL must not be fetched, or null. (Names are not resolved here.)"""
    h, s = host(u), scheme(u)
    return (
        F.when(s == "", "invalid_url")
        .when(~s.isin("http", "https"), F.concat(F.lit("unsupported_scheme: "), s))
        .when(h == "", "missing_host")
        .when(hostname_closed(h), F.concat(F.lit("disallowed_hostname: "), h))
        .when(ipv4_closed(h), F.concat(F.lit("disallowed_ip: "), h))
    )


def supported_content_type(c: Column | str) -> Column:
    """F7."""
    return F.coalesce(ascii_lower(c).rlike(r"^(text/html|application/xhtml\+xml)"), F.lit(False))


def fetch_within_limits(size: Column, redirects: Column, content_type: Column) -> Column:
    """A landed page that a fetch would have kept."""
    return (size <= PAGE_BYTES) & (redirects <= REDIRECTS) & supported_content_type(content_type)


def root_file(path: str, status: Column, content_type: Column, body: Column) -> Column:
    """The struct of a landed root file; null where nothing was fetched or it is too long."""
    exists = status.between(200, 299)
    return F.when(
        status.isNotNull() & (F.octet_length(F.coalesce(body, F.lit(""))) <= ROOT_FILE_BYTES),
        F.struct(F.lit(path).alias("path"), status.alias("http_status"), exists.alias("exists"), content_type.alias("content_type"), body.alias("body")),
    )
