"""Column functions, on inline rows with the true token lists."""

import re

from pyspark.sql import functions as F

from siteprism.functions import text, urls
from siteprism.functions.html import signals_of
from siteprism.operators import compliance
from siteprism.sources.leads import json_object


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_urls(spark):
    assert one(spark, ["https://WWW.www.Acme.com:8080/a", "no url", None], urls.domain_key) == ["acme.com", None, None]
    sites = ["HTTPS://www.Acme.com:443/A/?q=1#f", "http://en.yelp.com/x", "http://notyelp.com/", "https://a.com/search/x", "https://a.com/about-search", "ftp://a.com/", "bad"]
    assert one(spark, sites, urls.site_url) == ["https://www.acme.com/A", None, "http://notyelp.com", None, "https://a.com/about-search", None, None]
    joined = one(spark, ["/x", "//b.com/y", "?q", "z", "http://c.com", "", None], lambda v: urls.resolve(F.lit("https://a.com/d/e?o"), v))
    assert joined == ["https://a.com/x", "https://b.com/y", "https://a.com/d/e?q", "https://a.com/d/z", "http://c.com", None, None]
    score = one(spark, ["/contact", "/about-company", "/privacy", "/x", "/service-areas"], lambda v: urls.link_score(v, F.lit("")), "string")
    assert score == [100, 80, -1, 0, 130]


def test_text(spark):
    assert one(spark, ["tel:+1-503-555-1234", "503.555.1234;ext=1", "12345", None], text.clean_phone) == ["5035551234", "5035551234", "", ""]
    assert one(spark, ["call (503) 555-1234 now", "none"], text.phone) == ["5035551234", ""]
    assert one(spark, ["We fix a Furnace", "roofer", "x"], text.category) == ["hvac", "roofing", ""]
    assert one(spark, ["© 2019 Acme", "Copyright 2021, 2024", "1999"], text.copyright_year) == [2019, 2021, 0]
    assert one(spark, ["Acme Heating", "Home | Acme", "Welcome", "ab", "call us", "1 2 3 4 5"], text.company_candidate) == [True, False, False, False, False, False]
    assert one(spark, ["12 Main Street", "Salem, OR 97301", "Main Street", "Copyright 12 Main St"], text.postal_address) == [True, True, False, False]
    assert one(spark, ["x" * 201, "x" * 200], lambda v: F.length(text.truncated(v))) == [200, 200]


def test_compliance(spark):
    bodies = ["User-agent: *\nDisallow: /", "User-agent: x\nDisallow: /", "User-agent: *\nUser-agent: x\nDisallow: /", "", None]
    assert one(spark, bodies, lambda v: compliance.robots_disallow_all(v, "siteprism")) == [True, False, False, False, False]
    ips = ["10.1.2.3", "8.8.8.8", "172.31.0.1", "172.32.0.1", "100.64.0.1", "203.0.113.9", "255.255.255.255", "1.2.3"]
    assert one(spark, ips, compliance.ipv4_closed) == [True, False, True, False, True, True, True, False]
    assert one(spark, ["[::1]", "2606:4700::1", "fd00::1", "x", None], compliance.ipv6_closed) == [True, False, True, False, False]
    verdicts = one(spark, ["http://localhost/", "https://a.com", "file:///x", "x"], compliance.fetch_verdict)
    assert verdicts == ["disallowed_hostname: localhost", None, "unsupported_scheme: file", "invalid_url"]


def test_json_object(spark):
    assert one(spark, ['{"a": 1}', "[1]", "bad", None], json_object) == [{"a": "1"}, {}, {}, {}]


def test_page_signals():
    page = (
        '<html><head><title>Acme | Home</title><meta name="viewport" content="w"></head><body><h1>Acme Plumbing</h1><form></form>'
        '<a href="mailto:a@b.com?x">Mail</a> <a href="/contact">Reach us</a> <a href="https://facebook.com/acme">f</a>'
        '<script type="application/ld+json">{"@type": "Plumber"}</script><p>Request a quote. Book now. Open today.</p><footer>© 2024</footer>'
    )
    s = signals_of(page, "https://acme.com/")
    assert (s["company_name"], s["email_address"], s["schema_org_business_type"], s["copyright_year"]) == ("Acme Plumbing", "a@b.com", "Plumber", 2024)
    assert s["has_viewport"] and s["has_form"] and s["has_booking_signal"] and s["has_hours_signal"] and s["has_contact_page"] and not s["has_cta_signal"]
    assert (s["outbound_domain_count"], s["social_facebook"], s["category"]) == (1, "https://facebook.com/acme", "plumbing")
    assert signals_of(None, "")["word_count"] == 0


def test_ipv6(spark):
    """Every address as the standard library reads it, and the smallest network that each is in."""
    import ipaddress
    import random

    rng = random.Random(5)
    some = ["::", "::1", "1::", "[::1]", "fe80::1%eth0", "fe80::1%", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.256", "::01.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":1::", "1:::2", "12345::", "g::", "", None, ":", "::%", "1.2.3.4", "FE80::ABCD", ":::", "[[::1", "::1]"]
    for _ in range(300):
        ip = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 2**64 - 1, (2**128 - 1) << 100, 0xFFFF]))
        some += rng.sample([ip.compressed, ip.exploded, ip.compressed.upper(), ip.compressed[:-1] + ":"], 2)

    def wanted(text):
        try:
            return f"{int(ipaddress.IPv6Address((text or '').strip('[]'))):032x}"
        except ValueError:
            return None

    assert one(spark, some, compliance.ipv6_hex) == [wanted(x) for x in some]
    nets = [ipaddress.IPv6Network((rng.getrandbits(128) >> 100 << 100, n), strict=False) for n in (3, 7, 12, 20, 28) for _ in range(4)] + [ipaddress.IPv6Network(n) for n in compliance.CLOSED_IPV6]
    for n in nets:
        assert all(re.match(compliance.network_pattern(str(n)), n[i].exploded.replace(":", "")) for i in (0, -1))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "k int, ip string")
    got = {r.k: r.network for r in compliance.longest_prefix(df, spark.createDataFrame([(str(n),) for n in nets] + [("x/3",), ("::/129",), (None,)], "network string")).collect()}
    for k, x in enumerate(some):
        held = [n for n in nets if wanted(x) and ipaddress.IPv6Address(int(wanted(x), 16)) in n]
        best = max((n.prefixlen for n in held), default=None)
        assert (got[k] is None and best is None) or ipaddress.IPv6Network(got[k]) in [n for n in held if n.prefixlen == best]


def test_references(spark):
    """References as the standard library resolves them."""
    from urllib.parse import urljoin

    refs = ["../x", "./x", "x/./y/../z", "../../../x", ".", "..", "./", "../", "a/..", "a/.", "...", ".x", "x.", "/../a/./b/../c", "?q=../x", "#f/../g", "a?b=/../c", "g;x=1/../y", "/", "//h/a", "", "a/b/../../.."]
    for base in ("https://a.example/b/c/d?q#f", "https://a.example", "https://a.example/", "http://a.example/b/"):
        assert one(spark, refs, lambda r, b=base: urls.resolve(F.lit(b), r)) == [urljoin(base, r) if r else None for r in refs], base
    # an empty segment is one of its own, as the standard (not the library) has it
    assert one(spark, ["x//../y"], lambda r: urls.resolve(F.lit("https://a.example/b/"), r)) == ["https://a.example/b/x/y"]
