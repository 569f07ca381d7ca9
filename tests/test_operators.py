"""Resolver, blocklist, matcher, warehouse and packs on inline rows."""

import random
import re

import pytest

from siteprism.config import Config, RunRequest, campaign_type, listed
from siteprism.operators import match, prefilter, resolve, tiers, warehouse
from siteprism.sources import packs

FOUND = "lead string, seq int, name string, pack string, categories array<int>, confidence int, version string, source string, pattern_id string"
EDGE = packs.EDGE


def found(spark, *rows):
    return spark.createDataFrame([("l", i, n, "p", c, conf, v, s, "x") for i, (n, c, conf, v, s) in enumerate(rows)], FOUND)


def names(df):
    return sorted(r.name for r in df.collect())


def test_resolver(spark):
    edge = spark.createDataFrame([("A", "excludes", "B", None, 0), ("B", "excludes", "A", None, 0), ("C", "requires", "D", None, 0), ("E", "requires", "C", None, 0), ("F", "requires_category", None, 9, 0), ("G", "implies", "H", None, 0)], EDGE)
    tech = spark.createDataFrame([("H", "z", [5])], "name string, pack string, categories array<int>")
    rows = found(spark, *[(n, [1], 90, None, "html") for n in "ABCEFG"])
    assert names(resolve.excludes(rows, edge)) == ["C", "E", "F", "G"]
    assert names(resolve.requires(rows, edge)) == ["A", "B", "G"]
    with_category = found(spark, ("F", [1], 90, None, "html"), ("X", [9], 90, None, "html"))
    assert names(resolve.requires(with_category, edge)) == ["F", "X"]
    implied = resolve.implies(rows, edge, tech).where("name = 'H'").first()
    assert (implied.pack, implied.confidence, implied.pattern_id) == ("z", 50, "implied:G->H")
    twice = found(spark, ("A", [], 20, None, "html"), ("A", [], 90, None, "html"), ("A", [], 90, "1", "html"))
    assert resolve.best(twice).first().version == "1"


def test_blocklist(spark, tmp_path):
    block = packs.blocklist()
    rows = spark.createDataFrame([("l", 0, "Cloudflare", "wappalyzer", [], 100, None, "headers", "x"), ("m", 0, "jQuery", "wappalyzer", [], 100, None, "html", "x"), ("n", 0, "Cloudflare", "wappalyzer", [], 100, None, "cookies", "x"), ("n", 1, "jQuery", "wappalyzer", [], 20, None, "html", "x")], FOUND)
    got = {(r.lead, r.name): r.confidence for r in resolve.apply_blocklist(rows, *block.frames(spark)).collect()}
    assert got == {("l", "Cloudflare"): 30, ("n", "Cloudflare"): 100, ("n", "jQuery"): 20}
    assert packs.blocklist(tmp_path / "none.yaml").rules == []


def test_matcher_forms_agree(spark):
    pack = packs.default_pack()
    text = "jquery-3.6.0.min.js <link rel=x href=/wp-content/y> begin mailchimp signup form"
    stacks = spark.createDataFrame([("l", "html", None, "raw_html", text), ("l", "meta", "generator", "meta[generator]", "WordPress 6.1"), ("l", "script_src", None, "s", "https://c.com/jquery-3.6.0.min.js")], "lead string, source string, qualifier string, field string, text string")
    key = lambda df: sorted((r.name, r.source, r.pattern_id, r.version or "", r.matched_value) for r in df.collect())
    a, b = key(match.match_generated(stacks, pack.pattern)), key(match.match_batched(stacks, pack.pattern))
    assert a == b
    assert ("jQuery", "script_src", "wappalyzer:jQuery:script_src#0", "3.6.0", "jquery-3.6.0.min.js") in a
    assert sorted(x[:3] for x in key(match.match_joined(stacks, packs.tables(spark, pack)[1]))) == sorted(x[:3] for x in a)


NO_LEAD = {"id": "", "final_url": "https://a.example/", "source_url": "https://a.example/", "raw_html": "<p>x</p>", "text_content": "x", "script_srcs": [], "stylesheet_hrefs": [], "response_headers": [("Server", "nginx")], "meta_lines": [], "robots_txt": (True, "User-agent: *")}
LEAD = "id string, final_url string, source_url string, raw_html string, text_content string, script_srcs array<struct<url:string>>, stylesheet_hrefs array<struct<url:string>>, response_headers array<struct<key:string,value:string>>, meta_lines array<string>, robots_txt struct<exists:boolean,body:string>"
#: What a site sends, and the technologies that must be told from it; the last three are sites of which nothing must be told.
SITES = {
    "wordpress": ({"script_srcs": [("/wp-content/plugins/contact-form-7/i.js",)], "response_headers": [("X-Powered-By", "PHP/8.1"), ("X-Pingback", "https://a.example/xmlrpc.php")]}, {"WordPress", "Contact Form 7", "PHP", "MySQL"}),
    "squarespace": ({"response_headers": [("Server", "Squarespace")], "script_srcs": [("https://static1.squarespace.com/universal/scripts-compressed/commerce-1.js",)]}, {"Squarespace", "Squarespace Commerce"}),
    "shopify": ({"script_srcs": [("https://cdn.shopify.com/s/a.js",)], "response_headers": [("X-ShopId", "1"), ("Set-Cookie", "_shopify_y=a; Path=/")]}, {"Shopify"}),
    "wix": ({"script_srcs": [("https://static.parastorage.com/a.js",)], "meta_lines": ["generator=Wix.com Website Builder"]}, {"Wix", "React"}),
    "hubspot": ({"response_headers": [("x-hs-hub-id", "1")], "script_srcs": [("https://js.hs-analytics.net/a.js",)]}, {"HubSpot", "HubSpot CMS Hub", "HubSpot Analytics"}),
    "calendly": ({"script_srcs": [("https://assets.calendly.com/w.js",)]}, {"Calendly"}),
    "mailchimp": ({"raw_html": "<!-- Begin MailChimp Signup Form --><form></form>"}, {"MailChimp"}),
    "stripe": ({"script_srcs": [("https://js.stripe.com/v3/",)], "response_headers": [("Set-Cookie", "__stripe_mid=a; Path=/")]}, {"Stripe"}),
    "all": ({"script_srcs": [("/wp-includes/a.js",), ("https://www.googletagmanager.com/gtm.js?id=1",), ("https://code.jquery.com/jquery-3.6.0.min.js",)], "stylesheet_hrefs": [("/bootstrap.min.css",)], "response_headers": [("CF-Ray", "1")]}, {"WordPress", "PHP", "MySQL", "Google Tag Manager", "jQuery", "Bootstrap", "Cloudflare"}),
    "plain": ({}, set()), "parked": ({"raw_html": "<h1>This domain is for sale</h1>"}, set()), "alone": ({"script_srcs": [("/jquery-1.2.min.js",)]}, set()),
}


def test_sites(spark):
    rows = [tuple((NO_LEAD | own | {"id": name}).values()) for name, (own, _) in SITES.items()]
    found = match.match_leads(spark.createDataFrame(rows, LEAD), packs.overridden(packs.fingerprint_pack(), packs.fingerprint_pack(packs.HERE / "local", "local_biz")), packs.blocklist()).collect()
    assert {name: {r.name for r in found if r.lead == name} for name in SITES} == {name: want for name, (_, want) in SITES.items()}
    assert all(r.confidence >= 80 for r in found if r.source not in ("implied", "headers") and r.name not in ("jQuery", "Bootstrap")) and {r.confidence for r in found if r.name == "Cloudflare"} == {30}


def test_required_literals():
    """What every match must hold: never more than the pattern asks for, and as much as its tree tells."""
    wanted = {
        r"static\d*\.squarespace\.com/": {".squarespace.com/"}, r"ab?cdef\w+ghi": {"cdef"}, r"x\.y+zzz": {"zzz"}, r"\s*plain\s?text": {"plain"}, "a(b|c)": set(), "(?:jquery|zepto)[.-]min": {"jquery", "zepto"},
        "(foobar|foobaz)": {"fooba"}, "pre(?:mid)+post": {"premid"}, "(?:abc)?defg": {"defg"}, "(?=abcdef)xyz": {"xyz"}, "[a]bcd": {"abcd"}, r"^abc\b def$": {"abc def"}, "(?:ab|c)defg|hijk": {"defg", "hijk"}, "": set(), "(": set(), "é(?:wörter)": {"rter"},
        r"(?i)CDN\.Example": {"cdn.example"}, "(?:abc){0}d": set(), "a|bcdef": set(),
    }
    assert {p: set(prefilter.required(p)) for p in wanted} == wanted


def test_prefilter_never_loses(monkeypatch):
    """3,000 random patterns over random texts: candidates hold all that match, few else, by both automata."""
    rng = random.Random(8)
    word = lambda n=6: "".join(rng.choice("abcdefgkis.-_/") for _ in range(rng.randint(3, n)))
    words = [word() for _ in range(400)]
    made = [lambda w: re.escape(w), lambda w: re.escape(w) + r"\d*", lambda w: f"(?:{re.escape(w)}|{re.escape(rng.choice(words))})x?", lambda w: f"^.*{re.escape(w)}\\b", lambda w: f"[{w[0] if w[0].isalpha() else 'a'}x]{re.escape(w)}+", lambda w: f"(?:{re.escape(w)})?{re.escape(word(9))}", lambda w: r"\w{2}"]
    patterns = [rng.choice(made[:-1] if i % 100 else made[-1:])(rng.choice(words)) for i in range(3000)]
    texts = [" ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "ſKİı" + words[0].replace("s", "ſ").replace("k", "\u212a").replace("i", "ı")]
    plain = prefilter.Prefilter(patterns)
    assert isinstance(prefilter.Automaton({}), prefilter.Automaton) and type(plain.automaton) is not prefilter.Automaton
    monkeypatch.setattr(prefilter, "automaton", prefilter.Automaton)
    own = prefilter.Prefilter(patterns)
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
    tried = 0
    for t in texts:
        got = plain.candidates(t)
        assert got == own.candidates(t) and got == sorted(set(got))
        assert {i for i, c in enumerate(compiled) if c.search(t)} <= set(got)
        tried += len(got)
    assert tried < 0.12 * len(texts) * len(patterns)


def test_matcher_with_many_patterns(spark):
    """The batched matcher finds what trying each of 3,000 patterns finds."""
    rng = random.Random(9)
    rows = [dict(name=f"T{i}", pack="p", source=rng.choice(["html", "text"]), qualifier=None, idx=i, regex=rng.choice([f"tech{i}x", f"(?:tech|lib){i}x(\\d)?", f"t[e3]ch{i}x"]), confidence=100, version="\\1" if i % 2 else None) for i in range(3000)]
    stacks = [(str(k), s, None, "f", " ".join(f"{rng.choice(['tech', 'LIB', 't3ch'])}{rng.randrange(4000)}x{rng.randrange(12)}" for _ in range(50))) for k in range(20) for s in ("html", "text")]
    got = {(r.lead, r.source, r.idx, r.matched_value) for r in match.match_batched(spark.createDataFrame(stacks, "lead string, source string, qualifier string, field string, text string"), rows).collect()}
    assert got == {(lead, s, p["idx"], m[0]) for lead, s, _, _, text in stacks for p in rows if p["source"] == s and (m := re.search(p["regex"], text, re.IGNORECASE))}


def test_failures(spark):
    """A pattern that runs out of time is no hit, costs the lead nothing else, and is counted."""
    stacks = spark.createDataFrame([("l", "html", None, "raw_html", "a" * 40 + "! plain"), ("m", "html", None, "raw_html", "plain")], "lead string, source string, qualifier string, field string, text string")
    rows = [dict(name=n, pack="p", source="html", qualifier=None, idx=0, regex=r, confidence=100, version=None) for n, r in (("Slow", r"^(a|a|aa)+$"), ("Plain", "plain"))]
    assert {(r.lead, r.name) for r in match.match_batched(stacks, rows, 0.05).collect()} == {("l", "Plain"), ("m", "Plain")}
    assert [(r.lead, r.failed) for r in match.failures(stacks, rows, 0.05).collect()] == [("l", 1)]


def test_packs(tmp_path):
    assert packs.annotated(r"a\;version:\1\;confidence:50") == ("a", {"version": r"\1", "confidence": "50"})
    assert packs.confidence({"confidence": "500"}) == 100 and packs.confidence({"confidence": "x"}) == 100
    (tmp_path / "a.json").write_text('{"X": {"html": ["(bad", "good"], "js": {"a": ""}}, "Y": {"js": {"b": ""}}}')
    (tmp_path / "b.json").write_text("broken")
    pack = packs.fingerprint_pack(tmp_path)
    assert [p["regex"] for p in pack.pattern] == ["good"] and (pack.stats[0].empty, pack.stats[0].invalid) == (1, 1)


def test_tiers(spark):
    context = [("1", {"business": {"company_name": "A"}}), ("2", {"business": {}})]
    rows = spark.createDataFrame([(i, str(c)) for i, c in context], "id string, s string").selectExpr("id", "named_struct('business', named_struct('company_name', if(id = '1', 'A', ''))) as context")
    got = {r.id: r.status for r in tiers.call_tier(rows, "tier1", tiers.stub_gate, Config()).collect()}
    assert got == {"1": "tier1_passed", "2": "tier1_rejected"}

    def broken(_):
        raise RuntimeError("no")

    assert {r.status for r in tiers.call_tier(rows, "tier1", broken, Config()).collect()} == {"tier1_failed_fallback"}
    assert {r.status for r in tiers.call_tier(rows, "tier2", broken, Config()).collect()} == {"tier2_failed"}


def test_warehouse_and_config(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, updated_at int, v string")
    assert {r.id: r.v for r in warehouse.latest(rows).collect()} == {"a": "z", "b": "y"}
    with pytest.raises(LookupError):
        warehouse.run_by_id(rows, "q")
    assert warehouse.clamp(500, 50) == 50 and warehouse.run_status(None) == "running"
    assert campaign_type("Voice AI") == "voice_ai_agent" and campaign_type(None) == "website_modernization" and listed(" A, ,b") == ("a", "b")
    with pytest.raises(ValueError):
        RunRequest(target_industry="x", target_location="y", candidate_limit=51)
    run = warehouse.create_run(spark, RunRequest(target_industry="x", target_location="y"), "r", "2026-01-01").first()
    assert (run.status, run.candidate_limit) == ("queued", 10)
