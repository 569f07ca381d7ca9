"""Encoded pages, selectors as folds, and the signals they tell against the parser's own."""

import random

import pytest
from pyspark.sql import functions as F

from siteprism.functions import dom, html

PAGE = '<html><head><title>T | x</title><meta name="viewport" content=""></head><body class="a b"><div id="m" class="x"><p>one <b>two</b></p><p class="x y">three<br>four</p></div><p>five</p><a href="/q" data-k="left right">go</a></body></html>'


def pages(spark, *htmls, url="https://a.example/x/y"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_encoded():
    nodes = dom.encoded("<a>x<b>y</b></a>z<br>")
    assert [(n["tag"], n["pre"], n["last"], n["up"]) for n in nodes] == [("a", 0, 3, -1), ("#text", 1, 1, 0), ("b", 2, 3, 0), ("#text", 3, 3, 2), ("#text", 4, 4, -1), ("br", 5, 5, -1)]
    assert dom.encoded(None) == [] and dom.encoded("</x>") == []
    assert [n["last"] for n in dom.encoded("<i><i><i>")] == [2, 2, 2]


def by_hand(nodes, selector):
    """Selectors over a list of nodes, part by part, looking at every pair."""
    out = set()
    for alternative in dom._parsed(selector):
        found = None
        for how, tests in alternative:
            own = [n for n in nodes if n["tag"] != "#text" and all(_test(t, n) for t in tests)]
            if found is not None:
                own = [n for n in own if any(a["pre"] == n["up"] if how == ">" else a["pre"] < n["pre"] <= a["last"] for a in found)]
            found = own
        out |= {n["pre"] for n in found}
    return sorted(out)


def _test(test, node):
    kind, *what = test
    attrs = dict(node["attrs"])
    value = attrs.get(what[0]) if kind == "attr" else None
    return {
        "tag": lambda: what[0] in ("*", node["tag"]), "class": lambda: what[0] in attrs.get("class", "").split(), "id": lambda: attrs.get("id") == what[0],
        "attr": lambda: value is not None and {None: lambda: True, "=": lambda: value == what[2], "~=": lambda: what[2] in value.split(), "^=": lambda: value.startswith(what[2]), "$=": lambda: value.endswith(what[2]), "*=": lambda: what[2] in value}[what[1]](),
    }[kind]()


def test_selectors(spark):
    rng = random.Random(3)

    def tree(depth):
        tag = rng.choice(["div", "p", "span", "br", "a"])
        attrs = "".join(f' {k}="{rng.choice(v)}"' for k, v in (("class", ["x", "x y", "y", "z"]), ("id", ["m", "n"]), ("data-k", ["left right", "left", "ri"])) if rng.random() < 0.4)
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else "t"
        return f"<{tag}{attrs}>" + ("" if tag == "br" else inner + (f"</{tag}>" if rng.random() < 0.9 else ""))

    htmls = ["".join(tree(4) for _ in range(4)) for _ in range(12)] + [PAGE, "", None, "plain"]
    wanted = ["p", "*", ".x", "#m", "div p", "div > p", "div .x > span", "body > p", "[data-k]", "[data-k=left]", "a[data-k~='right']", '[data-k^="le"]', "[data-k$=ight]", "[data-k*=ef]", "p.x.y", "p, .x", "div div div", "#m > .x p, a , br", "html body.a p b", "nothing p", "* > *"]
    rows = dom.with_nodes(pages(spark, *htmls))
    got = rows.select("page_id", *[F.transform(dom.select(F.col("nodes"), s), lambda n: n["pre"]).alias(str(i)) for i, s in enumerate(wanted)]).collect()
    for r in got:
        nodes = dom.encoded(htmls[r.page_id])
        for i, s in enumerate(wanted):
            assert r[str(i)] == by_hand(nodes, s), (s, htmls[r.page_id])
    for bad in ("", "p >", "> p", "p,,q", "p:first", ","):
        with pytest.raises(ValueError, match=r"in |known"):
            dom.select(F.col("nodes"), bad)


def test_text(spark):
    r = dom.with_nodes(pages(spark, PAGE)).select(dom.texts(F.col("nodes"), "p").alias("p"), dom.attributes(F.col("nodes"), "a", "data-k").alias("k"), dom.texts(F.col("nodes"), "br").alias("br")).first()
    assert (r.p, r.k, r.br) == (["one two", "three four", "five"], ["left right"], [""])


SITES = [
    PAGE, "", None,
    '<meta property="og:site_name" content="  Blue\n Roofing "><h1>Other</h1>', '<meta property="og:site_name" content="Home"><meta name="application-name" content="App Co">', '<img alt="Acme Logo"><img alt="ab"><img alt="Stone Works">', "<h1>Stone <i>&amp;</i> Sons</h1><h1>Second</h1>",
    "<title>Corner Bakery | Fresh</title><h1>x</h1>", "<title>Home | x</title>", "<title>A — B</title>",
    "<address>12 Main</address><address>12 Main Street</address>", "<footer>9 Oak Ave, copyright</footer><div class='location'>1 Low Road</div><div id=contact>77 Oak Avenue,<br>Portland, OR 97201</div>", "<p itemprop='address'>500 Pine Rd</p>", "<div class='address big'><script>1 x street</script></div>",
    '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type": ["a"]}</script><script type="application/ld+json">[1, {"@type": 5}, {"@type": "Plumber"}]</script>', '<script type="application/ld+json">{"@type": "Dentist", "x": 1}</script>', '<script type="application/ld+json">7</script>',
    '<meta name="description" content=" a  b "><meta name="description" content="second"><meta http-equiv="x"><meta itemprop="i" content="j"><meta name="" property="p" content="q"><meta content="none"><form></form><meta name=viewport>',
    '<a href="https://www.facebook.com/us">F</a><a href="https://x.facebook.com/2">G</a><a href="/kontakt">Contact us</a><a href="">empty</a><a>none</a><a href="https://a.example/z"> z </a><script src="s.js"></script><link rel="stylesheet" href="//cdn.example/c.css"><link rel="stylesheet alternate" href="d.css"><link rel=manifest href="/m.json"><link rel=manifest href="/n.json">',
]
BOTH = ("company_name", "address", "schema_org_business_type", "meta_lines", "meta_description", "has_form", "has_viewport", "social_linkedin", "social_facebook", "social_instagram", "has_contact_page", "anchor_hrefs", "script_srcs", "stylesheet_hrefs", "manifest_url")


def test_signals_agree_with_the_parser(spark, tiny):
    df = pages(spark, *SITES).unionByName(spark.read.parquet(f"{tiny}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url", "html").limit(60))
    own = {r.page_id: r for r in dom.signals(df).collect()}
    for r in html.page_signals(df).collect():
        for c in BOTH:
            assert own[r.page_id][c] == r[c], (c, r.page_id, SITES[r.page_id] if r.page_id < 1000 else "")
    assert own[3].company_name == "Blue Roofing" and own[11].address == "77 Oak Avenue, Portland, OR 97201" and own[14].schema_org_business_type == "Plumber"
    assert dom.signals(df.limit(0)).count() == 0


def test_large_page(spark):
    """A list page of 60,000 elements and a page 5,000 deep take seconds."""
    wide = "<ul>" + '<li class="x"><a href="/a">b</a></li>' * 30_000 + "</ul>"
    deep = "<div>" * 5_000 + "x" + "</div>" * 5_000
    rows = dom.with_nodes(pages(spark, wide, deep)).select("page_id", F.size(dom.select(F.col("nodes"), "ul li.x a")).alias("a"), F.size(dom.select(F.col("nodes"), "div div")).alias("d"))
    assert {tuple(r) for r in rows.collect()} == {(0, 30_000, 0), (1, 0, 4_999)}
