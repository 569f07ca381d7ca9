"""Technologies within a lead's row against the same by joins over tables of detections."""

import random

from pyspark.sql import functions as F
from test_operators import LEAD, NO_LEAD, SITES

from siteprism.operators import match, resolve, technologies
from siteprism.sources import packs

ROW = "array<struct<seq:int,name:string,pack:string,categories:array<int>,confidence:int,version:string,source:string,pattern_id:string>>"


def made(rng):
    """A catalog of twelve names with edges of every kind, and a blocklist."""
    names = [f"t{i}" for i in range(12)]
    pack = packs.Pack()
    for n in names[:-2]:
        pack.tech.append({"name": n, "pack": rng.choice("pq"), "categories": rng.sample(range(5), rng.randint(0, 2)), "pricing": [], "saas": False, "oss": False, "website": None, "cpe": None})
    for t in pack.tech:
        for kind, share in (("excludes", 0.2), ("requires", 0.3), ("implies", 0.4)):
            pack.edge += [{"name": t["name"], "kind": kind, "target": x, "category": None, "pos": i} for i, x in enumerate(rng.sample(names, rng.randint(1, 2)) if rng.random() < share else [])]
        pack.edge += [{"name": t["name"], "kind": "requires_category", "target": None, "category": c, "pos": i} for i, c in enumerate(rng.sample(range(5), 2) if rng.random() < 0.2 else [])]
    block = packs.Blocklist(
        sorted((n, rng.choice("pq")) for n in rng.sample(names, 3)),
        [(i, rng.choice(names), rng.choice("pq"), rng.sample(["html", "headers", "implied"], rng.randint(1, 2)), rng.choice([10, 40]), rng.random() < 0.5) for i in range(6)], rng.sample(names, 2),
    )
    return pack, block


def leads(rng, pack, n):
    categories = {t["name"]: t["categories"] for t in pack.tech}
    own = {t["name"]: t["pack"] for t in pack.tech}
    out = []
    for i in range(n):
        names = rng.choices(list(categories), k=rng.randint(0, 9))
        out.append((str(i), [(k + 1, x, own[x], categories[x], rng.choice([20, 60, 100]), rng.choice([None, "1"]), rng.choice(["html", "headers"]), f"{x}#{k}") for k, x in enumerate(names)]))
    return out


def test_folds_are_what_joins_give(spark):
    rng = random.Random(6)
    for _ in range(3):
        pack, block = made(rng)
        rows = spark.createDataFrame(leads(rng, pack, 60), f"lead string, found {ROW}")
        tech, _, edge = packs.tables(spark, pack)
        flat = rows.select("lead", F.inline("found"))
        known = technologies.catalog(pack)
        col = F.col("found")
        both = (
            (technologies.excludes(col, known), resolve.excludes(flat, edge)), (technologies.requires(col, known), resolve.requires(flat, edge)), (technologies.implies(col, known), resolve.implies(flat, edge, tech)),
            (technologies.best(col), resolve.best(flat)), (technologies.resolved(col, known), resolve.resolve(flat, tech, edge)), (technologies.blocked(col, block), resolve.apply_blocklist(flat, *block.frames(spark))),
            (technologies.resolved(col, known, block), resolve.apply_blocklist(resolve.resolve(flat, tech, edge), *block.frames(spark))),
        )
        for array, joined in both:
            names = ["lead", "seq", "name", "pack", "categories", "confidence", "version", "source", "pattern_id"]
            got = rows.select("lead", F.inline(array)).select(*names).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, joined.select(*names).collect()))
    none = spark.createDataFrame([("x", []), ("y", None)], f"lead string, found {ROW}").select(technologies.resolved(F.col("found"), known, block).alias("t")).collect()
    assert [r.t for r in none] == [[], None]


def test_sites(spark):
    """The sites' technologies by both ways, and the same haystacks."""
    rows = [tuple((NO_LEAD | own | {"id": name}).values()) for name, (own, _) in SITES.items()]
    df = spark.createDataFrame(rows, LEAD)
    pack = packs.overridden(packs.fingerprint_pack(), packs.fingerprint_pack(packs.HERE / "local", "local_biz"))
    got = {r.id: r.technologies for r in technologies.with_technologies(df, pack, packs.blocklist()).collect()}
    want = {r.lead: r.technologies for r in resolve.nested(match.match_leads(df, pack, packs.blocklist())).collect()}
    bare = lambda ts: [(t.name, t.pack, t.confidence, t.version, t.source, t.pattern_id) for t in ts]
    assert {k: bare(v) for k, v in got.items()} == {k: bare(want.get(k, [])) for k in got}
    flat = df.select(F.col("id").alias("lead"), F.inline(match.stacks()))
    assert sorted(map(repr, flat.collect())) == sorted(map(repr, match.haystacks(df).collect()))


def test_failures_and_filter(spark):
    """A pattern that runs out of time costs that pattern alone and is counted; leads that aren't asked for get nulls."""
    pack = packs.Pack()
    stats = packs.Stats("p")
    packs.add_entry(pack, stats, "Slow", {"html": r"^(a|a|aa)+$"}, "p")
    packs.add_entry(pack, stats, "Plain", {"html": "plain"}, "p")
    rows = [tuple((NO_LEAD | {"id": i, "raw_html": h}).values()) for i, h in (("l", "a" * 40 + "! plain"), ("m", "plain"), ("n", "plain"), ("o", None))]
    got = technologies.with_technologies(spark.createDataFrame(rows, LEAD), pack, of=F.col("id") != "n", timeout=0.05).collect()
    assert {r.id: (r.technologies and [t.name for t in r.technologies], r.matcher_failures) for r in got} == {"l": (["Plain"], 1), "m": (["Plain"], 0), "n": (None, None), "o": ([], 0)}
