"""A lead's technologies within its row: texts, hits and resolved detections as arrays.

What ``match`` and ``resolve`` do for tables of detections with joins and groups, this does for one lead at a time
with folds, so that nothing is shuffled or written between a lead and its technologies, and streams can do it too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.functions.arrays import first_of_each, let
from siteprism.operators import match
from siteprism.operators.resolve import IMPLIED_CONFIDENCE, REQUIRES_ROUNDS
from siteprism.sources.packs import Blocklist, Pack

_HITS = "array<struct<source:string,field:string,name:string,pack:string,idx:int,confidence:int,version:string,matched_value:string,failed:boolean>>"
_CATALOG = "map<string,struct<pack:string,categories:array<int>,needs:array<string>,any_of:array<int>,excludes:array<string>,implies:array<string>>>"
_RULES = "array<struct<name:string,pack:string,sources:array<string>,cap:int,corroborate:boolean>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def catalog(pack: Pack) -> Column:
    """What resolving needs to know of each technology, by name: a constant of the plan, of the pack's size."""
    told = {t["name"]: {"pack": t["pack"], "categories": t["categories"], "needs": [], "any_of": [], "excludes": [], "implies": []} for t in pack.tech}
    kinds = {"requires": "needs", "requires_category": "any_of", "excludes": "excludes", "implies": "implies"}
    for e in sorted(pack.edge, key=lambda e: e["pos"]):
        if e["name"] in told:
            told[e["name"]][kinds[e["kind"]]].append(e["category"] if e["kind"] == "requires_category" else e["target"])
    return F.from_json(F.lit(json.dumps(told)), _CATALOG)


def hits(stacks: Column, pack: Pack, timeout: float = 0.1) -> Column:
    """Every pattern that matches one of a lead's texts or runs out of time in one, by the matcher that packs have."""
    patterns = pack.pattern
    kind = pa.list_(pa.struct([(n, {"int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.string())) for n, t in (x.split(":") for x in _HITS[len("array<struct<") : -2].split(","))]))

    @F.arrow_udf(_HITS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = match.Matcher(patterns, timeout)
        for batch in batches:
            yield pa.array([[{"source": s["source"], "field": s["field"]} | h for s in lead or () for h in matcher.hits(s["source"], s["qualifier"], s["text"])] for lead in batch.to_pylist()], kind)

    # what runs out of time may not do so again; and the optimiser leaves such a function a step of its own
    return found.asNondeterministic()(stacks)


def detections(found: Column, catalog: Column) -> Column:
    """Hits in the order of detections, numbered (seq), with their technology's categories; those that ran out of time left out."""
    place = lambda s: F.array_position(F.lit(list(match.ORDER)), s).cast("int")
    code = lambda h: F.concat(h["pack"], F.lit(":"), h["name"], F.lit(":"), h["source"], F.lit("#"), h["idx"].cast("string"))
    ordered = F.array_sort(F.transform(F.filter(found, lambda h: ~h["failed"]), lambda h: F.struct(place(h["source"]).alias("ord"), h["name"].alias("name"), h["pack"].alias("pack"), h["idx"].alias("idx"), h["field"].alias("field"), h["confidence"].alias("confidence"), h["version"].alias("version"), h["source"].alias("source"), code(h).alias("pattern_id"))))
    return let(catalog, lambda c: F.transform(ordered, lambda h, i: _row(i + 1, h["name"], h["pack"], F.coalesce(c[h["name"]]["categories"], _none("int")), h["confidence"], h["version"], h["source"], h["pattern_id"])))


def _row(seq: Column, *values: Column) -> Column:
    names = ("name", "pack", "categories", "confidence", "version", "source", "pattern_id")
    return F.struct(seq.cast("int").alias("seq"), *[v.alias(n) for v, n in zip(values, names)])


def _names(found: Column) -> Column:
    return F.transform(found, lambda t: t["name"])


def excludes(found: Column, catalog: Column) -> Column:
    """J6."""
    gone = F.flatten(F.transform(found, lambda t: F.coalesce(catalog[t["name"]]["excludes"], _none("string"))))
    return let(gone, lambda out: F.filter(found, lambda t: ~F.array_contains(out, t["name"])))


def requires(found: Column, catalog: Column, rounds: int = REQUIRES_ROUNDS) -> Column:
    """To a fixed point, in so many rounds at most."""

    def fits(t: Column, names: Column, categories: Column) -> Column:
        own = catalog[t["name"]]
        needs, any_of = F.coalesce(own["needs"], _none("string")), F.coalesce(own["any_of"], _none("int"))
        return (F.size(F.array_except(needs, names)) == 0) & ((F.size(any_of) == 0) | F.coalesce(F.arrays_overlap(any_of, categories), F.lit(False)))

    def once(here: Column) -> Column:
        return let(F.struct(_names(here).alias("n"), F.flatten(F.transform(here, lambda t: t["categories"])).alias("c")), lambda now: F.filter(here, lambda t: fits(t, now["n"], now["c"])))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), found, lambda here, _: once(here))


def implies(found: Column, catalog: Column) -> Column:
    """With what is implied (one hop) and not found, by the first that implies it."""

    def children(t: Column) -> Column:
        targets = F.coalesce(catalog[t["name"]]["implies"], _none("string"))
        return F.transform(
            targets,
            lambda x, i: _row(
                F.lit(1_000_000) + t["seq"] * 1000 + i, x, F.coalesce(catalog[x]["pack"], t["pack"]), F.coalesce(catalog[x]["categories"], _none("int")), F.least(t["confidence"], F.lit(IMPLIED_CONFIDENCE)),
                F.lit(None).cast("string"), F.lit("implied"), F.concat(F.lit("implied:"), t["name"], F.lit("->"), x),
            ),
        )

    fresh = let(_names(found), lambda names: F.filter(F.flatten(F.transform(found, children)), lambda t: ~F.array_contains(names, t["name"])))
    by_name = F.array_sort(F.transform(fresh, lambda t: F.struct(t["name"].alias("name"), t["seq"].alias("seq"), t.alias("t"))))
    return F.concat(found, F.transform(first_of_each(by_name, lambda x: x["name"]), lambda x: x["t"]))


def best(found: Column) -> Column:
    """A2: of each name and pack the most confident, not implied, with a version, first; in order."""
    ranked = F.array_sort(F.transform(found, lambda t: F.struct(t["name"].alias("name"), t["pack"].alias("pack"), (-t["confidence"]).alias("c"), (t["source"] == "implied").alias("i"), t["version"].isNull().alias("v"), t["seq"].alias("seq"), t.alias("t"))))
    kept = first_of_each(ranked, lambda x: F.struct(x["name"], x["pack"]))
    return F.array_sort(F.transform(kept, lambda x: x["t"]))


def blocked(found: Column, block: Blocklist) -> Column:
    """Without what is suppressed; confidence capped by the first rule that fits; what needs company gone where it has none."""
    suppressed = F.lit([f"{n}\n{p}" for n, p in block.suppressed]) if block.suppressed else _none("string")
    alone = F.lit(list(block.names)) if block.names else _none("string")
    rules = F.from_json(F.lit(json.dumps([dict(zip(("name", "pack", "sources", "cap", "corroborate"), r[1:])) for r in sorted(block.rules)])), _RULES)
    kept = F.filter(found, lambda t: ~F.array_contains(suppressed, F.concat(t["name"], F.lit("\n"), t["pack"])))

    def ruled(t: Column, rs: Column) -> Column:
        rule = F.get(F.filter(rs, lambda r: (r["name"] == t["name"]) & (r["pack"] == t["pack"]) & F.array_contains(r["sources"], t["source"])), F.lit(0))
        return let(rule, lambda r: F.struct(t.withField("confidence", F.least(t["confidence"], F.coalesce(r["cap"], t["confidence"]))).alias("t"), (F.coalesce(r["corroborate"], F.lit(False)) | F.array_contains(alone, t["name"])).alias("needs")))

    told = let(rules, lambda rs: F.transform(kept, lambda t: ruled(t, rs)))
    more = F.size(F.array_distinct(_names(kept))) > 1
    return F.transform(F.filter(told, lambda x: ~x["needs"] | more), lambda x: x["t"])


def resolved(found: Column, catalog: Column, block: Blocklist | None = None) -> Column:
    """Excludes, requires, implies, best, and the blocklist where given, over a lead's detections."""
    out = let(catalog, lambda c: let(let(let(found, lambda t: excludes(t, c)), lambda t: requires(t, c)), lambda t: let(implies(t, c), best)))
    return let(out, lambda t: blocked(t, block)) if block else out


def with_technologies(leads: DataFrame, pack: Pack, block: Blocklist | None = None, of: Column | None = None, timeout: float = 0.1) -> DataFrame:
    """The leads with ``technologies``, their resolved detections, and ``matcher_failures``, how many patterns ran out of time.

    Both are null where ``of`` doesn't hold. A lead is one row from first to last.
    """
    wanted = F.lit(True) if of is None else F.coalesce(of, F.lit(False))
    # a generator of one row: the function in Python gets a column, not the expression of its texts
    texts = F.inline(F.array(F.struct(F.when(wanted, match.stacks()).alias("_texts"))))
    rows = leads.select("*", texts).withColumn("_hits", hits(F.col("_texts"), pack, timeout)).drop("_texts")
    both = F.struct(catalog(pack).alias("catalog"), F.col("_hits").alias("hits"))
    found = let(both, lambda x: resolved(detections(x["hits"], x["catalog"]), x["catalog"], block))
    failed = F.size(F.filter("_hits", lambda h: h["failed"]))
    return rows.withColumns({"technologies": F.when(wanted, found), "matcher_failures": F.when(wanted, failed)}).drop("_hits")
