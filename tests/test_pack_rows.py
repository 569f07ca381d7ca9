"""Packs as tables against the loader of files: the same patterns, numbers, confidences and counts."""

import json
import random

from pyspark.sql import functions as F

from siteprism.sources import pack_rows, packs

ENTRIES = [
    {"html": ["good", "(bad", "x\\;version:\\1\\;confidence:50"], "cats": [1]}, {"headers": {"B": "b", "A": "", "C": 5}, "html": "[a-z]", "scriptSrc": []}, {"js": {"a": ""}}, {"meta": "plain", "dns": {"MX": ["x"]}, "cookies": {}},
    {"url": "", "css": "\\;confidence:x", "robots": "r\\;confidence: 500 ", "text": "t\\;confidence:-7\\;version:"}, {"html": ["a\\;note\\;confidence:+09\\;confidence:30", 3, None, {"x": 1}, "b\\;version:a:b"]}, {}, {"cookies": {"a b": "c\\;version:\\1", "é.": "d"}, "text": {"x": "y"}},
    {"html": "a\\;confidence:99999999999999999999"}, {"scriptSrc": "\\d{1,99999999999}", "html": "(?P<a>x)(?P=a)"},
]


def test_patterns_as_the_loader_has_them(spark):
    rng = random.Random(7)
    named = [(rng.choice("pq"), f"n{i}", e) for i, e in enumerate(ENTRIES * 2)]
    want, stats = packs.Pack(), {p: packs.Stats(p) for p in "pq"}
    for p, n, e in named:
        packs.add_entry(want, stats[p], n, e, p)
    rows = [(p, n, json.dumps(e)) for p, n, e in named] + [("p", "none", None), ("p", "broken", "{"), ("q", "list", "[1]"), ("q", "text", '"x"')]
    df = spark.createDataFrame(rows, "pack string, name string, entry string")
    got = pack_rows.patterns(df)
    keys = ("name", "pack", "source", "qualifier", "idx", "regex", "confidence", "version")
    assert sorted(map(repr, (tuple(r[k] for k in keys) for r in got.where("not invalid").collect()))) == sorted(map(repr, (tuple(r[k] for k in keys) for r in want.pattern)))
    own = {r["pack"]: (r.total, r.loaded, r.empty, r.patterns, r.invalid) for r in pack_rows.stats(df).collect()}
    assert own == {p: (s.total + 2, s.loaded, s.empty, s.patterns, s.invalid) for p, s in stats.items()}
    assert pack_rows.patterns(df.limit(0)).count() == 0 and pack_rows.stats(df.limit(0)).count() == 0


def test_overridden(spark):
    rows = [(0, "a", "X", '{"html": "1"}'), (1, "b", "X", '{"html": ["2", "3"]}'), (2, "c", "X", '{"html": "(bad"}'), (0, "a", "Y", '{"html": "4"}'), (2, "c", "Z", "{}")]
    got = pack_rows.overridden(spark.createDataFrame(rows, "ord int, pack string, name string, entry string")).collect()
    assert sorted((r.name, r["pack"]) for r in got) == [("X", "b"), ("Y", "a")]


def test_library(spark, tmp_path):
    library = {"jq": {"extractors": {"uri": ["/(§§version§§)/jq.js"], "filename": "jq-(§§version§§).js", "filecontent": ["jQuery v(§§version§§)", 4], "func": ["x"]}}, "none": {"extractors": {}}, "no": {}}
    (tmp_path / "l.json").write_text(json.dumps(library))
    want = packs.library_pack(tmp_path / "l.json")
    df = spark.createDataFrame([("retirejs", n, json.dumps(e)) for n, e in library.items()], "pack string, name string, entry string").withColumn("entry", pack_rows.library_entry(F.col("entry")))
    got = {(r.name, r.source, r.idx, r.regex, r.version) for r in pack_rows.patterns(df).collect()}
    assert got == {(p["name"], p["source"], p["idx"], p["regex"], p["version"]) for p in want.pattern} and len(got) == 3
