"""Signature packs that are tables: entries as JSON texts to patterns, edges and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from siteprism.functions.arrays import let
from siteprism.sources.packs import NAMED, SOURCES, VERSION_GROUP, VERSION_MARK, valid

_PATTERN = "array<struct<source:string,qualifier:string,text:string>>"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def strings(value: Column) -> Column:
    """A variant that is a text or a list as a list of its texts; anything else is empty."""
    texts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: _is(x, "STRING"))
    listed = F.transform(texts, lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(_is(value, "STRING"), F.array(F.try_variant_get(value, "$", "string"))).when(_is(value, "ARRAY"), listed).otherwise(F.expr("cast(array() as array<string>)"))


def annotated(text: Column) -> Column:
    """struct<head, notes>: a pattern, and the notes behind it (key, value), each after a backslash and semicolon."""
    parts = F.split(text, r"\\;")
    note = lambda n: F.struct(F.trim(F.substring_index(n, ":", 1)).alias("key"), F.trim(F.regexp_replace(n, "^[^:]*:?", "")).alias("value"))
    return let(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("head"), F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), note).alias("notes")))


def _note(notes: Column, key: str) -> Column:
    """The last note of a key, or null."""
    return F.try_element_at(F.filter(notes, lambda n: n["key"] == key), F.lit(-1))["value"]


def confidence(notes: Column) -> Column:
    """0 to 100; 100 where there is none or it is no number."""
    value = _note(notes, "confidence")
    # more digits than a number holds are beyond the limits anyway
    number = F.when(value.rlike(r"^\+?0*[0-9]{1,9}$"), value.try_cast("int")).when(value.rlike(r"^\+?[0-9]+$"), 100).when(value.rlike("^-[0-9]+$"), 0)
    return F.least(F.greatest(F.coalesce(number, F.lit(100)), F.lit(0)), F.lit(100))


@F.arrow_udf(ArrayType(BooleanType()))
def _valid(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whether each pattern of a list can be compiled and isn't empty; Python's expressions, so Python says it."""
    for batch in batches:
        yield pa.array([None if xs is None else [valid(x) for x in xs] for xs in batch.to_pylist()], pa.list_(pa.bool_()))


def _own(entry: Column, value: Column, key: str) -> Column:
    """An entry's patterns under one key: by name where the key is one of NAMED and has an object, else a text or texts."""
    plain = F.transform(strings(value), lambda t: F.struct(F.lit(SOURCES[key]).alias("source"), F.lit(None).cast("string").alias("qualifier"), t.alias("text")))
    if key not in NAMED:
        return plain
    names = F.json_object_keys(F.get_json_object(entry, f"$.{key}"))
    values = F.try_variant_get(value, "$", "map<string,variant>")
    told = let(values, lambda m: F.transform(F.filter(names, lambda n: _is(m[n], "STRING")), lambda n: F.struct(F.lit(SOURCES[key]).alias("source"), n.alias("qualifier"), F.coalesce(F.nullif(F.try_variant_get(m[n], "$", "string"), F.lit("")), F.lit(".*")).alias("text"))))
    return F.when(_is(value, "OBJECT"), told).otherwise(plain)


def patterns(entries: DataFrame) -> DataFrame:
    """Pack, name, source, qualifier, idx, regex, confidence, version, and invalid, for every pattern of entries (pack, name, entry: JSON).

    Patterns are numbered in the order of the entry's keys, those that can't be compiled left out of the numbers
    (they stay as rows with ``invalid`` true and no number). An entry that is no object has no rows.
    """
    rows = entries.select("pack", "name", "entry", F.try_parse_json("entry").alias("v"))
    by_key = F.create_map(*[x for key in SOURCES for x in (F.lit(key), F.coalesce(_own(F.col("entry"), F.try_variant_get("v", f"$.{key}", "variant"), key), F.expr(f"cast(array() as {_PATTERN})")))])
    keys = F.filter(F.json_object_keys("entry"), lambda k: k.isin(*SOURCES))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT")).select("pack", "name", let(by_key, lambda m: F.flatten(F.transform(keys, lambda k: m[k]))).alias("p"))
    rows = rows.select("pack", "name", F.transform("p", lambda p: F.struct(p["source"].alias("source"), p["qualifier"].alias("qualifier"), annotated(p["text"]).alias("a"))).alias("p"))
    # a generator of one row: the function in Python gets a column
    rows = rows.select("pack", "name", F.inline(F.array(F.struct("p", F.transform("p", lambda p: p["a"]["head"]).alias("heads"))))).withColumn("ok", _valid("heads"))
    rows = rows.select("pack", "name", F.posexplode(F.arrays_zip("p", "ok")).alias("at", "x"), "ok")
    before = F.size(F.filter(F.slice("ok", 1, F.col("at")), lambda o: o))
    return rows.select(
        "pack", "name", "x.p.source", "x.p.qualifier", F.when(F.col("x.ok"), before).alias("idx"), F.col("x.p.a.head").alias("regex"), confidence(F.col("x.p.a.notes")).alias("confidence"),
        F.nullif(_note(F.col("x.p.a.notes"), "version"), F.lit("")).alias("version"), (~F.col("x.ok")).alias("invalid"),
    )


def stats(entries: DataFrame) -> DataFrame:
    """Of each pack (pack): total entries, loaded (with a usable pattern), empty ones, patterns, invalid patterns. Entries that are no objects are only in the total."""
    found = patterns(entries).groupBy("pack", "name").agg(F.count_if(~F.col("invalid")).alias("n"), F.count_if("invalid").alias("bad"))
    each = entries.select("pack", "name", F.coalesce(F.schema_of_variant(F.try_parse_json("entry")).startswith("OBJECT"), F.lit(False)).alias("object")).join(found, ["pack", "name"], "left")
    return each.groupBy("pack").agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("loaded"), F.count_if(F.col("object") & (F.coalesce("n", F.lit(0)) == 0)).alias("empty"), F.sum(F.coalesce("n", F.lit(0))).alias("patterns"),
        F.sum(F.coalesce("bad", F.lit(0))).alias("invalid"),
    )


def overridden(entries: DataFrame) -> DataFrame:
    """Of entries (ord: the pack's place, pack, name, entry) of one name those of the last pack that has a usable one."""
    usable = patterns(entries).where(~F.col("invalid")).select("pack", "name").distinct()
    last = F.row_number().over(W.partitionBy("name").orderBy(F.desc("ord"))) == 1
    return entries.join(usable, ["pack", "name"], "left_semi").withColumn("_last", last).where("_last").drop("_last")


def library_entry(entry: Column) -> Column:
    """A vulnerable library's entry as one of patterns: its URI and file name extractors match scripts, those of contents html, each with its version."""
    v = F.try_parse_json(entry)
    told = lambda key: F.transform(strings(F.try_variant_get(v, f"$.extractors.{key}", "variant")), lambda p: F.concat(F.replace(p, F.lit(VERSION_MARK), F.lit(VERSION_GROUP)), F.lit("\\;version:\\1")))
    return F.to_json(F.struct(F.concat(told("uri"), told("filename")).alias("scriptSrc"), told("filecontent").alias("html")))
