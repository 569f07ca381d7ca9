"""Resolving detections: excludes, requires, implies, best of each, and the blocklist.

Detections are rows: lead, seq (their order), name, pack, categories, confidence, version, source. The catalog
is tables: ``tech`` (name, pack, categories) and ``edge`` (name, kind, target, category). All steps are joins by
lead and name; the catalog is small and the optimiser broadcasts it by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rounds of the requires fixed point, and confidence of what is only implied.
REQUIRES_ROUNDS, IMPLIED_CONFIDENCE = 5, 50


def excludes(found: DataFrame, edge: DataFrame) -> DataFrame:
    """Without what any found technology excludes; two that exclude each other both go."""
    gone = found.select("lead", "name").distinct().join(edge.where("kind = 'excludes'").select("name", "target"), "name").select("lead", F.col("target").alias("name")).distinct()
    return found.join(gone, ["lead", "name"], "left_anti")


def requires(found: DataFrame, edge: DataFrame, rounds: int = REQUIRES_ROUNDS) -> DataFrame:
    """Only what finds all it requires and any of the categories that it requires, to a fixed point.

    A lead's distinct names, at most as many as the catalog has, are one array; the rounds are a fold over it,
    in one expression, and the detections are joined to what is left.
    """
    none = {"needs": F.expr("cast(array() as array<string>)"), "any_of": F.expr("cast(array() as array<int>)")}
    own = edge.groupBy("name").agg(
        F.collect_set(F.when(F.col("kind") == "requires", F.col("target"))).alias("needs"), F.collect_set(F.when(F.col("kind") == "requires_category", F.col("category"))).alias("any_of")
    )
    names = found.select("lead", "name", F.explode_outer("categories").alias("category")).groupBy("lead", "name").agg(F.collect_set("category").alias("cats"))
    rows = names.join(own, "name", "left").select("lead", F.struct("name", "cats", *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()]).alias("t"))
    fits = lambda here: lambda t: (F.size(F.array_except(t["needs"], F.transform(here, lambda y: y["name"]))) == 0) & ((F.size(t["any_of"]) == 0) | F.arrays_overlap(t["any_of"], F.flatten(F.transform(here, lambda y: y["cats"]))))
    held = rows.groupBy("lead").agg(F.collect_list("t").alias("ts"))
    left = held.select("lead", F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("ts"), lambda here, _: F.filter(here, fits(here)))).alias("t"))
    return found.join(left.select("lead", "t.name"), ["lead", "name"], "left_semi")


def implies(found: DataFrame, edge: DataFrame, tech: DataFrame) -> DataFrame:
    """With one more row for each name that is implied (one hop) and not found; the first parent's.

    Known names take pack and categories from the catalog, others their parent's pack.
    """
    wanted = edge.where("kind = 'implies'").select("name", F.col("target"), F.col("pos"))
    fresh = found.join(wanted, "name").join(found.select("lead", F.col("name").alias("target")).distinct(), ["lead", "target"], "left_anti")
    first = F.row_number().over(W.partitionBy("lead", "target").orderBy("seq", "pos")) == 1
    fresh = fresh.withColumn("first", first).where("first")
    known = tech.select(F.col("name").alias("target"), F.col("pack").alias("own_pack"), F.col("categories").alias("own_categories"))
    rows = fresh.join(known, "target", "left").select(
        "lead", (F.lit(1_000_000) + F.col("seq") * 1000 + F.col("pos")).alias("seq"), F.col("target").alias("name"), F.coalesce("own_pack", "pack").alias("pack"),
        F.coalesce("own_categories", F.expr("cast(array() as array<int>)")).alias("categories"), F.least("confidence", F.lit(IMPLIED_CONFIDENCE)).alias("confidence"),
        F.lit(None).cast("string").alias("version"), F.lit("implied").alias("source"), F.concat(F.lit("implied:"), "name", F.lit("->"), "target").alias("pattern_id"),
    )
    return found.select(*rows.columns).unionByName(rows)


def best(found: DataFrame) -> DataFrame:
    """A2: one row for each lead, name and pack: most confident, not implied, with a version, first."""
    order = W.partitionBy("lead", "name", "pack").orderBy(F.desc("confidence"), F.col("source") == "implied", F.col("version").isNull(), "seq")
    return found.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def resolve(found: DataFrame, tech: DataFrame, edge: DataFrame) -> DataFrame:
    """Excludes, requires, implies, best."""
    return best(implies(requires(excludes(found, edge), edge), edge, tech))


def suppress(found: DataFrame, suppressed: DataFrame) -> DataFrame:
    """J10."""
    return found.join(suppressed.select("name", "pack"), ["name", "pack"], "left_anti")


def downgrade(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Confidence capped by the first rule (ord, name, pack, sources, cap, corroborate) that fits; adds needs_other."""
    by_name = rules.groupBy(F.col("name").alias("r_name"), F.col("pack").alias("r_pack")).agg(F.array_sort(F.collect_list(F.struct("ord", "sources", "cap", "corroborate"))).alias("rs"))
    met = found.join(by_name, (F.col("name") == F.col("r_name")) & (F.col("pack") == F.col("r_pack")), "left")
    rule = F.try_element_at(F.filter("rs", lambda r: F.array_contains(r["sources"], F.col("source"))), F.lit(1))
    return met.withColumn("r", rule).select(
        *[c for c in found.columns if c != "confidence"], F.least("confidence", F.coalesce("r.cap", "confidence")).alias("confidence"), F.coalesce("r.corroborate", F.lit(False)).alias("needs_other")
    )


def corroborate(found: DataFrame, names: DataFrame) -> DataFrame:
    """What must not stand alone goes where it is the lead's only name. (Names are counted first; two such save each other.)"""
    listed = names.select("name", F.lit(True).alias("listed")).distinct()
    more = F.min("name").over(W.partitionBy("lead")) != F.max("name").over(W.partitionBy("lead"))
    needs = F.col("needs_other") | F.coalesce("listed", F.lit(False))
    return found.join(listed, "name", "left").withColumn("_more", more).where(~needs | F.col("_more")).select(*found.columns)


def apply_blocklist(found: DataFrame, suppressed: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """Suppress, downgrade, corroborate."""
    return corroborate(downgrade(suppress(found, suppressed), rules), names).drop("needs_other")


def nested(found: DataFrame) -> DataFrame:
    """A lead's detections as one array, in order."""
    fields = F.struct("seq", "name", "pack", "categories", "confidence", "version", "source", "pattern_id")
    return found.groupBy("lead").agg(F.array_sort(F.collect_list(fields)).alias("technologies"))
