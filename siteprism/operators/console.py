"""What the operators' console shows, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteprism.functions.urls import console_host


def tier_state(status: Column, done: str = "passed", failed: str = "failed") -> Column:
    """A stage record's status as a state of the console."""
    s = F.coalesce(status, F.lit(""))
    return (
        F.when((s == "") | s.contains("skipped"), "skipped")
        .when(s.contains("passed") | s.contains("complete"), done)
        .when(s.contains("rejected") | s.contains("failed"), failed)
        .when(s.contains("queued") | s.contains("running"), "running")
        .otherwise("pending")
    )


def timeline(status: Column, crawl_allowed: Column, qualified: Column, tier1: Column, tier2: Column) -> Column:
    """The seven stages of a lead, in order, as key and state."""
    s = F.coalesce(status, F.lit(""))
    crawled = F.coalesce(crawl_allowed, F.lit(True))
    excluded = s.startswith("excluded_")
    stages = {
        "discovered": F.lit("done"),
        "compliance": F.when(crawled, "done").otherwise("rejected"),
        "heuristic": F.when(excluded | ~crawled, "skipped").otherwise("done"),
        "deterministic": F.when(excluded, "skipped").when(F.coalesce(qualified, F.lit(False)), "done").otherwise("rejected"),
        "tier1": tier_state(tier1, "done", "rejected"),
        "tier2": tier_state(tier2, "done", "rejected"),
        "persisted": F.when(s.isin("tier2_complete", "qualified_deterministic"), "done").otherwise("skipped"),
    }
    return F.array(*[F.struct(F.lit(k).alias("key"), c.alias("state")) for k, c in stages.items()])


def evidence(fields: tuple[str, ...]) -> Column:
    """Names of the boolean fields that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in fields]))


def view(leads: DataFrame) -> DataFrame:
    """Rows as the console lists them, numbered from 0 in a run."""
    url = F.coalesce("source_url", "initial_url", F.lit(""))
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("created_at"), "id")) - 1
    return leads.select(
        "id", place.alias("index"), F.coalesce("run_id", F.lit("")).alias("run_id"), url.alias("source_url"), console_host(url).alias("source_host"), "company_name",
        F.coalesce("target_industry", F.lit("unknown")).alias("target_industry"), F.coalesce("target_location", F.lit("unknown")).alias("target_location"), "pipeline_status", "score",
    )
