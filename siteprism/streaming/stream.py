"""Structured Streaming: leads as they land, evaluated and stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteprism.config import Config
from siteprism.plans.pipeline import process
from siteprism.sources.packs import Blocklist, Pack


def evaluated(leads: DataFrame, config: Config, pack: Pack | None = None, block: Blocklist | None = None) -> DataFrame:
    """A stateless projection, technologies included, so it needs no watermark and restarts anywhere."""
    return process(leads, config, pack, block)


def first_in_run(candidates: DataFrame, within: str = "1 day", at: str = "at") -> DataFrame:
    """A domain once in a run; state goes when the watermark has passed it."""
    return candidates.withWatermark(at, within).dropDuplicatesWithinWatermark(["run_id", "domain"])


def store(leads: DataFrame, path: str, checkpoint: str, batch: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    """Appends each micro-batch in one commit under its number, so that a batch that is run again replaces itself."""

    def write(b: DataFrame, n: int) -> None:
        batch(b).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return leads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_in_parallel(calls: int, f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """T4: a batch function that at most ``calls`` tasks run, which bounds the calls under way."""
    return lambda b: f(b.repartition(calls))


def queued(leads: DataFrame) -> DataFrame:
    """The queue of tier 2 is the stored rows of that status, so that a crash loses none."""
    return leads.where(F.col("pipeline_status") == "tier2_queued")
