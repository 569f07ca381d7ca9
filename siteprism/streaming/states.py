"""States of runs that are streams, written as they change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = "run_id string, at string, state string, batch long, rows long, error string"


class RunStates(StreamingQueryListener):
    """Writes a row to ``path`` when a named query starts, has taken a batch, and ends; the name is the run's id.

    ``queued`` runs have no row yet; ``running`` comes with the start and each batch, ``completed`` or ``failed`` at
    the end. Rows are only added, each in a folder of its own under ``path``, so that writes never meet and listeners
    of several drivers share it; ``recorded`` reads them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.names: dict[str, str] = {}

    def _write(self, *row: object) -> None:
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.parquet(f"{self.path}/event-{uuid.uuid4().hex}")

    def onQueryStarted(self, event) -> None:
        if event.name:
            self.names[str(event.runId)] = event.name
            self._write(event.name, event.timestamp, "running", -1, 0, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name and p.numInputRows:
            self._write(p.name, p.timestamp, "running", p.batchId, p.numInputRows, None)

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), None)
        if name:
            now = self.spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")").first()[0]
            self._write(name, now, "failed" if event.exception else "completed", None, 0, event.exception)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """All rows that listeners wrote under ``path``."""
    return spark.read.schema(EVENTS).parquet(f"{path}/event-*")


def states(events: DataFrame) -> DataFrame:
    """run_id, status, batches, rows, error of every run, by its latest state; an end is later than what came at its time."""
    last = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("at"), F.col("state") == "running", F.desc("batch")))
    sums = events.groupBy("run_id").agg(F.count_if(F.col("batch") >= 0).alias("batches"), F.sum("rows").alias("rows"))
    own = events.withColumn("_place", last).where("_place = 1").select("run_id", F.col("state").alias("status"), "error")
    return own.join(sums, "run_id").select("run_id", "status", "batches", "rows", "error")
