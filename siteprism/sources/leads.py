"""Landed leads and pages to rows, and rows to files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism import schemas
from siteprism.functions.html import page_signals
from siteprism.sources.shared import fresh_path, local_path

#: Landed HTML files to a folder, and to a reading: the driver holds the list of one reading's files at a time.
FOLDER_FILES, READ_FILES = 1000, 50_000
#: What opening a file costs, in bytes read: by Spark's own 4 MB a task would get 32 small files.
OPEN_COST = ("spark.sql.files.openCostInBytes", "65536")


def json_object(c: Column | str) -> Column:
    """A map of a JSON object's fields; empty for null, broken or other JSON."""
    c = F.col(c) if isinstance(c, str) else c
    own = F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>"))
    return F.coalesce(own, F.expr("cast(map() as map<string,string>)"))


def saturated(c: Column) -> Column:
    """As a 32-bit integer, at its limits beyond them."""
    return F.least(F.greatest(c, F.lit(-2147483648)), F.lit(2147483647)).cast("int")


def from_wire(leads: DataFrame) -> DataFrame:
    """Landed leads with the wire's defaults: no null scalar but crawl_allowed, and no null list."""
    put = {}
    for f in leads.schema:
        kind = f.dataType.simpleString()
        zero = {"string": F.lit(""), "int": F.lit(0), "float": F.lit(0.0).cast("float"), "boolean": F.lit(False)}.get(kind)
        if kind.startswith("array"):
            zero = F.expr(f"cast(array() as {kind})")
        if zero is not None and f.name != "crawl_allowed":
            put[f.name] = F.coalesce(F.col(f.name), zero)
    return leads.withColumns(put)


def exploded(batches: DataFrame) -> DataFrame:
    """The leads of landed batches (leads: array of structs)."""
    return batches.select(F.explode("leads").alias("l")).select("l.*")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Batches landed as JSON lines, one batch to a line."""
    return from_wire(exploded(spark.read.schema(schemas.LEAD_BATCH).json(path)))


def stream_landed(spark: SparkSession, path: str, files_per_trigger: int = 500) -> DataFrame:
    """The same as a stream; the trigger's bound is the backpressure."""
    batches = spark.readStream.schema(schemas.LEAD_BATCH).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return from_wire(exploded(batches))


def write_landed(leads: DataFrame, path: str) -> None:
    """Each lead a batch of one, as JSON lines."""
    leads.select(F.array(F.struct(*leads.columns)).alias("leads")).write.mode("append").json(path)


def stored(leads: DataFrame) -> DataFrame:
    """The wire record as the stored one: JSON fields by their stored names, confidences as doubles."""
    return leads.withColumns(
        {
            "provider_provenance": F.to_json(json_object("provider_provenance_json")), "website_provenance": F.to_json(json_object("website_provenance_json")),
            "location_confidence": F.col("location_confidence").cast("double"), "category_confidence": F.col("category_confidence").cast("double"),
        }
    ).drop("provider_provenance_json", "website_provenance_json")


def write_html(pages: DataFrame, path: str) -> list[list[str]]:
    """Each page (page_id, html) as a file of its own, its html (null: empty) and a line feed, with ``page_id=<id>`` in the file's path. Returns the folders, grouped for readings.

    In a local or mounted folder the tasks write the files themselves, FOLDER_FILES to a folder: Spark's writer would
    make a folder and a checksum file for each, and start chmod for all three. In other stores it is Spark's writer.
    """
    at = local_path(pages.sparkSession, path)
    if at is None:
        pages.select("page_id", "html").write.partitionBy("page_id").text(path)
        return [[path]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        folders: list[str] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for key, html in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True):
                    if n % FOLDER_FILES == 0:  # each attempt of a task has its own folders, and only those of the one that counts are told
                        folders.append(f"{task.partitionId()}-{task.taskAttemptId()}-{len(folders)}")
                        os.makedirs(f"{at}/{folders[-1]}")
                    with open(f"{at}/{folders[-1]}/page_id={key}-{n}.html", "wb") as f:
                        f.write((html or b"") + b"\n")
                    n += 1
        files = [min(FOLDER_FILES, n - i * FOLDER_FILES) for i in range(len(folders))]
        yield pa.RecordBatch.from_pydict({"folder": pa.array(folders, pa.string()), "files": pa.array(files, pa.int32())})

    os.makedirs(at, exist_ok=True)
    groups, held = [], READ_FILES
    for r in pages.select("page_id", F.col("html").cast("binary").alias("html")).mapInArrow(run, "folder string, files int").collect():
        if held + r.files > READ_FILES:
            groups.append([])
            held = 0
        groups[-1].append(f"{path}/{r.folder}")
        held += r.files
    return groups or [[path]]


def leads_from_html(spark: SparkSession, path: str | list[str], base: str = "https://example.com/") -> DataFrame:
    """A lead-shaped row of each landed HTML file, in one reading; the path stands for the id."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    pages = files.select(F.xxhash64("file").alias("page_id"), F.lit(base).alias("url"), "html", "file")
    got = page_signals(pages, kept=("html", "file"))
    return got.select("page_id", F.col("html").alias("raw_html"), F.col("file").alias("id"), *[c for c in got.columns if c not in ("page_id", "html", "file")])


def read_html(spark: SparkSession, groups: list[list[str]], take: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``take`` makes of the leads of landed HTML files, one group of folders after the other, written as Parquet and read back."""
    at = fresh_path(spark, "html_leads")
    before = spark.conf.get(OPEN_COST[0])
    spark.conf.set(*OPEN_COST)
    try:
        for folders in groups:
            rows = take(leads_from_html(spark, folders))
            rows.write.mode("append").parquet(at)
    finally:
        spark.conf.set(OPEN_COST[0], before)
    return spark.read.schema(rows.schema).parquet(at)


def to_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
