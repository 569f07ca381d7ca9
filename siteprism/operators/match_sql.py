"""The matcher as a table function for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siteprism.operators import match

HITS = "name string, pack string, idx int, confidence int, version string, matched_value string, failed boolean"


def register(spark: SparkSession, patterns: list[dict], name: str = "match_signatures", timeout: float = 0.1) -> None:
    """Make ``name(source, qualifier, text)`` known to SQL: a row for each pattern that matches, or runs out of time (failed).

    It is called beside a table by LATERAL; each worker compiles the patterns once, behind their prefilter. Null
    source or text gives no row.
    """
    kind = StructType.fromDDL(HITS)

    class Matches:
        @staticmethod
        def analyze(source: AnalyzeArgument, qualifier: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            for told, arg in (("source", source), ("text", text)):
                if not isinstance(arg.dataType, StringType):
                    raise ValueError(f"{told} must be a string, not {arg.dataType.simpleString()}")
            return AnalyzeResult(kind)

        def __init__(self) -> None:
            self.matcher = match.Matcher(patterns, timeout)

        def eval(self, source: str, qualifier: str, text: str) -> Iterator[tuple]:
            if source is None or text is None:
                return
            for h in self.matcher.hits(source, qualifier, text):
                yield h["name"], h["pack"], h["idx"], h["confidence"], h["version"], h["matched_value"], h["failed"]

    spark.udtf.register(name, udtf(Matches, useArrow=True))
