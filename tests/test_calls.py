"""Limits and repeated attempts of calls from a stream, with a clock that the rows bring."""

import pytest
from pyspark.sql import functions as F

from siteprism.streaming import calls

pytest.importorskip("google.protobuf")  # what Spark's stateful processors in Python talk by


def test_waits_and_tokens():
    assert [calls.wait_ms(i) for i in range(1, 9)] == [4000, 4000, 4000, 8000, 16000, 32000, 60000, 60000]
    assert calls.refilled(0, 0, 30_000, 500, 60) == 250 and calls.refilled(490, 0, 30_000, 500, 60) == 500 and calls.refilled(3, 5, 0, 500, 60) == 3


def test_limited_calls(spark, tmp_path):
    """Eight calls, four in a minute: some wait for tokens, some are tried again, one ends as a dead letter; over restarts none is lost or repeated."""

    def answer(context, attempt):
        """Fails as often as the context says."""
        if attempt <= context["failures"]:
            raise RuntimeError(f"not now: {attempt}")
        return {"value": context["value"]}

    old = spark.conf.get(calls.PROVIDER[0])
    spark.conf.set(*calls.PROVIDER)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = 1_700_000_000
    rows = {i: (f"r{i}", {1: 2, 3: 9}.get(i, 0), base) for i in range(8)}

    def land(items):
        made = spark.createDataFrame(items, "id string, failures int, at long")
        made.select("id", F.struct("failures", F.concat(F.lit("v"), "id").alias("value")).alias("context"), F.timestamp_seconds("at").alias("at")).coalesce(1).write.mode("append").parquet(src)

    def go():
        queue = spark.readStream.schema("id string, context struct<failures:int,value:string>, at timestamp").parquet(src)
        done = calls.limited_calls(queue, answer, shares=1, rate=4, per=60)
        done.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    try:
        land(list(rows.values()))
        go()
        # later requests move the clock, each in a run of its own, as after restarts
        for k, later in enumerate((5, 20, 45, 90, 150, 300, 600)):
            land([(f"tick{k}", 0, base + later)])
            go()
        got = {r.id: r for r in spark.read.parquet(out).collect()}
        assert spark.read.parquet(out).count() == len(got)
        assert {f"r{i}" for i in range(8)} <= got.keys()
        assert (got["r3"].status, got["r3"].attempt, got["r3"].error) == ("dead_letter", 5, "not now: 5")
        assert (got["r1"].status, got["r1"].attempt, got["r1"].output) == ("done", 3, '{"value": "vr1"}')
        assert all(got[f"r{i}"].status == "done" and got[f"r{i}"].attempt == 1 for i in (0, 2, 4, 5, 6, 7))
        first = [r for r in got.values() if r.at_ms == base * 1000]
        assert sorted(r.id for r in first) == ["r0", "r2"]  # four tokens at first; two of these calls failed
        # a bucket of four and four a minute: never more than that
        times = sorted(r.at_ms for r in got.values())
        assert all(sum(a <= t < a + 60_000 for t in times) <= 8 for a in times)
        assert got["r1"].at_ms >= base * 1000 + 8000
    finally:
        spark.conf.set(calls.PROVIDER[0], old)
