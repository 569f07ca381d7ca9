"""The search source's stop rules and options, and the states of runs as streams go through them."""

import json
import time

import pytest

from siteprism.sources import search
from siteprism.streaming import states


def body(n, more, start=0):
    return json.dumps({"query": {"more_results_available": more}, "web": {"results": [{"url": f" https://a{start + i}.example/ ", "title": "t", "description": None} for i in range(n)] + [{"url": " "}, {"title": "x"}, 5]}})


def asked(pages, limit=10, most=3):
    """Pages that a run reads, over bodies by page."""
    calls = []

    def fetch(run, query, count, page):
        calls.append((count, page))
        return pages.get(page)

    got = [(page, n, len(found)) for page, n, found in search.pages_of(fetch, "r", "q", limit, most)]
    return got, calls


def test_stop_rules():
    full = {k: body(20, True) for k in range(12)}
    assert asked(full) == ([(0, 20, 20), (1, 10, 20)], [(20, 0), (10, 1)])  # 10 * 3 results wanted
    assert asked(full, 1, 3)[0] == [(0, 20, 20)] and len(asked(full, 200, 12)[0]) == 10 and len(asked(full, 50, 0)[0]) == 1
    assert asked(full | {1: body(5, False)}, 100)[0] == [(0, 20, 20), (1, 20, 5)]
    assert asked(full | {1: body(0, True)}, 100) == ([(0, 20, 20)], [(20, 0), (20, 1)])
    for bad in (None, "", "{", "[]", "3", '{"web": []}', '{"web": {"results": 3}}'):
        assert asked({0: bad if bad != '{"web": {"results": 3}}' else '{"web": {"results": []}}'})[0] == []
    assert search.results_of(body(1, True)) == ([("https://a0.example/", "t", "")], True)


#: A module with a caller's own function, which the test below names.
CANNED = """
import json


def fetch(run, query, count, page):
    results = [{"url": f"https://a{10 * page + i}.example/"} for i in range(3)]
    return json.dumps({"query": {"more_results_available": page == 0}, "web": {"results": results}}) if run == "x" else None
"""


def test_source(spark, tmp_path):
    search.register(spark)
    rows = [("a", 0, body(20, True)), ("a", 1, body(7, False, 20)), ("a", 2, body(9, True)), ("b", 0, body(0, True)), ("c d", 0, body(2, False))]
    spark.createDataFrame(rows, "run string, page int, value string").write.partitionBy("run", "page").text(str(tmp_path / "s"))
    read = lambda **o: spark.read.format("site_search").options(**o).load()
    got = read(path=str(tmp_path / "s"), query="q in p", limit="20")
    assert got.rdd.getNumPartitions() == 3
    assert {(r.run, r.page): r.n for r in got.groupBy("run", "page").agg({"pos": "count"}).withColumnRenamed("count(pos)", "n").collect()}.items() >= {("a", 0): 20, ("a", 1): 7}.items()
    assert {r.query for r in got.collect()} == {"q in p"} and got.where("run = 'b'").count() == 0
    assert read(path=str(tmp_path / "none")).count() == 0
    (tmp_path / "canned_search.py").write_text(CANNED)
    spark.sparkContext.addPyFile(str(tmp_path / "canned_search.py"))
    assert sorted((r.page, r.pos, r.url) for r in read(fetch="canned_search:fetch", runs="x, y", limit="50").collect()) == [(p, i, f"https://a{10 * p + i}.example/") for p in (0, 1) for i in range(3)]
    for bad in ({}, {"path": "x", "fetch": "y:z"}, {"fetch": "y:z"}):
        with pytest.raises(Exception, match="site_search"):
            read(**bad).count()


def test_run_states(spark, tmp_path):
    """A stream that ends and one that fails: running, then completed and failed, with their batches, rows and error."""
    listener = states.RunStates(spark, str(tmp_path / "states"))
    spark.streams.addListener(listener)
    try:
        for name in ("good", "bad"):
            spark.range(6).repartition(2).write.parquet(str(tmp_path / name))
            rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

            def take(batch, n, name=name):
                if name == "bad" and n == 1:
                    raise ValueError("no second batch")
                batch.collect()

            q = rows.writeStream.queryName(name).foreachBatch(take).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception as e:
                assert "no second batch" in str(e)
        for _ in range(60):  # listeners are told a little later
            got = {r.run_id: r for r in states.states(states.recorded(spark, str(tmp_path / "states"))).collect()}
            if {"good", "bad"} <= got.keys() and {got["good"].status, got["bad"].status} == {"completed", "failed"}:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert (got["good"].status, got["good"].batches, got["good"].rows, got["good"].error) == ("completed", 2, 6, None)
    assert (got["bad"].status, got["bad"].batches) == ("failed", 1) and "no second batch" in got["bad"].error
