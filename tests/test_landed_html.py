"""Pages landed as HTML files and read back."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from siteprism.functions import html
from siteprism.functions import text as T
from siteprism.sources import leads, shared

PAGES = [
    (7, "<title>é &amp; ü</title><form ><a href='/x'>x</a>\r\n"), (7, '<a href="/a">a</a><a href="https://o.example/b">b</a>'), (-3, "\n\n<p>two\n"), (12, ""), (None, "<form>"), (8, 'x\ry "quoted" \\ \u2028 <b>'),
]


def _files(at):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(at) for f in names)


def _told(rows):
    return sorted((str(k), page) for k, page in rows)


@pytest.fixture
def odd(spark, tmp_path):
    rows = [(k, f"https://e.example/{i}", page) for i, (k, page) in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/in/pages.parquet")
    return f"{tmp_path}/in"


def test_odd_pages_against_sql(spark, odd):
    """Twice the same id, a negative one and none, line ends of every kind, no html at all."""
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{odd}/pages.parquet/*.parquet')")
    names = ["page_id", "size", "has_form", "html_md5"]
    told = [tuple(r) for r in entry.queries()["landed_html"](spark, odd).select(*names).collect()]
    assert sorted(told, key=repr) == sorted(con.sql(entry.oracle_sql()["landed_html"]).select(*names).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["sf0.001", "none"])
def test_query_against_sql(spark, tiny, tmp_path, name):
    at = tiny
    if name == "none":
        spark.read.parquet(f"{tiny}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
        at = str(tmp_path)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{at}/pages.parquet{'/*.parquet' if name == 'none' else ''}')")
    out = entry.queries()["landed_html"](spark, at)
    sql = con.sql(entry.oracle_sql()["landed_html"]).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(sql.fetchall())


def test_a_file_for_each_page_and_nothing_else(spark, tmp_path, monkeypatch):
    """Folders and readings are bounded, whatever the number of pages; every file is read once."""
    monkeypatch.setattr(leads, "FOLDER_FILES", 10)
    monkeypatch.setattr(leads, "READ_FILES", 25)
    pages = spark.range(0, 90, 1, 3).selectExpr("id as page_id", "concat('<p>', id, '</p>') as html")
    at = f"{tmp_path}/a blank, 100% #1"
    groups = leads.write_html(pages, f"file://{at}")
    files = _files(at)
    assert len(files) == 90 and all(re.search(r"/\d+-\d+-\d+/page_id=\d+-\d+\.html$", f) for f in files)
    assert max(len(os.listdir(f"{at}/{d}")) for d in os.listdir(at)) == 10
    assert [len(g) for g in groups] == [2, 2, 2, 2, 1] and len({f for g in groups for f in g}) == 9
    os.makedirs(f"{at}/0-99-0")
    with open(f"{at}/0-99-0/page_id=5-5.html", "w") as f:  # of an attempt that failed
        f.write("<p>")
    back = leads.read_html(spark, groups, lambda rows: rows.selectExpr("regexp_extract(id, 'page_id=([0-9]+)', 1) as page_id", "raw_html"))
    assert _told(back.collect()) == _told((k, f"<p>{k}</p>\n") for k in range(90))
    assert spark.conf.get(leads.OPEN_COST[0]) != leads.OPEN_COST[1]


def test_leads_of_files_are_read_once(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.html").write_text("<title>One</title><a href='/a'>A</a>")
    got = leads.leads_from_html(spark, f"{tmp_path}/*/*")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Join" not in plan
    (row,) = got.collect()
    assert row.raw_html == "<title>One</title><a href='/a'>A</a>" and row.id.endswith("/x/one.html") and row.page_title == "One" and row.url == "https://example.com/"
    assert got.columns == ["page_id", "raw_html", "id", "url", *[f.split()[0] for f in re.split(r", ?(?![^<]*>)", html.SIGNALS)]]


def test_other_stores_get_spark_s_writer(spark, tmp_path):
    (tmp_path / "store").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.landed.link./at", f"file://{tmp_path}/store")
    path = "viewfs://landed/at/html"
    pages = spark.createDataFrame([(k, p) for k, p in PAGES if k != 7], "page_id long, html string")
    groups = leads.write_html(pages, path)
    assert groups == [[path]]
    back = leads.read_html(spark, groups, lambda rows: rows.selectExpr("try_cast(regexp_extract(id, 'page_id=(-?[0-9]+)', 1) as long) as page_id", "raw_html"))
    assert _told(back.collect()) == _told((k, f"{p}\n") for k, p in PAGES if k != 7)


def test_local_path(spark):
    told = {"/a/b": "/a/b", "file:/a b%20": "/a b%20", "file:///a": "/a", "file://host/a": None, "s3a://bucket/a": None, "hdfs:///a": None, "a/b": None}
    assert {p: shared.local_path(spark, p) for p in told} == told


def test_faster_forms_tell_the_same():
    said = "ABC ÀÉ İ ſ Kelvin K 503-555-1234 and (503) 555 1234, +1.503.555.1234 x@y.example 12345678 ٣٤٥-٣٤٥-٣٤٥٦"
    got = html.signals_of(f"<body>{said} BOOK NOW</body>", "https://e.example/")
    assert got["phone_number"] == "5035551234" and got["email_address"] == "x@y.example" and got["has_booking_signal"]
    for t in ("", "55 1234", "503.5551234", "5035551234", "1 503 555-1234", said):
        assert not re.search(T.PHONE, t) or re.search(T.PHONE_END, t)
