"""The matcher called from SQL, against the DataFrame form."""

import pytest

from siteprism.operators import match, match_sql
from siteprism.sources import packs


def test_table_function(spark):
    pack = packs.default_pack()
    rows = [("l", "html", None, "raw_html", "jquery-3.6.0.min.js <link rel=x href=/wp-content/y>"), ("l", "meta", "generator", "meta[generator]", "WordPress 6.1"), ("m", "script_src", None, "s", "https://c.com/jquery-3.6.0.min.js"), ("n", "html", None, "f", "nothing"), ("o", None, None, "f", "x"), ("o", "html", None, "f", None)]
    stacks = spark.createDataFrame(rows, "lead string, source string, qualifier string, field string, text string")
    stacks.createOrReplaceTempView("stacks_to_match")
    match_sql.register(spark, pack.pattern)
    got = spark.sql("SELECT s.lead, s.source, m.name, m.idx, m.version, m.matched_value FROM stacks_to_match s, LATERAL match_signatures(s.source, s.qualifier, s.text) m WHERE NOT m.failed").collect()
    want = match.match_batched(stacks.where("source is not null and text is not null"), pack.pattern).select("lead", "source", "name", "idx", "version", "matched_value").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(got) >= 3
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM match_signatures('html', NULL, 5)").collect()
