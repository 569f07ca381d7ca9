"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

#: One of each kind; the whole list is compared by the driver at the next size.
CASES = (
    "url_host", "internal_link_top3", "word_gate_counts", "first_nonempty", "doc_phone", "robots_gate", "qualify_status", "final_status", "tier2_enrich", "sig_headers", "resolve_requires", "resolve_implies", "dedup_best", "blocklist_downgrade", "pack_stats",
    "read_recent_leads", "read_run_leads", "read_recent_runs", "console_search", "lead_provenance", "technologies_found", "write_path_technologies", "html_signal_flags", "stream_evaluate", "stream_first_in_run", "stream_tier2",
    "dom_select", "dom_company", "dom_address", "dom_signals", "wire_leads", "landed_leads", "ipv6_gate", "ipv6_networks", "url_references", "fixed_lists", "fixed_words", "pack_patterns", "pack_counts", "library_patterns", "search_source",
    "stream_technologies", "stream_run_states", "stream_limited_calls", "lead_fields", "json_lines", "sig_prefilter",
)


def plain(x):
    return None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", CASES)
def test_query(spark, tiny, name):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{tiny}/{f}')")
    out = entry.queries()[name](spark, tiny)
    sql = con.sql(entry.oracle_sql()[name])
    order = sorted(out.columns)
    assert order == sorted(sql.columns)
    key = lambda rows: sorted(repr(tuple(map(plain, r))) for r in rows)
    assert key(tuple(r) for r in out.select(*order).collect()) == key(sql.select(*order).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
