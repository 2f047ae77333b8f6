"""Registered queries against their SQL counterparts on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.oracle import ORACLE
from checks.queries import QUERIES, Views
from checks.views import TABLES

DATA = "/root/testdata/sf0.001"
NAMES = [
    "html_links", "url_canonical", "redact_snippet", "missing_headers", "csp_object_src",
    "cookie_samesite", "storage_json", "console_leak", "url_params", "pw_scan", "match_snippet",
    "suspicious_endpoints", "missing_sri", "probe_json", "bundle_scan", "crawl_frontier", "site_scan",
    "severity_counts", "sc_ranked", "sc_evidence", "script_inventory", "ingestion_report",
    "rv_secret", "rv_complexity", "rv_term_drift", "rv_untested_service", "rv_score",
    "rv_focus_files", "review_report", "scan_documents", "review_store", "pr_quarantine", "patch_line_numbers", "page_storage_items", "page_content_type",
    "international_hosts", "asset_store", "probe_filter", "naming_plural", "checks_rollup",
]


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def views(spark):
    """One set of views for all tests, so that shared finding tables are built once."""
    return Views(spark, DATA)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(views, duck, name):
    df = QUERIES[name](views)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert got
