"""Tables of one row group are dealt out before wide columns are built, and rules without a hit leave no row."""

import pytest
from pyspark.sql import functions as F

from checks.views import spark_view
from glasswake.operators import addresses, findings as fi

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["fx_requests", "fx_storage", "fx_console"])
def test_events_are_dealt_out(spark, name):
    df = spark_view(spark, DATA, name)
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_rules_without_a_hit_leave_no_row(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, None, None)], "scan_id long, page_id long, url string")
    rule = lambda i, test: F.when(test, fi.finding("headers", i, severity="low", category="c", title="t", url=F.col("url"),
                                                   evidence=None, confidence="low"))
    got = fi.emit(rows, [rule(0, F.col("url") == "a"), rule(1, F.col("url").isNull()), rule(2, F.lit(False))])
    assert sorted((r.page_id or 0, r.rule_ord) for r in got.collect()) == [(0, 1), (1, 0)]
    assert "array_compact" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_levels_of_parameters(spark):
    urls = ["https://a.example/?token=abcdefgh&key=your-key-here", "https://a.example/x?SID=0123456789abcdef0123456789&pwd=a", "https://a.example/?code=1"]
    rows = spark.createDataFrame([(1, i, i, u) for i, u in enumerate(urls)], "scan_id long, page_id long, item_ord long, url string")
    got = {(r.page_id, r.pos): r.severity for r in addresses.param_findings(rows, "page_url").collect()}
    assert got == {(0, 0): "medium", (0, 1): "low", (1, 0): "high", (1, 1): "medium"}
