"""Site scan: addresses, context search, dedup, skew, streaming."""

import re

import pytest
from pyspark.sql import functions as F

from glasswake.functions import urls as U
from glasswake.functions.text import Search, with_context_matches
from glasswake.operators import clientstate, findings as fi
from glasswake.streaming import live


@pytest.mark.parametrize("raw, want", [
    ("example.com", "https://example.com/"), (" HTTP://Example.COM:80/a/ ", "http://example.com/a"),
    ("https://a.b/x?q=1#f", "https://a.b/x?q=1"), ("https://", None),
])
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert U.with_normalized(df, "raw", "n").first().n == want


@pytest.mark.parametrize("ref, want", [
    ("/a b", "https://h.io/a%20b"), ("../x", "https://h.io/x"), ("./y?z", "https://h.io/p/y?z"),
    ("//cdn.io/s.js", "https://cdn.io/s.js"), ("?k=1", "https://h.io/p/q?k=1"),
    ("http://O.org:80", "http://o.org/"), ("mailto:a@b", "mailto:a@b"), ("é", "https://h.io/p/%C3%A9"),
    ("http://bad host/", None),
])
def test_resolve(spark, ref, want):
    df = spark.createDataFrame([(ref, "https://h.io/p/q?old=1#f")], "ref string, base string")
    assert U.with_resolved(df, "ref", "base", "out").first().out == want


def test_canonical_sort_is_stable(spark):
    df = spark.createDataFrame([("https://h.io/a/?b=2&a=9&b=1&c#x",), ("nonsense",)], "u string")
    got = [r.k for r in U.with_canonical(df, "u", "k").collect()]
    assert got == ["https://h.io/a?a=9&b=2&b=1&c=", "nonsense"]


def test_context_matches_equal_python(spark):
    pattern, width = r"ab[0-9]", 10
    texts = ["", "ab1", "xxab1ab2ab3 " * 9, "ab1" * 40, "q" * 30 + "ab7" + "z" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    df = with_context_matches(df, "content", [Search("m", "true", pattern, (0,), width, 3)])
    for text, row in zip(texts, df.collect()):
        want = [(m.group(), text[max(0, m.start() - width):m.start()], text[m.end():m.end() + width])
                for m in re.finditer(pattern, text)]
        assert [(m.whole, m.left, m.right) for m in row.m or []] == want


FINDING = ("scan_id bigint, page_id bigint, det_ord int, item_ord bigint, rule_ord int, pos int, "
           "severity string, category string, title string, description string, url string, "
           "asset_url string, evidence string, confidence string")


def _finding(page, det, item, title, evidence):
    return (1, page, det, item, 0, 0, "low", "c", title, "", "u", None, evidence, "high")


def test_dedup_first_wins_and_is_idempotent(spark):
    df = spark.createDataFrame([
        _finding(1, 3, 2, "late", "x" * 60), _finding(1, 3, 1, "early", "x" * 50 + "other"),
        _finding(2, 3, 1, "page two", "x" * 60), _finding(1, 21, 0, "b1", "y"), _finding(1, 21, 1, "b2", "y"),
    ], FINDING)
    once = fi.deduplicate(df)
    assert {r.title for r in once.collect()} == {"early", "page two", "b1", "b2"}
    assert fi.deduplicate(once).count() == 4
    assert {r.title for r in fi.deduplicate(df, strict=True).collect()} == {
        "early", "late", "page two", "b1", "b2"}


def test_hot_group_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([_finding(1, 3, i, "t", "same") for i in range(50)], FINDING)
    plan = fi.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_console_stops_at_first_trace(spark):
    rows = [(1, 1, "u", 1, "error", "at /var/x"), (1, 1, "u", 2, "log", "at f (a)"),
            (1, 1, "u", 3, "warning", "at f (a.js)"), (1, 1, "u", 4, "error", "/etc/late"),
            (1, 2, "u", 9, "error", "/home/only")]
    df = spark.createDataFrame(
        rows, "scan_id bigint, page_id bigint, url string, ord bigint, type string, text string")
    got = {(r.page_id, r.item_ord) for r in clientstate.console_findings(df).collect()}
    assert got == {(1, 1), (1, 3), (2, 9)}


def test_streaming_scan_counts_and_dedup(spark, tmp_path):
    schema = ("scan_id bigint, page_id bigint, url string, cookie_ord bigint, name string, "
              "http_only boolean, secure boolean, same_site string, expires bigint, ts timestamp")
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rule = lambda df: clientstate.cookie_findings(df, 1704067200, ("httponly",))
    for k in range(2):
        (spark.range(10).select(
            F.lit(1).cast("bigint").alias("scan_id"), F.lit(1).cast("bigint").alias("page_id"),
            F.lit("https://a.io").alias("url"), (F.col("id") + 10 * k).alias("cookie_ord"),
            F.lit("sid").alias("name"), F.lit(False).alias("http_only"), F.lit(True).alias("secure"),
            F.lit("Lax").alias("same_site"), F.lit(None).cast("bigint").alias("expires"),
            F.lit("2024-01-01").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(src))
        arriving = live.read_arriving(spark, src, spark.read.parquet(src).schema)
        q = live.scan_batches(arriving, rule, out, cp).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.read.parquet(out).count() == 10 * (k + 1)
    found = rule(live.read_arriving(spark, src, spark.read.parquet(src).schema))
    q = (live.live_counts(found).writeStream.outputMode("complete").format("memory")
         .queryName("counts").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("counts").collect()] == [(1, "high", 20)]
    arriving = live.read_arriving(spark, src, spark.read.parquet(src).schema)
    stream = arriving.select("scan_id", "page_id", "url", "ts", F.lit("c").alias("category"),
                             F.lit("e").alias("evidence"))
    q = (live.first_seen(stream, "ts", "1 hour").writeStream.format("memory").queryName("seen")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.table("seen").count() == 1
