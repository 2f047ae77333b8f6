"""Third-party scripts: integrity and mixed-content rules, inventory per origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glasswake.functions.html import script_tags
from glasswake.functions.urls import with_url
from glasswake.operators.findings import KEYS, emit, finding, first_per


def third_party_tags(pages: DataFrame) -> DataFrame:
    """Script tags whose origin is not the page's, with ``is_first`` on the first tag
    without integrity per page and origin."""
    tags = with_url(script_tags(pages, KEYS), "script_url", "s")
    tags = with_url(tags, "url", "p")
    return (tags.withColumn("origin", F.col("s")["origin"])
            .filter(F.col("origin") != F.col("p")["origin"]).drop("s", "p"))


def script_findings(pages: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    tags = third_party_tags(pages)
    evidence = lambda tail: F.concat(F.lit('<script src="'), F.col("src"), F.lit('"> — '), tail)
    common = dict(url=F.col("url"), asset_url=F.col("script_url"), item=F.col("tag_ord"),
                  confidence="high")
    parts = []
    if not only or "missing_sri" in only:
        first = first_per(tags.filter(~F.col("has_integrity")), [*KEYS, "origin"], ["tag_ord"])
        parts.append(emit(first, [finding(
            "scripts", 0, severity="low", category="missing_sri",
            title="Third-party script loaded without Subresource Integrity",
            description="A changed file on that host would run unnoticed.",
            evidence=evidence(F.concat(F.lit("no integrity attribute; origin: "), F.col("origin"))),
            **common)]))
    if not only or "mixed_content" in only:
        mixed = tags.filter(F.col("url").startswith("https://")
                            & F.col("script_url").startswith("http://"))
        parts.append(emit(mixed, [finding(
            "scripts", 1, severity="high", category="mixed_content",
            title="HTTPS page loads script over HTTP (mixed content)",
            description="The script can be replaced on its way to the browser.",
            evidence=evidence(F.lit("loaded over HTTP on an HTTPS page")), **common)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def third_party_requests(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """Script requests outside the scan's own origin; a scan that has no row has no origin
    of its own, so all its scripts are third party."""
    rows = with_url(requests.filter(F.col("resource_type") == "script"), "url", "u")
    rows = rows.filter("u IS NOT NULL").withColumn("origin", F.col("u")["origin"]).withColumn(
        "host", F.regexp_replace(F.col("u")["netloc"], r":\d+\z", "")).drop("u")
    own = scans.select("scan_id", F.col("origin").alias("scan_origin"))
    return rows.join(own, "scan_id", "left").filter(~F.col("origin").eqNullSafe(F.col("scan_origin")))


def origins_without_integrity(findings: DataFrame) -> DataFrame:
    rows = with_url(findings.filter(
        (F.col("category") == "missing_sri") & F.col("asset_url").isNotNull()), "asset_url", "u")
    return rows.select("scan_id", F.col("u")["origin"].alias("origin")).filter(
        "origin IS NOT NULL").distinct()


def example_urls(requests: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` request URLs per scan and origin, in request order."""
    top = first_per(requests, ["scan_id", "origin"], ["request_id"], n)
    return top.groupBy("scan_id", "origin").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("request_id", "url"))),
        lambda r: r["url"]).alias("example_urls"))


def script_inventory(requests: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per (scan, third-party origin).  Requests are counted with map-side
    partial aggregation and ranked with a per-partition limit before any shuffle."""
    rows = third_party_requests(requests, scans)
    counts = rows.groupBy("scan_id", "origin", "host").agg(
        F.count("*").alias("script_count"),
        F.count_if(F.col("url").startswith("http://")).alias("insecure_loads"))
    bare = origins_without_integrity(findings).withColumn("_bare", F.lit(True))
    return (counts.join(example_urls(rows), ["scan_id", "origin"])
            .join(bare, ["scan_id", "origin"], "left")
            .withColumn("has_sri", F.col("_bare").isNull()).drop("_bare"))
