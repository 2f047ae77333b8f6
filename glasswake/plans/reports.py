"""Reports as ordered JSON lines.

A report of one scan or review nests lists of any length.  Built as one value, a
scan with a third of all findings would have to fit into one row and one task.  So
a report is a set of lines (id, section, sort keys, JSON text): the bounded parts
(target, summary, options, scenarios, hand-off) are one line each, the open-ended
parts one line per element.  Written in sort order, the lines of one id read as
the nested document from top to bottom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.text import truncate
from glasswake.functions.urls import with_pull_request
from glasswake.operators.content import redact_secrets
from glasswake.operators import change_review as cr, findings as fi, scenarios as sc
from glasswake.operators.responses import content_type

EVIDENCE_LENGTH = 600
# What a reader of the format expects in the head and the hand-off.
REPORT = {"version": "1.0", "reportType": "security_scan_ingestion"}
SOURCE_APP = {"name": "glasswake", "formatVersion": "1.0"}
INTENDED_USE = "ingestion_by_coding_agent"
SECTIONS = ("target", "summary", "options", "finding", "page", "request", "script_domain",
            "scenario", "handoff")
# own wording of the fixed hand-off note
HANDOFF = ("read the scenarios first", "separate real problems from false alarms",
           "work by severity and confidence", "fix cookies, headers and storage first",
           "keep server changes apart", "check high findings by hand")


def evidence_safe(evidence: Column, limit: int = EVIDENCE_LENGTH) -> Column:
    """Evidence for reports: every kind of secret the rules know is hidden, then it is cut."""
    return truncate(redact_secrets(evidence), limit)


def _line(key: str, section: str, keys: list[Column], body: Column, position: int):
    null = F.lit(None)
    keys = (keys + [null] * 5)[:5]
    return [F.col(key), F.lit(position).alias("section_ord"), F.lit(section).alias("section"),
            *[k.cast("string" if i == 1 else "bigint").alias(f"k{i}") for i, k in enumerate(keys)],
            F.to_json(body, {"ignoreNullFields": "false"}).alias("body")]


def _given(df: DataFrame, column: str) -> Column:
    """A column that not every capture has; NULL (and so left out of the JSON) without it."""
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def _literals(values: dict[str, str]) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def ingestion_report(scans: DataFrame, findings: DataFrame, pages: DataFrame,
                     requests: DataFrame, inventory: DataFrame, counts: DataFrame,
                     generated_at: str | None = None) -> DataFrame:
    """Report lines of completed scans.  ``findings`` feeds several parts: persist it.

    started_at and finished_at of scans, created_at of findings, status_code of pages and
    requests and method of requests are reported where the tables have them."""
    done = scans.filter(F.col("status") == "completed")
    ids = done.select("scan_id")
    own = lambda df: df.join(ids, "scan_id", "left_semi")
    head = done.join(counts, "scan_id")
    parts = [
        head.select(*_line("scan_id", "target", [], F.struct(
            *_literals(REPORT), F.lit(generated_at).cast("string").alias("generatedAt"),
            F.struct(*_literals(SOURCE_APP)).alias("sourceApp"),
            F.col("scan_id").alias("scanId"), F.col("target_url").alias("targetUrl"),
            F.col("origin").alias("normalizedOrigin"), "status",
            _given(scans, "started_at").alias("startedAt"), _given(scans, "finished_at").alias("finishedAt"),
            F.col("pages_scanned").alias("pagesScanned"),
            F.col("requests_captured").alias("requestsCaptured")), 0)),
        # a scan has at most 17 categories
        head.join(fi.category_counts(findings).groupBy("scan_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n_findings"))))
            .alias("categories")), "scan_id", "left").select(
            *_line("scan_id", "summary", [], F.struct(
                F.col("findings_count").alias("findingsCount"), F.col("high_count").alias("highCount"),
                F.col("medium_count").alias("mediumCount"), F.col("low_count").alias("lowCount"),
                F.col("info_count").alias("infoCount"),
                F.col("categories").alias("categoryCounts")), 1)),
        done.select(*_line("scan_id", "options", [], F.struct(
            F.coalesce(F.try_parse_json("options_json"), F.parse_json(F.lit("{}"))).alias("scanOptions")), 2)),
        own(findings).select(*_line("scan_id", "finding", [
            fi.severity_rank(F.col("severity")), F.col("category"), F.col("page_id"),
            F.col("det_ord"), F.col("item_ord")], F.struct(
            F.col("finding_id").alias("id"), "severity", "category", "title", "description", "url",
            F.col("asset_url").alias("assetUrl"), evidence_safe(F.col("evidence")).alias("evidence"),
            "confidence", fi.finding_source(F.col("evidence"), F.col("category"), F.col("url"))
            .alias("source"), F.col("page_id").alias("pageId"), fi.request_of().alias("requestId"),
            _given(findings, "created_at").alias("createdAt")), 3)),
        own(pages).select(*_line("scan_id", "page", [F.col("page_id")], F.struct(
            F.col("page_id").alias("id"), "url", "depth", _given(pages, "status_code").alias("statusCode"),
            content_type(F.col("headers")).alias("contentType"), F.col("title")), 4)),
        own(requests).select(*_line("scan_id", "request", [F.col("request_id")], F.struct(
            F.col("request_id").alias("id"), F.col("page_id").alias("pageId"), "url",
            _given(requests, "method").alias("method"), F.col("resource_type").alias("resourceType"),
            _given(requests, "status_code").alias("statusCode"),
            content_type(F.col("response_headers")).alias("contentType")), 5)),
        own(inventory).select(*_line("scan_id", "script_domain", [
            -F.col("script_count"), F.col("origin")], F.struct(
            "origin", "host", F.col("script_count").alias("scriptCount"),
            F.col("has_sri").alias("hasSRI"), F.col("insecure_loads").alias("insecureLoads"),
            F.col("example_urls").alias("exampleUrls")), 6)),
        own(sc.scenarios_with_evidence(findings, inventory)).select(
            *_line("scan_id", "scenario", [F.col("rank")], F.struct(
                F.col("scenario_type").alias("id"), "title", "summary",
                F.col("skill_level").alias("skillLevel"),
                F.col("time_to_discover").alias("timeToDiscover"), "impact", "confidence",
                "recommendation", F.transform("evidence", lambda e: F.struct(
                    e["category"].alias("category"), e["title"].alias("title"), e["url"].alias("url"),
                    e["evidence_snippet"].alias("evidenceSnippet"))).alias("evidence"), "rank"), 7)),
        done.select(*_line("scan_id", "handoff", [], F.struct(
            F.lit(INTENDED_USE).alias("intendedUse"),
            F.array(*map(F.lit, HANDOFF)).alias("recommendedWorkflow"),
            F.struct(F.lit(False).alias("enabled"), F.array().cast("array<string>").alias("instructions"))
            .alias("futurePromptPreset")), 8)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_order(report: DataFrame, key: str) -> DataFrame:
    """One range-partitioned sort; a large report is spread over many tasks."""
    return report.orderBy(key, "section_ord", "k0", "k1", "k2", "k3", "k4")


def scan_export(scans: DataFrame, findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Flat export lines: the scan, its findings, its pages."""
    parts = [
        scans.select(*_line("scan_id", "scan", [], F.struct(
            F.col("scan_id").alias("id"), F.col("target_url").alias("targetUrl"), "status"), 0)),
        findings.select(*_line("scan_id", "finding", [
            fi.severity_rank(F.col("severity")), F.col("category"), F.col("page_id"),
            F.col("det_ord"), F.col("item_ord")], F.struct(
            F.col("finding_id").alias("id"), "severity", "category", "title", "description", "url",
            F.col("asset_url").alias("assetUrl"), evidence_safe(F.col("evidence")).alias("evidence"), "confidence"), 1)),
        pages.select(*_line("scan_id", "page", [F.col("page_id")], F.struct(
            F.col("page_id").alias("id"), "url", "depth", "title"), 2)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def review_report(reviews: DataFrame, stored: DataFrame, summary: DataFrame,
                  focus: DataFrame) -> DataFrame:
    """Review lines: the head (with at most five focus files) and one per finding.
    The revealed snippet never leaves the store; only ``canReveal`` does."""
    top = focus.groupBy("review_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("focus_rank", "path", "severity", "reason"))),
        lambda f: F.struct(f["path"].alias("path"), f["severity"].alias("severity"),
                           f["reason"].alias("reason"))).alias("focusFiles"))
    head = with_pull_request(reviews.join(summary, "review_id").join(top, "review_id", "left"), "pr_url")
    given = lambda c: F.coalesce(_given(reviews, c), F.lit(""))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    lines = head.select(*_line("review_id", "review", [], F.struct(
        F.col("review_id").alias("id"), _given(reviews, "status").alias("status"),
        F.struct(F.col("pr_url").alias("url"), F.concat_ws("/", "owner", "repo").alias("repo"),
                 F.col("pr_number").alias("number"), given("title").alias("title"),
                 given("author").alias("author"), given("head_ref").alias("headRef"),
                 given("base_ref").alias("baseRef"),
                 F.coalesce("checks_status", F.lit("unknown")).alias("checksStatus"),
                 _given(reviews, "review_status").alias("reviewStatus")).alias("pr"),
        F.struct(F.col("overall_risk").alias("overallRisk"),
                 F.col("merge_recommendation").alias("mergeRecommendation"),
                 F.col("high_risk_count").alias("highRiskCount"),
                 F.col("maintainability_status").alias("maintainabilityStatus"),
                 F.col("exposure_risk_count").alias("exposureRiskCount"),
                 F.col("test_gap_count").alias("testGapCount"),
                 F.struct(F.col("logic_pct").alias("logic"), F.col("tests_pct").alias("tests"),
                          F.col("config_pct").alias("config"), F.col("noise_pct").alias("noise"))
                 .alias("anatomy")).alias("summary"),
        "focusFiles",
        F.struct(F.col("reviewer_flag").alias("reviewerAssigned"), F.col("pr_size").alias("prSize"),
                 "stale", "notes").alias("workflow"),
        _given(reviews, "error_message").alias("errorMessage")), 0))
    details = stored.select(*_line("review_id", "finding", [
        rank, F.lit(None), F.col("analyzer_ord"), F.col("file_ord"), F.col("rule_ord")], F.struct(
        "category", "severity", F.col("rule_id").alias("ruleId"), "title", "summary",
        F.col("why_flagged").alias("whyFlagged"), "suggestion",
        F.struct(F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"),
                 F.col("end_line").alias("endLine"), F.col("safe_snippet").alias("snippet"),
                 F.col("is_redacted").alias("isRedacted"),
                 F.col("revealed_snippet").isNotNull().alias("canReveal")).alias("evidence")), 1))
    return lines.unionByName(details)
