"""The change review: pull requests and their files in, findings and verdicts out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glasswake.functions.text import process_snippet
from glasswake.operators import change_review as cr


def review_findings(reviews: DataFrame, files: DataFrame, as_of: str,
                    wording: DataFrame | None = None, **how) -> DataFrame:
    """``how``: see ``all_findings``."""
    found = cr.all_findings(reviews, files, as_of, **how)
    return cr.overlay(found, wording) if wording is not None else found


def stored_findings(findings: DataFrame) -> DataFrame:
    """What is written: the raw snippet is replaced by its safe forms."""
    return process_snippet(findings, "snippet", "category", "rule_id").drop("snippet")


def review_summary(reviews: DataFrame, files: DataFrame, findings: DataFrame,
                   as_of: str, review: DataFrame | None = None) -> DataFrame:
    """One row per review: score, risk, recommendation, counters, anatomy, workflow.
    ``review``: the facts of the reviews, if they have been made.

    Every join side has one row per review and is partitioned by review_id already.
    """
    if review is None:
        review = cr.review_facts(cr.file_facts(files))
    out = cr.score(reviews, findings)
    out = out.join(cr.finding_summary(reviews, findings), "review_id")
    out = out.join(cr.anatomy(reviews, review), "review_id")
    flow = cr.workflow_summary(reviews, review, as_of).withColumnRenamed(
        "reviewer_assigned", "reviewer_flag")
    return out.join(flow, "review_id")


def startable(work: DataFrame, kind: str) -> DataFrame:
    """Work that may start: new scans; new or failed reviews."""
    allowed = ("pending",) if kind == "scan" else ("pending", "failed")
    return work.filter(work["status"].isin(*allowed))
