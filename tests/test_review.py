"""Change review: golden cases and hot groups."""

import pytest
from pyspark.sql import functions as F

from glasswake.functions.text import process_snippet, redact_snippet
from glasswake.operators import change_review as cr, change_rules as rules
from glasswake.plans.change_review import review_findings, stored_findings

FILES = "review_id bigint, file_ord bigint, path string, additions int, deletions int, patch string"
REVIEWS = "review_id bigint, checks_status string, reviewer_assigned boolean, updated_at date"
DRAFT = "review_id bigint, category string, severity string, score_impact int"


def file_rules(spark, path, *lines):
    df = spark.createDataFrame([(1, 1, path, 1, 0, "\n".join(lines))], FILES)
    return {r.rule_id: r for r in rules.file_findings(df).collect()}


@pytest.mark.parametrize("checks, drafts, score, risk, verdict", [
    ("pass", [], 0, "low", "pass"),
    ("pass", [("exposure", "high", None)], 5, "medium", "block"),
    ("pass", [("security", "high", None)], 5, "medium", "block"),
    ("fail", [], 2, "low", "block"),
    ("pass", [("maintainability", "medium", None)] * 6, 12, "high", "block"),
    ("pass", [("maintainability", "high", 3)], 3, "medium", "review-carefully"),
    ("pass", [("maintainability", "medium", None)], 2, "low", "pass"),
    ("pass", [("maintainability", "medium", None), ("tests", "medium", None)], 4, "medium",
     "review-carefully"),
    ("pass", [("naming", "low", 10)], 10, "high", "review-carefully"),
    ("pass", [("naming", "medium", None)], 1, "low", "pass"),
    ("pass", [("exposure", "medium", 0)], 0, "low", "pass"),
    ("warn", [], 1, "low", "pass"),
])
def test_score(spark, checks, drafts, score, risk, verdict):
    reviews = spark.createDataFrame([(1, checks, None, None)], REVIEWS)
    drafts = spark.createDataFrame([(1, *d) for d in drafts], DRAFT)
    row = cr.score(reviews, drafts).first()
    assert (row.score, row.overall_risk, row.merge_recommendation) == (score, risk, verdict)


def test_file_rules(spark):
    got = file_rules(spark, "src/a.ts", "-app.use(requireAuth)", "+const apiKey = 'abcdefghij1234'",
                     "+const skipAuth = true", "+const active = go()", "+++ b/TODO")
    assert set(got) == {"exposure/removed-auth-guard", "exposure/hardcoded-secret",
                        "exposure/auth-bypass", "naming/boolean-naming"}
    assert got["exposure/hardcoded-secret"].snippet == "const apiKey = '***'"


def test_test_files_are_exempt_except_for_secrets(spark):
    got = file_rules(spark, "src/__tests__/a.test.ts", "+const skipAuth = true",
                     "+const password = 'hunter22'")
    assert set(got) == {"exposure/hardcoded-secret"}


def test_one_vague_name_is_fine(spark):
    assert "naming/vague-abbreviations" not in file_rules(spark, "a.ts", "+const tmp = 1")
    assert "naming/vague-abbreviations" in file_rules(spark, "a.ts", "+const tmp = 1", "+let req = 2")


def test_run_limits(spark):
    for n, impact in ((40, None), (41, 2), (71, 3)):
        got = file_rules(spark, "a.ts", "@@ -1 +1 @@", *["+ go()"] * n).get("maint/complexity-spike")
        assert (got and got.score_impact) == impact


def test_redaction(spark):
    df = spark.createDataFrame([
        ("const token = 'sk_live_abcdef'", "exposure", "x"), ("const x = 'abc'", "exposure", "x"),
        ("Authorization: Bearer abc.def", "security", "x"), ("'abcdefgh'", "naming", "x"),
        ("'abcdefgh'", "naming", "y/secret"), (None, "exposure", "x")],
        "snippet string, category string, rule_id string")
    rows = process_snippet(df, "snippet", "category", "rule_id").collect()
    assert [r.safe_snippet for r in rows] == [
        "const token = [REDACTED]", "const x = 'abc'", "Authorization: Bearer [REDACTED]",
        "'abcdefgh'", "[REDACTED]", None]
    assert [r.revealed_snippet is not None for r in rows] == [True, False, True, False, True, False]
    # a text that already holds the placeholder still counts as redacted
    again = df.select(redact_snippet(F.lit("'[REDACTED]' 'abcdefgh'")).alias("r")).first().r
    assert again.is_redacted


def test_untested_services_hot_review_takes_the_linear_route(spark):
    """Both routes give what brute force gives, for one review with most files."""
    rows = []
    for i in range(120):
        rows.append((1, i, f"src/api/svc{i}.ts", 1, 0, "\n".join(["+return x"] * 3)))
        if i % 3:
            rows.append((1, 1000 + i, f"src/tests/x_svc{i}_spec.ts", 1, 0, None))
    rows += [(2, 1, "src/api/a.ts", 1, 0, "\n".join(["+return x"] * 3)), (2, 2, "src/tests/b.ts", 1, 0, None)]
    facts = cr.file_facts(spark.createDataFrame(rows, FILES))
    services = [(r, p) for r, _, p, _, _, patch in rows if patch]
    tests = [(r, p) for r, _, p, _, _, patch in rows if not patch]
    want = {(r, p) for r, p in services
            if not any(t == r and p.split("/")[-1][:-3] in q for t, q in tests)}
    got = cr.untested_service_files(facts).collect()
    assert {(r.review_id, r.path) for r in got} == want


def test_review_end_to_end_and_rerun(spark, tmp_path):
    from glasswake.sources.sinks import read_reviews, replace_reviews
    reviews = spark.createDataFrame(
        [(i, "pass", True, None) for i in range(20)], REVIEWS)
    files = spark.createDataFrame(
        [(i, 1, "src/a.ts", 1, 0, "+const skipAuth = true") for i in range(20)], FILES)
    out = str(tmp_path / "store")
    found = stored_findings(review_findings(reviews, files, "2024-01-01"))
    assert "snippet" not in found.columns
    replace_reviews(found, reviews, out)
    n = read_reviews(spark, out).count()
    replace_reviews(found, reviews, out)
    assert read_reviews(spark, out).count() == n > 0
    # a clean re-run of one review removes its old findings and nobody else's
    one = reviews.filter("review_id = 3")
    clean = files.filter("review_id = 3").withColumn("patch", F.lit("+ok()"))
    replace_reviews(stored_findings(review_findings(one, clean, "2024-01-01")), one, out)
    left = {r.review_id for r in read_reviews(spark, out).select("review_id").distinct().collect()}
    assert left == set(range(20)) - {3}
