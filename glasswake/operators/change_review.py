"""Rules and summaries over whole changes (pull requests).

``file_facts`` reduces every file to a few integers on its own row;
``review_facts`` folds them per review in one partially aggregated shuffle.  No
review, however many files it has, is ever collected into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.patch import split_patch
from glasswake.functions.paths import base_name, file_class, is_logic, is_service, is_test
from glasswake.operators.change_rules import (
    LOGIC_LINES, REVIEW_FIELDS, SYNONYMS, TEXT_FIELDS, emit_reviews, explode_hits, group_masks,
    logic_line_count, lowered, review_finding, term_mask, with_hits,
)
from glasswake.operators.findings import first_per
from glasswake.plans.lineage import cut

# ---- fixed values -----------------------------------------------------------
LARGE_FILES, LARGE_LINES, MEDIUM_FILES, MEDIUM_LINES, STALE_DAYS = 15, 400, 5, 100, 7
WEIGHTS = {
    "exposure": {"high": 5, "medium": 3, "low": 1},
    "security": {"high": 5, "medium": 3, "low": 1},
    "maintainability": {"high": 3, "medium": 2, "low": 0},
    "naming": {"high": 1, "medium": 1, "low": 0},
    "tests": {"high": 3, "medium": 2, "low": 0},
    "workflow": {"high": 2, "medium": 1, "low": 0},
    "logic": {"high": 3, "medium": 2, "low": 0},
}
CHECK_POINTS = {"fail": 2, "warn": 1}
HIGH_RISK, MEDIUM_RISK, BLOCK_SCORE = 7, 3, 12
FOCUS_FILES, ENRICHED = 5, 5
GRAM = 3
REVIEW_SEVERITY = {"high": 3, "medium": 2, "low": 1}


FACTS = ["review_id", "file_ord", "path", "additions", "deletions", "file_class", "is_test", "is_service",
         "logic_changed", "terms"]


def _facts(files: DataFrame) -> DataFrame:
    """Adds the facts to files with the columns of ``lowered`` (no term holds a sign)."""
    path = F.col("path")
    return files.withColumns({
        "additions": F.coalesce("additions", F.lit(0)), "deletions": F.coalesce("deletions", F.lit(0)),
        "file_class": file_class(path), "is_test": is_test(path), "is_service": is_service(path),
        "logic_changed": is_logic(path) & (logic_line_count() >= LOGIC_LINES),
        "terms": term_mask(F.col("low"))})


def file_facts(files: DataFrame) -> DataFrame:
    """Per file: class and test flags, logic change, synonym bits.  No shuffle."""
    keep = files.select("review_id", "file_ord", "path", "additions", "deletions", "patch")
    return _facts(lowered(split_patch(keep))).select(*FACTS)


def file_results(files: DataFrame, texts: bool = True) -> DataFrame:
    """Facts and ``hits`` (the findings of all file rules; see ``with_hits``) of every file, in one pass over its
    patch and without a shuffle."""
    keep = files.select("review_id", "file_ord", "path", "additions", "deletions", "patch")
    return _facts(with_hits(lowered(split_patch(keep)), texts=texts)).select(*FACTS, "hits")


def review_facts(facts: DataFrame) -> DataFrame:
    """Per review: totals, classes, synonym bits, first files of interest."""
    first = lambda cond: F.expr(f"min_by(path, file_ord) FILTER (WHERE {cond})")
    aggs = [
        F.count("*").alias("n_files"), F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"), F.bit_or("terms").alias("terms"),
        first("true").alias("first_path"),
        F.count_if("is_test").alias("n_tests"),
        F.count_if("logic_changed").alias("n_logic"),
        F.count_if(F.col("logic_changed") & F.col("is_service")).alias("n_service"),
        first("logic_changed").alias("first_logic"),
    ]
    for c in ("logic", "tests", "config", "noise"):
        aggs.append(F.count_if(F.col("file_class") == c).alias(f"n_{c}_class"))
    for i, mask in enumerate(group_masks()):
        aggs.append(first(f"bit_count(terms & {mask}) >= 2").alias(f"drift_{i}"))
    return facts.groupBy("review_id").agg(*aggs)


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("review_id").agg(
        F.count("*").alias("n_files"),
        F.sum(F.coalesce("additions", F.lit(0))).alias("additions"),
        F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"))


def term_drift(review: DataFrame) -> DataFrame:
    """Two or more synonyms of one group anywhere in the change."""
    rules, bit = [], 0
    for i, (group, mask) in enumerate(zip(SYNONYMS, group_masks())):
        found = F.array_join(F.array_compact(F.array(*[
            F.when(F.col("terms").bitwiseAND(1 << (bit + k)) != 0, F.lit(t))
            for k, t in enumerate(group)])), " / ")
        bit += len(group)
        rules.append(F.when(
            F.bit_count(F.col("terms").bitwiseAND(mask)) >= 2, review_finding(
                "naming", -1, i, "naming/domain-term-drift", "naming", "medium",
                F.concat(F.lit("Several words for one thing: "), found),
                F.coalesce(F.col(f"drift_{i}"), F.col("first_path"), F.lit("")), found, 1)))
    return emit_reviews(review, rules)


def missing_tests(review: DataFrame) -> DataFrame:
    """Logic changed and no test file is part of the change."""
    severity = F.when(F.col("n_service") > 0, "high").otherwise("medium")
    return emit_reviews(review.filter((F.col("n_logic") > 0) & (F.col("n_tests") == 0)), [
        review_finding(
            "tests", 0, 1, "tests/no-test-update", "tests", severity,
            F.concat(F.col("n_logic").cast("string"), F.lit(" changed logic files without tests, first: "),
                     F.col("first_logic")),
            F.col("first_logic"), None, F.when(F.col("n_service") > 0, 3).otherwise(2))])


def _grams(text: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters."""
    ends = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(ends, lambda i: F.substring(text, i, F.lit(n)))))


def untested_service_files(facts: DataFrame) -> DataFrame:
    """Changed service files whose base name occurs in no test path of the change.

    "Occurs in" is no equality.  A path that holds a name holds all its pieces of GRAM
    characters (shorter names are one piece), so each name looks for the piece that the
    fewest test paths of the review have, in an index of the pieces of those paths, and only
    what it finds is compared.  Names with a piece that no path has need no comparison.
    """
    is_service = F.col("logic_changed") & F.col("is_service")
    service = facts.filter(is_service).select(
        "review_id", "file_ord", "path", base_name(F.col("path")).alias("base"))
    tests = facts.filter("is_test").select("review_id", F.col("path").alias("test_path")).distinct()
    reviews = tests.select("review_id").distinct()
    # only a change with tests can leave a service without one (no tests at all is another rule)
    service = service.join(reviews, "review_id", "left_semi")
    names = service.select("review_id", "base").distinct()
    short = F.least(F.length("base"), F.lit(GRAM))
    pieces = names.select("review_id", "base", F.explode(F.coalesce(*[
        F.when(short == n, _grams(F.col("base"), n)) for n in range(1, GRAM + 1)])).alias("gram"))
    index = tests.select("review_id", "test_path", F.explode(F.flatten(F.array_compact(F.array(*[
        _grams(F.col("test_path"), n) for n in range(1, GRAM + 1)])))).alias("gram"))
    # names shorter than a piece are rare: what they do not ask for is left out early
    asked = pieces.select("review_id", "gram").distinct()
    index = index.join(asked, ["review_id", "gram"], "left_semi")
    counts = index.groupBy("review_id", "gram").agg(F.count("*").alias("n"))
    rarest = (pieces.join(counts, ["review_id", "gram"], "left").na.fill(0, ["n"])
              .groupBy("review_id", "base").agg(F.min(F.struct("n", "gram")).alias("least"))
              .where("least.n > 0").select("review_id", "base", "least.gram"))
    covered = (rarest.join(index, ["review_id", "gram"]).where(F.col("test_path").contains(F.col("base")))
               .select("review_id", "base").distinct())
    return (service.where("base <> ''").join(covered, ["review_id", "base"], "left_anti")
            .select("review_id", "file_ord", "path", "base"))


def untested_services(facts: DataFrame) -> DataFrame:
    per_review = untested_service_files(facts).groupBy("review_id").agg(
        F.count("*").alias("n"), F.min_by("path", "file_ord").alias("path"))
    return emit_reviews(per_review, [review_finding(
        "tests", 0, 2, "tests/service-without-test", "tests", "medium",
        F.concat(F.col("n").cast("string"), F.lit(" changed service files without a matching test, first: "),
                 F.col("path")), F.col("path"), None, 2)])


def _per_review(reviews: DataFrame, review: DataFrame) -> DataFrame:
    keep = review.select("review_id", "n_files", "additions", "deletions", "first_path",
                         *[f"n_{c}_class" for c in ("logic", "tests", "config", "noise")])
    return reviews.join(keep, "review_id", "left").na.fill(
        0, ["n_files", "additions", "deletions", "n_logic_class", "n_tests_class",
            "n_config_class", "n_noise_class"])


def pr_size() -> Column:
    n, a = F.col("n_files"), F.col("additions")
    return (F.when((n > LARGE_FILES) | (a > LARGE_LINES), "large")
            .when((n > MEDIUM_FILES) | (a > MEDIUM_LINES), "medium").otherwise("small"))


def _age_days(as_of: str) -> Column:
    seconds = (F.unix_timestamp(F.lit(as_of).cast("timestamp"))
               - F.unix_timestamp(F.col("updated_at").cast("timestamp")))
    return seconds / 86400


def workflow_findings(reviews: DataFrame, review: DataFrame, as_of: str,
                      only: tuple[str, ...] | None = None) -> DataFrame:
    df = _per_review(reviews, review).withColumn("_days", _age_days(as_of))
    text = lambda c: F.col(c).cast("string")
    days = F.floor(F.col("_days") + 0.5).cast("string")
    changed = F.concat(text("n_files"), F.lit(" files changed, +"), text("additions"),
                       F.lit(" -"), text("deletions"))
    rules = {
        "size": F.when(pr_size() == "large", review_finding(
            "workflow", 0, 1, "workflow/large-pr", "workflow", "medium", changed,
            F.coalesce("first_path", F.lit("")), changed, 1)),
        "reviewer": F.when(~F.coalesce("reviewer_assigned", F.lit(False)), review_finding(
            "workflow", 0, 2, "workflow/no-reviewer", "workflow", "low",
            "Nobody is asked to review this change.", "", None, 0)),
        "stale": F.when(F.col("_days") > STALE_DAYS, review_finding(
            "workflow", 0, 3, "workflow/stale-pr", "workflow", "low",
            F.concat(F.lit("Days since the last update: "), days), "",
            F.concat(F.lit("Last updated: "), F.date_format("updated_at", "M/d/yyyy")), 0)),
        "checks": F.when(F.col("checks_status") == "fail", review_finding(
            "workflow", 0, 4, "workflow/checks-failing", "workflow", "high",
            "At least one check fails.", "", "checksStatus: fail", 2)),
    }
    return emit_reviews(df, [r for k, r in rules.items() if not only or k in only])


def workflow_notes(as_of: str) -> Column:
    """Notes in fixed order; needs the columns of ``_per_review``."""
    text = lambda c: F.col(c).cast("string")
    days = _age_days(as_of)
    return F.array_compact(F.array(
        F.when(pr_size() == "large", F.concat(
            F.lit("Large PR: "), text("n_files"), F.lit(" files, +"), text("additions"),
            F.lit(" lines"))),
        F.when(~F.coalesce("reviewer_assigned", F.lit(False)), F.lit("No reviewer assigned")),
        F.when(days > STALE_DAYS, F.concat(
            F.lit("Stale: last updated "), F.floor(days + 0.5).cast("string"), F.lit(" days ago"))),
        F.when(F.col("checks_status") == "fail", F.lit("CI checks failing"))
        .when(F.col("checks_status") == "warn", F.lit("CI checks have warnings"))))


def workflow_summary(reviews: DataFrame, review: DataFrame, as_of: str) -> DataFrame:
    df = _per_review(reviews, review)
    return df.select(
        "review_id", "n_files", "additions", "deletions",
        F.coalesce("reviewer_assigned", F.lit(False)).alias("reviewer_assigned"),
        pr_size().alias("pr_size"), F.coalesce(_age_days(as_of) > STALE_DAYS, F.lit(False)).alias("stale"),
        workflow_notes(as_of).alias("notes"))


def anatomy(reviews: DataFrame, review: DataFrame) -> DataFrame:
    """Rounded share of each file class; logic takes the rest to 100."""
    df = _per_review(reviews, review)
    n = F.col("n_files")
    share = lambda c: F.when(n == 0, 0).otherwise(
        F.floor(F.try_divide(F.col(f"n_{c}_class") * 100, n) + 0.5)).cast("int")
    df = df.select("review_id", *[share(c).alias(f"{c}_pct") for c in ("tests", "config", "noise")])
    rest = 100 - F.col("tests_pct") - F.col("config_pct") - F.col("noise_pct")
    return df.withColumn("logic_pct", rest)


def analysed(files: DataFrame, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """``file_results`` and the facts of each review, both written.  Each patch is read once."""
    results = cut(file_results(files, texts))
    return results, cut(review_facts(results.drop("hits")))


def all_findings(reviews: DataFrame, files: DataFrame, as_of: str, texts: bool = True, again: bool = False,
                 made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every review finding of every analyzer, without the columns TEXT_FIELDS unless ``texts``.

    Three analyzers share what ``analysed`` wrote (``made``, if it is there already); what the search for
    untested services reads several times is written too.  With ``again`` the findings may be read
    several times: those of files come from the written hits each time, the others are written."""
    results, review = made or analysed(files, texts)
    facts = results.drop("hits")
    asked = cut(facts.where(F.col("is_test") | F.col("logic_changed") & F.col("is_service"))
                .select("review_id", "file_ord", "path", "is_test", "is_service", "logic_changed"))
    rest = term_drift(review)
    for part in (missing_tests(review), untested_services(asked), workflow_findings(reviews, review, as_of)):
        rest = rest.unionByName(part)
    if not texts:
        rest = rest.drop(*TEXT_FIELDS)
    return explode_hits(results, texts).unionByName(cut(rest) if again else rest)


ORDER = ["analyzer_ord", "file_ord", "rule_ord"]


def weight() -> Column:
    """Impact of a finding: its own value (0 counts), else the table's."""
    pairs = [F.lit(x) for c, row in WEIGHTS.items() for s, w in row.items() for x in (f"{c}/{s}", w)]
    table = F.create_map(*pairs)
    key = lambda cat: F.concat(cat, F.lit("/"), F.col("severity"))
    known = F.col("category").isin(*WEIGHTS)
    category = F.when(known, F.col("category")).otherwise("logic")
    return F.coalesce("score_impact", F.try_element_at(table, key(category)), F.lit(0))


def score(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Score, risk and recommendation; reviews without findings are scored too."""
    sensitive = (F.col("severity") == "high") & F.col("category").isin("exposure", "security")
    sums = findings.groupBy("review_id").agg(
        F.sum(weight()).alias("_sum"), F.count_if(F.col("severity") == "high").alias("high_risk_count"),
        F.count_if(sensitive).alias("_sensitive"))
    df = reviews.select("review_id", "checks_status").join(sums, "review_id", "left").na.fill(
        0, ["_sum", "high_risk_count", "_sensitive"])
    checks = F.lit(0)
    for status, n in CHECK_POINTS.items():
        checks = F.when(F.col("checks_status") == status, n).otherwise(checks)
    df = df.withColumn("score", F.col("_sum") + checks)
    s = F.col("score")
    block = (F.col("_sensitive") > 0) | F.coalesce(F.col("checks_status") == "fail", F.lit(False)) | (s >= BLOCK_SCORE)
    return df.select(
        "review_id", "score",
        F.when(s >= HIGH_RISK, "high").when(s >= MEDIUM_RISK, "medium").otherwise("low").alias("overall_risk"),
        F.when(block, "block").when((s >= MEDIUM_RISK) | (F.col("high_risk_count") > 0), "review-carefully")
        .otherwise("pass").alias("merge_recommendation"), "high_risk_count")


def focus_files(findings: DataFrame, n: int = FOCUS_FILES) -> DataFrame:
    """Up to ``n`` files per review to look at first, with the reason."""
    rank = F.lit(0)
    for s, r in REVIEW_SEVERITY.items():
        rank = F.when(F.col("severity") == s, r).otherwise(rank)
    has = lambda *c: F.max(F.col("category").isin(*c).cast("int"))
    # one integer carries the order of first appearance
    seen = (F.col("analyzer_ord").cast("bigint") * (1 << 58)
            + (F.col("file_ord") + 1).cast("bigint") * (1 << 8) + F.col("rule_ord"))
    per_file = findings.filter("file_path <> ''").groupBy("review_id", "file_path").agg(
        F.count("*").alias("n_findings"), F.max(rank).alias("_rank"),
        has("exposure", "security").alias("_exposed"), has("maintainability").alias("_maint"),
        has("tests").alias("_tests"), has("naming").alias("_naming"), F.min(seen).alias("_seen"))
    top = first_per(per_file, ["review_id"], [F.desc("_exposed"), F.desc("_rank"),
                                             F.desc("n_findings"), "_seen"], n)
    severity = F.when(F.col("_rank") == 3, "high").when(F.col("_rank") == 2, "medium").otherwise("low")
    count = F.col("n_findings").cast("string")
    yes = lambda c: F.col(c) == 1
    reason = (
        F.when(yes("_exposed"), F.concat(
            count, F.lit(" finding(s) including security/exposure risk — review first")))
        .when(yes("_maint") & yes("_tests"), F.concat(
            F.lit("Complexity and test coverage concerns ("), count, F.lit(" findings)")))
        .when(yes("_maint"), F.concat(
            F.lit("Maintainability risk — "), count, F.lit(" finding(s), highest severity: "), severity))
        .when(yes("_tests"), F.lit("Logic changes without test evidence"))
        .when(yes("_naming"), F.lit("Naming consistency issues that may indicate broader design drift"))
        .otherwise(F.concat(count, F.lit(" finding(s) — severity: "), severity)))
    # at most n rows per review are left, so their position is cheap to compute
    from pyspark.sql import Window
    w = Window.partitionBy("review_id").orderBy(
        F.desc("_exposed"), F.desc("_rank"), F.desc("n_findings"), "_seen")
    return top.select("review_id", F.row_number().over(w).alias("focus_rank"),
                      F.col("file_path").alias("path"), severity.alias("severity"),
                      reason.alias("reason"))


def finding_summary(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Exposure and test-gap counters and the maintainability verdict per review."""
    counts = findings.groupBy("review_id").agg(
        F.count_if((F.col("analyzer_ord") == 4) & (F.col("rule_id") != "exposure/dev-artifact"))
        .alias("exposure_risk_count"),
        F.count_if(F.col("analyzer_ord") == 5).alias("test_gap_count"),
        F.count_if(F.col("analyzer_ord") == 2).alias("_maint"))
    df = reviews.select("review_id").join(counts, "review_id", "left").na.fill(0)
    return df.withColumn("maintainability_status", F.when(
        F.col("_maint") > 0, "degraded").otherwise("neutral")).drop("_maint")


def counts(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per review by severity, and the categories that occur."""
    agg = findings.groupBy("review_id").agg(
        F.count("*").alias("n_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in REVIEW_SEVERITY],
        F.array_sort(F.collect_set("category")).alias("categories"))
    return reviews.select("review_id").join(agg, "review_id", "left").na.fill(0).withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>")))


def in_review_order(findings: DataFrame) -> DataFrame:
    rank = F.lit(3)
    for s, r in REVIEW_SEVERITY.items():
        rank = F.when(F.col("severity") == s, 3 - r).otherwise(rank)
    return findings.withColumn("severity_rank", rank).orderBy("review_id", "severity_rank", *ORDER)


def exposure_top(findings: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` exposure titles per review and how many more there are."""
    rows = findings.filter(F.col("category").isin("exposure", "security"))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    rows = rows.withColumn("_rank", rank)
    order = ["_rank", *ORDER, "rule_id"]
    top = first_per(rows, ["review_id"], order, n).groupBy("review_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, "title"))), lambda r: r["title"]).alias("titles"))
    total = rows.groupBy("review_id").agg(F.count("*").alias("_n"))
    return top.join(total, "review_id").select(
        "review_id", "titles", (F.col("_n") - F.size("titles")).alias("more"))


def checks_rollup(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    agg = runs.groupBy("review_id").agg(
        F.count_if(F.col("conclusion") == "failure").alias("_fail"),
        F.count_if((F.col("conclusion") == "neutral") | (F.col("status") != "completed")).alias("_warn"))
    df = reviews.select("review_id").join(agg, "review_id", "left")
    return df.select("review_id", F.when(F.col("_fail").isNull(), "unknown")
                     .when(F.col("_fail") > 0, "fail").when(F.col("_warn") > 0, "warn")
                     .otherwise("pass").alias("checks_status"))


def enrichment_requests(findings: DataFrame, n: int = ENRICHED) -> DataFrame:
    """The high findings for which better wording is asked: the first n per review."""
    return first_per(findings.filter(F.col("severity") == "high"), ["review_id"],
                     [*ORDER, "rule_id"], n)


def overlay(findings: DataFrame, wording: DataFrame) -> DataFrame:
    """Replace summary, reason and advice where ``wording`` (review_id, rule_id,
    file_path, ord, summary, why_flagged, suggestion) has a non-empty text."""
    keys = ["review_id", "rule_id", "file_path"]
    fields = ["summary", "why_flagged", "suggestion"]
    best = first_per(wording, keys, ["ord"]).select(
        *keys, *[F.col(c).alias(f"_{c}") for c in fields])
    df = findings.join(best, keys, "left")
    for c in fields:
        df = df.withColumn(c, F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)))
    return df.select("review_id", *REVIEW_FIELDS)
