"""The finding table: building rows, first-wins dedup, counts, order, attribution."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ["scan_id", "page_id"]
ORDER = ["det_ord", "item_ord", "rule_ord", "pos"]
FIELDS = ["severity", "category", "title", "description", "url", "asset_url",
          "evidence", "confidence"]

# ---- fixed values -----------------------------------------------------------
SEVERITIES = ("high", "medium", "low", "info")
# call order of the detectors; robots lines come before any page, probes after
DET = {
    "robots": 0, "headers": 1, "csp": 2, "cookies": 3, "localStorage": 4, "sessionStorage": 5,
    "secrets_html": 6, "next_public_html": 7, "passwords_html": 8, "inline_scripts": 9,
    "framework": 10, "console": 11, "endpoints": 12, "sourcemaps": 13, "scripts": 14,
    "page_url": 15, "request_url": 16,
    "bundle_secrets": 21, "bundle_next_public": 22, "bundle_passwords": 23,
    "bundle_sourcemaps": 24, "bundle_endpoints": 26, "probes": 31,
}
DEFAULT_OPTIONS = {
    "inspectHtml": True, "inspectDom": True, "inspectInlineScripts": True,
    "inspectJsBundles": True, "inspectNetworkRequests": True, "inspectHeaders": True,
    "inspectCookies": True, "inspectLocalStorage": True, "inspectSessionStorage": True,
    "detectSourceMaps": True, "inspectRobotsTxt": True, "inspectSitemapXml": True,
    "searchSecrets": True, "checkFrameworkLeakage": True, "checkConsoleErrors": True,
    "checkSuspiciousEndpoints": True, "passiveEndpointCheck": False,
    "maxPages": 20, "maxDepth": 2, "requestTimeoutMs": 15000,
    "sameOriginOnly": True, "ignoreDestructiveLinks": True, "delayBetweenPagesMs": 500,
}
# option flags that must all be on ("a|b" = either) for a detector to report
GATES = {
    "robots": ["inspectRobotsTxt"], "headers": ["inspectHeaders"], "csp": ["inspectHeaders"],
    "cookies": ["inspectCookies"], "localStorage": ["inspectLocalStorage"],
    "sessionStorage": ["inspectSessionStorage"], "secrets_html": ["searchSecrets"],
    "next_public_html": ["searchSecrets"], "passwords_html": ["searchSecrets"],
    "inline_scripts": ["inspectInlineScripts", "searchSecrets"],
    "framework": ["checkFrameworkLeakage"], "console": ["checkConsoleErrors"],
    "endpoints": ["checkSuspiciousEndpoints"], "sourcemaps": ["detectSourceMaps"],
    "scripts": ["inspectJsBundles"],
    "page_url": ["inspectNetworkRequests|searchSecrets"],
    "request_url": ["inspectNetworkRequests|searchSecrets"],
    "bundle_secrets": ["inspectJsBundles", "searchSecrets"],
    "bundle_next_public": ["inspectJsBundles", "searchSecrets"],
    "bundle_passwords": ["inspectJsBundles", "searchSecrets"],
    "bundle_sourcemaps": ["inspectJsBundles", "detectSourceMaps"],
    "bundle_endpoints": ["inspectJsBundles", "checkSuspiciousEndpoints"],
    "probes": ["passiveEndpointCheck"],
}


def _text(v: str | Column | None) -> Column:
    if isinstance(v, Column):
        return v
    return F.lit(v).cast("string")


def finding(det: str | Column, rule: int | Column, *, severity, category, title, url, evidence,
            confidence, description="", item=0, pos=0, asset_url=None) -> Column:
    """One finding as a struct column; strings are taken as literals."""
    det = F.lit(DET[det]) if isinstance(det, str) else det
    number = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(
        det.cast("int").alias("det_ord"), number(item, "bigint").alias("item_ord"),
        number(rule, "int").alias("rule_ord"), number(pos, "int").alias("pos"),
        _text(severity).alias("severity"), _text(category).alias("category"),
        _text(title).alias("title"), _text(description).alias("description"),
        _text(url).alias("url"), _text(asset_url).alias("asset_url"),
        _text(evidence).alias("evidence"), _text(confidence).alias("confidence"),
    )


def emit(df: DataFrame, rules: Iterable[Column], keys: list[str] = KEYS) -> DataFrame:
    """All rules of one source in ONE pass: each input row yields 0..n findings."""
    # array_compact would be interpreted with all rules in it; an exploded array is compiled
    rows = df.select(*keys, F.explode(F.array(*rules)).alias("f")).where("f IS NOT NULL")
    return rows.select(*keys, "f.*")


def first_per(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """First ``n`` rows per key.  Spark limits each group BEFORE the shuffle
    (WindowGroupLimit), so a hot key ships at most n rows per input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def deduplicate(findings: DataFrame, strict: bool = False) -> DataFrame:
    """Keep the first finding per page, category, url and first 50 evidence characters.

    ``strict`` adds the title, so that several rules about one cookie survive.
    Bundle, robots and probe findings are passed through as they are.
    """
    paged = F.col("det_ord").between(DET["headers"], DET["request_url"])
    own = F.concat_ws(":", *ORDER, "asset_url")          # always its own group
    keys = [*KEYS, "category", "url", F.when(paged, F.substring("evidence", 1, 50)).otherwise(own)]
    keys += ["title"] if strict else []
    return first_per(findings, keys, ORDER)


def with_finding_id(findings: DataFrame) -> DataFrame:
    """A readable key that is the same on every run."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in [*KEYS, *ORDER]]
    asset = F.when(F.col("det_ord") > DET["request_url"], F.md5(
        F.coalesce("asset_url", F.lit("")))).otherwise(F.lit(None).cast("string"))
    return findings.withColumn("finding_id", F.concat_ws(":", *parts, asset))


def gate(findings: DataFrame, options: DataFrame | None) -> DataFrame:
    """Drop findings of detectors that the scan's options switch off.

    ``options`` has one row per scan, so this is an equi join on scan_id whose
    strategy (and skew split) adaptive execution picks from the real sizes.  A scan
    without a row, or with a NULL flag, has the default options; without ``options`` all have.
    """
    if options is None:
        flag = lambda name: F.lit(DEFAULT_OPTIONS[name])
        rows = findings.withColumn("opt", F.lit(None))
    else:
        flag = lambda name: F.coalesce(F.col("opt")[name], F.lit(DEFAULT_OPTIONS[name]))
        rows = findings.join(options.select("scan_id", "opt"), "scan_id", "left")
    off = [F.lit(False)]
    for name, gates in GATES.items():
        for g in gates:
            none = F.lit(True)
            for f in g.split("|"):
                none = none & ~flag(f)
            off.append((F.col("det_ord") == DET[name]) & none)
    gated = F.col("det_ord").isin(*[DET[name] for name in GATES])
    return rows.filter(gated & ~reduce(or_, off)).drop("opt")


def request_of() -> Column:
    """The request a finding was made on; NULL for all but findings on request addresses."""
    return F.when(F.col("det_ord") == DET["request_url"], F.col("item_ord"))


def severity_rank(c: Column) -> Column:
    rank = F.lit(99)
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(c == s, F.lit(i)).otherwise(rank)
    return rank


def severity_counts(scans: DataFrame, findings: DataFrame, pages: DataFrame,
                    requests: DataFrame) -> DataFrame:
    """Counters per scan; scans without rows show zeros.

    The three inputs are reduced to one row per scan each (map-side partial
    counts) before they meet, so a hot scan costs no more than a small one.
    """
    by_severity = findings.groupBy("scan_id").agg(
        F.count("*").alias("findings_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES])
    n_pages = pages.groupBy("scan_id").agg(F.count("*").alias("pages_scanned"))
    n_requests = requests.groupBy("scan_id").agg(F.count("*").alias("requests_captured"))
    out = scans.select("scan_id")
    for part in (by_severity, n_pages, n_requests):
        out = out.join(part, "scan_id", "left")
    return out.na.fill(0)


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "category").agg(F.count("*").alias("n_findings"))


def in_report_order(findings: DataFrame) -> DataFrame:
    """Severity rank, category, insertion order, as ONE range-partitioned sort, so
    a scan of any size is spread over many tasks."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "scan_id", "severity_rank", "category", "page_id", *ORDER)


def finding_source(evidence: Column, category: Column, url: Column) -> Column:
    return (
        F.when(evidence.startswith("[Passive endpoint check]"), "passive_endpoint_check")
        .when(category == "insecure_cookie", "cookie_analysis")
        .when(url.endswith("/robots.txt"), "robots_txt")
        .when(category == "sensitive_url_parameter", "url_parameter")
        .when(category == "weak_csp", "csp_analysis")
        .when(category.isin("missing_sri", "mixed_content"), "sri_check")
        .otherwise("crawl"))


def attribute(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach url, depth and title of the page a finding came from (if any)."""
    facts = pages.select(*KEYS, F.col("url").alias("page_url"), "depth",
                         F.col("title").alias("page_title"))
    return findings.join(facts, KEYS, "left")


def select_findings(findings: DataFrame, severity: str | None = None,
                    category: str | None = None) -> DataFrame:
    if severity:
        findings = findings.filter(F.col("severity") == severity)
    if category:
        findings = findings.filter(F.col("category") == category)
    return findings
