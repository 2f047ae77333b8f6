"""Attack scenarios per scan: one aggregation, ranking inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.operators.content import redact_secrets
from glasswake.operators.findings import ORDER, first_per

# ---- fixed values -----------------------------------------------------------
LEVEL_POINTS = {"high": 3, "medium": 2, "low": 1}
SKILL_POINTS = {"very_low": 3, "low": 2, "medium": 1}
TIME_POINTS = {
    "under_1_minute": 4, "under_5_minutes": 3, "under_5_minutes_if_script_executes": 2,
    "under_5_minutes_if_combined_with_xss": 2, "under_15_minutes": 1,
}
CREDENTIAL_CATEGORIES = (
    "secret_exposure", "token_exposure", "hardcoded_password", "sensitive_url_parameter")
AUTH_CATEGORIES = ("insecure_cookie", "storage_risk")
AUTH_WORDS = (r"(?i)(?<![A-Za-z0-9_])(auth|session|jwt|token|login|credential|access|refresh"
              r"|bearer|sid)(?![A-Za-z0-9_])")
RECON_CATEGORIES = (
    "sourcemap_exposure", "framework_leakage", "suspicious_endpoint_reference", "info")
RECON_WORDS = (
    r"(?i)(?<![A-Za-z0-9_])(source.?map|internal|localhost|staging|admin|debug|route|endpoint"
    r"|config|version|framework|stack|Next\.js|React|Angular|Vue|Express|Laravel|Django|Rails)"
    r"(?![A-Za-z0-9_])")
SUPPLY_CATEGORIES = ("missing_sri", "mixed_content", "weak_csp")
EVIDENCE_ROWS, EVIDENCE_LENGTH = 5, 120
# type: title, skill, time
SCENARIOS = {
    "credential_leakage": (
        "Credential-like secrets exposed in public-facing artifacts",
        "very_low", "under_1_minute"),
    "public_data_exposure": (
        "Unauthenticated API data discoverable from the browser",
        "very_low", "under_5_minutes"),
    "auth_session_risk": (
        "Auth/session material accessible to browser-side scripts",
        "medium", "under_5_minutes_if_script_executes"),
    "internal_recon": (
        "Public assets reveal internal application structure",
        "low", "under_5_minutes"),
    "client_side_supply_chain_risk": (
        "Client-side script supply chain increases browser exposure",
        "low", "under_5_minutes_if_combined_with_xss"),
}
# own wording: what it means, what to do
ADVICE = {
    "credential_leakage": ("Visitors can read secrets in pages, scripts or addresses.",
                           "Remove and rotate every exposed value."),
    "public_data_exposure": ("Common paths answer with data and ask for no login.",
                             "Check permissions on the server for each path."),
    "auth_session_risk": ("Injected script could read cookies or stored tokens.",
                          "Set HttpOnly and Secure; keep tokens out of web storage."),
    "internal_recon": ("Public files tell how the site is built and where it runs.",
                       "Ship no source maps, versions or internal addresses."),
    "client_side_supply_chain_risk": ("Foreign scripts run without integrity checks.",
                                      "Pin scripts by hash, load over HTTPS, narrow the policy."),
}


def memberships() -> dict[str, Column]:
    """Which findings count for which scenario."""
    cat, sev, title = F.col("category"), F.col("severity"), F.col("title")
    return {
        "credential_leakage": cat.isin(*CREDENTIAL_CATEGORIES) & sev.isin("high", "medium"),
        "public_data_exposure": cat == "possible_public_data_exposure",
        "auth_session_risk": cat.isin(*AUTH_CATEGORIES) & (
            title.rlike(AUTH_WORDS) | F.col("evidence").rlike(AUTH_WORDS)),
        "internal_recon": cat.isin(*RECON_CATEGORIES) | title.rlike(RECON_WORDS)
        | cat.rlike(RECON_WORDS),
        "client_side_supply_chain_risk": cat.isin(*SUPPLY_CATEGORIES),
    }


def points(impact: Column, confidence: Column, skill: Column, time: Column) -> Column:
    def look(c, table):
        out = F.lit(1)
        for k, v in table.items():
            out = F.when(c == k, v).otherwise(out)
        return out
    return (look(impact, LEVEL_POINTS) * 3 + look(confidence, LEVEL_POINTS) * 2
            + look(skill, SKILL_POINTS) + look(time, TIME_POINTS))


def _facts(findings: DataFrame, inventory: DataFrame) -> DataFrame:
    """All numbers the five scenarios need, one row per scan (partial aggregation)."""
    aggs = []
    for name, member in memberships().items():
        aggs.append(F.count_if(member).alias(f"n_{name}"))
        aggs.append(F.count_if(member & (F.col("severity") == "high")).alias(f"h_{name}"))
    for c in ("sourcemap_exposure", "mixed_content", "weak_csp"):
        aggs.append(F.count_if(F.col("category") == c).alias(f"c_{c}"))
    from_findings = findings.groupBy("scan_id").agg(*aggs)
    from_inventory = inventory.groupBy("scan_id").agg(
        F.sum("script_count").alias("third_party"), F.sum("insecure_loads").alias("insecure"),
        F.count_if(~F.col("has_sri")).alias("no_sri"), F.count("*").alias("domains"))
    return from_findings.join(from_inventory, "scan_id", "full").na.fill(0)


def scenarios(findings: DataFrame, inventory: DataFrame,
              only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per scan and scenario that applies, with its score and rank.

    At most five candidates exist per scan, so they are sorted inside the row:
    ranking needs no window and no further shuffle.
    """
    facts = _facts(findings, inventory)
    n = lambda s: F.col(f"n_{s}")
    high = lambda s: F.col(f"h_{s}") > 0
    sri, mixed, csp = F.col("no_sri"), F.col("c_mixed_content") > 0, F.col("c_weak_csp") > 0
    either = lambda test, yes, no: F.when(test, yes).otherwise(no)
    supply = "client_side_supply_chain_risk"
    # type: applies, impact, confidence
    table = {
        "credential_leakage": (
            n("credential_leakage") > 0, F.lit("high"),
            either(high("credential_leakage"), "high", "medium")),
        "public_data_exposure": (
            n("public_data_exposure") > 0,
            either(high("public_data_exposure"), "high", "medium"),
            either(n("public_data_exposure") >= 2, "high", "medium")),
        "auth_session_risk": (
            n("auth_session_risk") > 0,
            either(high("auth_session_risk"), "high", "medium"),
            F.when(n("auth_session_risk") >= 3, "high")
            .when(n("auth_session_risk") >= 2, "medium").otherwise("low")),
        "internal_recon": (
            n("internal_recon") >= 2,
            either(F.col("c_sourcemap_exposure") > 0, "medium", "low"),
            either(n("internal_recon") >= 4, "high", "medium")),
        supply: (
            (n(supply) > 0) | ((F.col("third_party") > 0) & ((sri > 0) | (F.col("insecure") > 0))),
            either(mixed | (csp & (sri > 0)), "high", "medium"),
            either((n(supply) >= 3) | ((F.col("third_party") > 5) & (sri > 0)), "high", "medium")),
    }
    built = []
    for name, (applies, impact, confidence) in table.items():
        if only and name not in only:
            continue
        title, skill, time = SCENARIOS[name]
        score = points(impact, confidence, F.lit(skill), F.lit(time))
        summary, advice = ADVICE[name]
        text = F.lit(summary)
        if name == supply:
            text = F.when(F.col("third_party") > 0, F.concat(
                F.lit(summary + " Third-party domains: "), F.col("domains").cast("string"),
                F.lit(", scripts: "), F.col("third_party").cast("string"), F.lit("."))
            ).otherwise(text)
        built.append(F.when(applies, F.struct(
            (-score).alias("neg_score"), F.lit(name).alias("scenario_type"),
            F.lit(title).alias("title"), text.alias("summary"), F.lit(skill).alias("skill_level"),
            F.lit(time).alias("time_to_discover"), impact.alias("impact"),
            confidence.alias("confidence"), F.lit(advice).alias("recommendation"),
            n(name).alias("n_findings"))))
    ranked = F.array_sort(F.array_compact(F.array(*built)))
    rows = facts.select("scan_id", F.posexplode(ranked).alias("i", "s"))
    return rows.select("scan_id", (F.col("i") + 1).alias("rank"), (-F.col("s")["neg_score"]).alias("score"),
                       *[F.col("s")[c].alias(c) for c in (
                           "scenario_type", "title", "summary", "skill_level", "time_to_discover",
                           "impact", "confidence", "recommendation", "n_findings")])


def scenario_evidence(findings: DataFrame) -> DataFrame:
    """First five findings per scan and scenario, in insertion order."""
    tags = F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in memberships().items()]))
    rows = findings.select(
        "scan_id", "page_id", *ORDER, "category", "title", "url",
        F.left("evidence", F.lit(EVIDENCE_LENGTH)).alias("evidence_snippet"), "evidence", "asset_url",
        F.explode(tags).alias("scenario_type"))
    late = F.when(F.col("det_ord") >= 31, 2).when(F.col("det_ord") == 0, 0).otherwise(1)
    return first_per(rows.withColumn("_late", late), ["scan_id", "scenario_type"],
                     ["_late", "page_id", *ORDER, "url", "asset_url", "title"], EVIDENCE_ROWS)


def scenarios_with_evidence(findings: DataFrame, inventory: DataFrame) -> DataFrame:
    # hidden first, cut second: a value must not lose the mark that ends it
    top = scenario_evidence(findings).withColumn(
        "evidence_snippet", F.left(redact_secrets(F.col("evidence")), F.lit(EVIDENCE_LENGTH)))
    order = ["_late", "page_id", *ORDER, "url", "asset_url", "title"]
    fields = ["category", "title", "url", "evidence_snippet"]
    # five small rows per group at most
    nested = top.groupBy("scan_id", "scenario_type").agg(F.array_sort(F.collect_list(F.struct(
        F.struct(*order).alias("o"), F.struct(*fields).alias("e")))).alias("rows"))
    nested = nested.select("scan_id", "scenario_type",
                           F.transform("rows", lambda r: r["e"]).alias("evidence"))
    return scenarios(findings, inventory).join(nested, ["scan_id", "scenario_type"], "left")
