"""Response-header and content-policy rules; row-local, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.bind import bind
from glasswake.functions.text import strip
from glasswake.operators.findings import KEYS, emit, finding

# ---- fixed values -----------------------------------------------------------
REQUIRED_HEADERS = (
    ("content-security-policy", "high"),
    ("strict-transport-security", "medium"),
    ("x-content-type-options", "medium"),
    ("referrer-policy", "low"),
    ("permissions-policy", "low"),
    ("cross-origin-opener-policy", "low"),
    ("cross-origin-resource-policy", "info"),
)


def lower_entries(headers: Column) -> Column:
    return F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(e["key"]).alias("name"), e["value"].alias("value")))


def header(entries: Column, name: str) -> Column:
    """Value of a header, the last spelling wins; NULL when absent."""
    hits = F.filter(entries, lambda e: e["name"] == name)
    return F.try_element_at(hits, F.lit(-1))["value"]


def content_type(headers: Column) -> Column:
    """Only the two usual spellings are looked up."""
    return F.coalesce(headers["content-type"], headers["Content-Type"])


def header_findings(pages: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Missing required headers, technology disclosure, wildcard CORS."""
    df = bind(pages.filter(F.size("headers") > 0), "_h", lower_entries(F.col("headers")))
    h = lambda name: header(F.col("_h"), name)
    df = (df.withColumn("_powered", h("x-powered-by"))
          .withColumn("_origin", h("access-control-allow-origin"))
          .withColumn("_cred", h("access-control-allow-credentials")))
    rules: list[Column] = []
    if not only or "missing" in only:
        for i, (name, severity) in enumerate(REQUIRED_HEADERS):
            rules.append(F.when(F.coalesce(h(name), F.lit("")) == "", finding(
                "headers", i, severity=severity, category="missing_security_header",
                title=f"Missing header: {name}", url=F.col("url"), confidence="high",
                description=f"The response does not send {name}.",
                evidence=f'Header "{name}" was not present in the HTTP response.')))
    if not only or "powered_by" in only:
        rules.append(F.when(F.col("_powered") != "", finding(
            "headers", 10, severity="low", category="framework_leakage",
            title="X-Powered-By header reveals server technology", url=F.col("url"),
            description="The server software is named in a response header.",
            evidence=F.concat(F.lit("X-Powered-By: "), F.col("_powered")), confidence="high")))
    if not only or "cors" in only:
        cred = F.coalesce(F.col("_cred"), F.lit(""))
        rules.append(F.when(F.col("_origin") == "*", finding(
            "headers", 11, category="cors_risk", title="Wildcard CORS policy detected",
            severity=F.when(cred == "true", "high").otherwise("medium"), url=F.col("url"),
            description="Any origin may read responses.", confidence="high",
            evidence=F.concat(
                F.lit("Access-Control-Allow-Origin: *"),
                F.when(cred != "", F.concat(F.lit("\nAccess-Control-Allow-Credentials: "), cred))
                .otherwise(F.lit(""))))))
    return emit(df, rules)


def parse_policy(value: Column) -> Column:
    """'a x y; b' -> array<struct<name,tokens>>."""
    parts = F.filter(F.transform(F.split(value, ";", -1), strip), lambda p: p != "")
    parsed = F.transform(parts, lambda p: F.split(p, r"\s+", -1))
    return F.transform(parsed, lambda t: F.struct(
        F.lower(F.get(t, 0)).alias("name"), F.slice(t, F.lit(2), F.size(t)).alias("tokens")))


def with_policy(pages: DataFrame) -> DataFrame:
    """Pages that send a policy; of equal directive names only the last is kept."""
    value = header(lower_entries(F.col("headers")), "content-security-policy")
    df = bind(pages, "_csp", value).filter(F.col("_csp") != "")
    df = bind(df, "_named", parse_policy(F.col("_csp")))
    last = F.filter("_named", lambda d, i: ~F.exists(
        F.slice("_named", i + 2, F.size("_named")), lambda later: later["name"] == d["name"]))
    return bind(df, "policy", last).drop("_csp", "_named").filter(F.size("policy") > 0)


def policy_directives(pages: DataFrame) -> DataFrame:
    rows = with_policy(pages).select(*KEYS, F.explode("policy").alias("d"))
    return rows.select(*KEYS, F.col("d")["name"].alias("directive"), F.col("d")["tokens"].alias("tokens"))


def policy_findings(pages: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    df = with_policy(pages)
    get = lambda name: F.try_element_at(
        F.filter("policy", lambda d: d["name"] == name), F.lit(1))["tokens"]
    for name in ("script-src", "default-src", "object-src", "base-uri", "frame-ancestors",
                 "connect-src", "frame-src"):
        df = df.withColumn("_" + name, get(name))
    col = lambda name: F.col(f"`_{name}`")
    has = lambda tokens, t: F.coalesce(F.array_contains(tokens, t), F.lit(False))
    words = lambda tokens: F.array_join(tokens, " ")
    script = F.coalesce(col("script-src"), col("default-src"))
    script_name = F.when(col("script-src").isNotNull(), "script-src").otherwise("default-src")
    none, self_ = "'none'", "'self'"
    no_object = col("object-src").isNull()
    open_default = ~has(col("default-src"), none) & ~has(col("default-src"), self_)
    default_text = F.coalesce(F.nullif(words(col("default-src")), F.lit("")), F.lit("(not set)"))
    shown = lambda name: F.concat(F.lit(name + ": "), words(col(name)))
    script_shown = F.concat(script_name, F.lit(": "), words(script))
    # group, order, condition, severity, title, evidence, confidence, description
    table = [
        ("script", 0, has(script, "'unsafe-inline'"), "high",
         "Weak CSP: 'unsafe-inline' scripts allowed", script_shown, "high",
         "Inline scripts run, so the policy does not stop injected script."),
        ("script", 1, has(script, "'unsafe-eval'"), "medium",
         "Weak CSP: 'unsafe-eval' permitted", script_shown, "high",
         "Strings may be evaluated as code."),
        ("script", 2, has(script, "*"), "high",
         "Weak CSP: wildcard (*) script source", script_shown, "high",
         "Scripts may come from any origin."),
        ("object", 3, no_object & open_default, "medium",
         "Weak CSP: object-src not restricted to 'none'",
         F.concat(F.lit("object-src: not set; default-src: "), default_text), "medium",
         "Plugin content is not restricted."),
        ("object", 4, ~no_object & ~has(col("object-src"), none), "low",
         "Weak CSP: object-src not set to 'none'", shown("object-src"), "medium",
         "Plugin content is allowed from the listed sources."),
        ("missing", 5, col("base-uri").isNull(), "low", "Weak CSP: base-uri not set",
         F.lit("base-uri directive not present in CSP"), "medium",
         "An injected base tag could redirect relative addresses."),
        ("missing", 6, col("frame-ancestors").isNull(), "info", "CSP: frame-ancestors not set",
         F.lit("frame-ancestors not present in CSP"), "low",
         "Framing is not limited by the policy."),
        ("wildcard", 7, has(col("connect-src"), "*"), "low", "Weak CSP: wildcard connect-src",
         shown("connect-src"), "high", "Requests may go to any origin."),
        ("wildcard", 8, has(col("frame-src"), "*"), "medium", "Weak CSP: wildcard frame-src",
         shown("frame-src"), "high", "Frames may come from any origin."),
    ]
    return emit(df, [
        F.when(cond, finding("csp", i, severity=sev, category="weak_csp", title=title,
                             url=F.col("url"), evidence=ev, confidence=conf, description=why))
        for group, i, cond, sev, title, ev, conf, why in table if not only or group in only])
