"""Rules over captured responses of well-known paths (the capture itself is upstream)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.json_text import indented
from glasswake.functions.urls import with_url
from glasswake.operators.findings import KEYS, emit, finding

# ---- fixed values -----------------------------------------------------------
PROBE_PATHS = (
    "/api/users", "/api/user", "/api/admin", "/api/auth/me", "/api/me", "/api/profile",
    "/api/debug", "/api/internal", "/api/config", "/api/settings", "/admin", "/debug",
    "/internal", "/dashboard", "/health", "/status", "/.env", "/config.json", "/api.json",
)
CONFIG_PATHS = ("/.env", "/config.json", "/api.json")
ADMIN_PATH = r"(?i)/(admin|debug|internal|config|\.env)"
QUIET_STATUSES = (401, 403, 404, 405, 410)
SENSITIVE_FIELDS = (
    "email", "emails", "role", "roles", "permission", "permissions", "scopes",
    "userId", "user_id", "uid",
    "token", "accessToken", "access_token", "refreshToken", "refresh_token",
    "apiKey", "api_key", "apikey", "secret", "clientSecret", "client_secret",
    "password", "passwd", "hash", "config", "configuration",
    "admin", "isAdmin", "is_admin", "superuser",
    "ssn", "dob", "dateOfBirth",
    "creditCard", "credit_card", "cardNumber", "card_number",
)
PREVIEW_LENGTH, WALK_LEVELS = 400, 5


def probe_targets(scans: DataFrame) -> DataFrame:
    """Every scan's origin with every fixed path; an explode, not a cross join."""
    rows = with_url(scans, "target_url", "u").select(
        "scan_id", F.col("u")["origin"].alias("origin"),
        F.explode(F.array(*map(F.lit, PROBE_PATHS))).alias("path"))
    return rows.select("scan_id", "path", F.concat("origin", "path").alias("url"))


def sensitive_keys(body: Column) -> Column:
    """Distinct telling field names in the top five levels of a JSON text, sorted."""
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    empty = F.array().cast("array<variant>")
    level = F.array(F.try_parse_json(body))
    names = F.array().cast("array<string>")
    for depth in range(WALK_LEVELS):
        keys = F.flatten(F.transform(level, lambda v: F.coalesce(
            F.map_keys(as_map(v)), F.array().cast("array<string>"))))
        names = F.concat(names, keys)
        if depth + 1 < WALK_LEVELS:
            level = F.flatten(F.transform(level, lambda v: F.coalesce(
                F.map_values(as_map(v)), as_list(v), empty)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda k: (
        k.isin(*SENSITIVE_FIELDS) | F.lower(k).isin(*SENSITIVE_FIELDS)))))


def listed(responses: DataFrame) -> DataFrame:
    """Responses of the fixed paths that are worth a look, with a bounded preview: JSON indented,
    other text as it is."""
    ctype = F.coalesce("content_type", F.lit(""))
    json, text = ctype.contains("json"), ctype.contains("text") | ctype.contains("html")
    return (
        responses.filter(F.col("path").isin(*PROBE_PATHS) & ~F.col("status").isin(*QUIET_STATUSES))
        .withColumn("is_json", json).withColumn("is_text", text)
        .withColumn("preview", F.when(json | text, F.coalesce(
            F.when(json, indented("body", PREVIEW_LENGTH)),
            F.left("body", F.lit(PREVIEW_LENGTH)))))
        .withColumn("keys", F.when(json, sensitive_keys(F.col("body"))).otherwise(
            F.array().cast("array<string>"))))


def probe_findings(responses: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    df = listed(responses).filter(F.col("status") == 200).withColumn(
        "page_id", F.lit(None).cast("bigint"))
    path, found = F.col("path"), F.array_join("keys", ", ")
    risky, has = path.rlike(ADMIN_PATH), F.size("keys") > 0
    ctype = F.coalesce("content_type", F.lit("null"))
    json = F.col("is_json") | F.coalesce(
        F.col("content_type").contains("javascript"), F.lit(False))
    head = F.concat(F.lit("[Passive endpoint check] GET "), path, F.lit(" → 200 "), ctype)
    shown = lambda none: F.concat(F.lit("\n\nPreview:\n"), F.coalesce("preview", F.lit(none)))
    title = lambda t: F.concat(F.lit(f"Passive check: {t}"), path)
    rules = {
        "json": F.when(json & has, finding(
            "probes", 0, category="possible_public_data_exposure", url=F.col("url"),
            severity=F.when(risky, "high").otherwise("medium"), confidence="high",
            title=F.concat(title(""), F.lit(" returned sensitive JSON data")),
            description="Anyone may read these fields without logging in.",
            evidence=F.concat(head, F.lit("\nSensitive fields: "), found, shown("(empty)")))),
        "admin": F.when(risky & ~has & (json | F.col("is_text")), finding(
            "probes", 1, category="suspicious_endpoint_reference", severity="medium",
            title=title("admin/debug path publicly accessible: "), url=F.col("url"),
            description="Staff paths should not answer strangers.", confidence="medium",
            evidence=F.concat(head, shown("(no text preview)")))),
        "config": F.when(path.isin(*CONFIG_PATHS), finding(
            "probes", 2, category="secret_exposure", severity="high", url=F.col("url"),
            title=title("configuration file publicly accessible: "), confidence="high",
            description="Configuration files often hold secrets.",
            evidence=F.concat(head, shown("(no preview)")))),
    }
    return emit(df, [r for k, r in rules.items() if not only or k in only],
                ["scan_id", "page_id"])


def probe_summary(responses: DataFrame) -> DataFrame:
    """Per scan: answered probes and findings, both reduced before they are joined."""
    ok = responses.filter(F.col("path").isin(*PROBE_PATHS)).groupBy("scan_id").agg(
        F.count_if(F.col("status") == 200).alias("ok_count"))
    found = probe_findings(responses).groupBy("scan_id").agg(F.count("*").alias("finding_count"))
    return ok.join(found, "scan_id", "left").na.fill(0)
