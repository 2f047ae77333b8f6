"""Rules over addresses: sensitive query parameters and robots.txt lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.bind import bind
from glasswake.functions.text import is_high_entropy, is_placeholder, redact_value
from glasswake.functions.urls import query_pairs, with_url
from glasswake.operators.findings import DET, KEYS, emit, finding

# ---- fixed values -----------------------------------------------------------
SENSITIVE_PARAMS = (
    "token", "access_token", "auth", "auth_token", "api_key", "apikey",
    "key", "secret", "password", "passwd", "pwd", "session", "sid",
    "jwt", "code", "refresh_token", "client_secret", "authorization",
    "bearer", "credential", "credentials", "pass", "private_key",
)
TOKEN_PARAMS = (
    "token", "access_token", "auth_token", "jwt", "refresh_token",
    "bearer", "authorization", "session", "sid",
)
PASSWORD_PARAMS = ("password", "passwd", "pwd", "pass", "private_key", "client_secret")
MIN_VALUE_LENGTH, LONG_VALUE_LENGTH = 6, 20
DISALLOW = r"(?i)^Disallow:\s*(.+)\z"
SENSITIVE_PATH = r"(?i)admin|internal|debug|private|staging|test|backup|config"


def with_sensitive_params(df: DataFrame, search: Column, out: str) -> DataFrame:
    """First reportable value per sensitive name: array<struct<name,pos,value>>."""
    lower = lambda p: F.lower(p["name"])
    df = df.withColumn("_kept", F.filter(query_pairs(search), lambda p: lower(p).isin(*SENSITIVE_PARAMS) & (
        (F.length(p["value"]) >= MIN_VALUE_LENGTH) | lower(p).isin(*PASSWORD_PARAMS))))
    df = df.withColumn("_names", F.transform("_kept", lower))
    return bind(df, out, F.filter("_kept", lambda p, i: F.array_position(
        "_names", lower(p)) == i + 1)).drop("_kept", "_names")


def param_findings(addresses: DataFrame, det: str) -> DataFrame:
    """``addresses``: scan_id, page_id, item_ord, url.  Row-local: a URL is its own group."""
    rows = addresses.filter(F.col("url").contains("?"))
    rows = with_url(rows, "url", "u").filter("u IS NOT NULL")
    rows = rows.select(*KEYS, "item_ord", "url", F.concat(
        F.col("u")["origin"], F.col("u")["path"]).alias("path"), F.col("u")["search"].alias("search"))
    rows = with_sensitive_params(rows, F.col("search"), "params")
    rows = rows.select(*KEYS, "item_ord", "url", "path", F.explode("params").alias("p"))
    name, value = F.col("p")["name"], F.col("p")["value"]
    lower = F.lower(name)
    level = F.when(is_placeholder(value), "low").when(
        (F.length(value) > LONG_VALUE_LENGTH) | is_high_entropy(value), "high").otherwise("medium")
    rows = bind(rows.withColumn("level_", level), "level", F.col("level_"))       # computed once, outside the rule
    level = F.col("level")
    title = (F.when(lower.isin(*TOKEN_PARAMS), "Sensitive token-like value in URL parameter")
             .when(lower.isin(*PASSWORD_PARAMS), "Password-like value in URL parameter")
             .otherwise("API key-like parameter in URL"))
    return emit(rows, [finding(
        F.lit(DET[det]), 0, item=F.col("item_ord"), pos=F.col("p")["pos"], severity=level,
        category="sensitive_url_parameter", title=title, url=F.col("url"), confidence=level,
        description="Addresses end up in histories, logs and referrers.",
        evidence=F.concat(F.lit('param "'), name, F.lit('" = '), redact_value(value),
                          F.lit("\nfull path: "), F.col("path")))])


def robots_findings(files: DataFrame) -> DataFrame:
    """One finding per robots.txt (scan_id, url, body) that disallows telling paths."""
    paths = F.transform(F.split("body", "\n", -1), lambda line: F.trim(
        F.regexp_extract(line, DISALLOW, 1), F.lit(" \t\r")))
    hits = F.filter(paths, lambda p: (p != "") & p.rlike(SENSITIVE_PATH))
    df = files.withColumn("_hits", hits).withColumn("page_id", F.lit(None).cast("bigint"))
    return emit(df, [F.when(F.size("_hits") > 0, finding(
        "robots", 0, severity="info", category="suspicious_endpoint_reference",
        title="Sensitive paths revealed in robots.txt", url=F.col("url"),
        description="The file names paths that are not meant to be found.",
        evidence=F.array_join(F.transform("_hits", lambda p: F.concat(F.lit("Disallow: "), p)), "\n"),
        confidence="medium"))])
