"""Rules over text bodies: secrets, passwords, leaks, endpoints, source maps.

Input rows: scan_id, page_id, url, asset_url, item_ord, label, content and
``dets`` (which detector, if any, each rule group reports as).  Every body is
read once: all rule groups put their matches in one array, one ``explode``
follows, and only the (rare) match rows are shuffled for first-wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions import html as H
from glasswake.functions.bind import bind
from glasswake.functions.text import (
    WHITESPACE, Search, is_high_entropy, is_password_placeholder, is_placeholder,
    is_trivial_password, redact_snippet, sql_text, strip, with_context_matches,
)
from glasswake.functions.urls import with_resolved
from glasswake.operators.clientstate import SENSITIVE_KEY
from glasswake.operators.findings import DET, KEYS, ORDER, finding, first_per

GROUPS = ("secrets", "next_public", "passwords", "framework", "endpoints", "sourcemaps")

# ---- fixed values: patterns -------------------------------------------------
# name, pattern, group, category, text that must occur for the pattern to match
SECRETS = (
    ("AWS access key", r"AKIA[0-9A-Z]{16}", 0, "secret_exposure", "AKIA"),
    ("JWT", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]*", 0, "token_exposure", "eyJ"),
    ("Bearer token", r"Bearer\s+([A-Za-z0-9\-_]{20,})", 1, "token_exposure", "Bearer"),
    ("Service key", r"(?:sk|pk|rk)-[A-Za-z0-9]{16,}", 0, "secret_exposure", "k-"),
    ("Private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "secret_exposure", "PRIVATE KEY"),
    ("Token assignment", r"""(?i)token\s*[:=]\s*["']([^"'\s]{16,})["']""", 1,
     "token_exposure", None),
    ("Secret assignment", r"""(?i)(?:api[_\-]?key|secret)\s*[:=]\s*["']([^"'\s]{16,})["']""", 1,
     "secret_exposure", None),
)
NEXT_PUBLIC = r"""NEXT_PUBLIC_[A-Z0-9_]+\s*[:=]\s*["']([^"']+)["']"""
PASSWORD_NAMES = (
    "password", "passwd", "pwd",
    "db_pass(?:word)?", "database_pass(?:word)?",
    "redis_pass(?:word)?", "mysql_pass(?:word)?",
    "postgres_pass(?:word)?", "postgresql_pass(?:word)?", "pg_pass(?:word)?",
    "mongo_pass(?:word)?", "mongodb_pass(?:word)?",
    "admin_pass(?:word)?", "root_pass(?:word)?",
    "user_pass(?:word)?", "app_pass(?:word)?",
    "smtp_pass(?:word)?", "mail_pass(?:word)?", "email_pass(?:word)?",
    "api_pass(?:word)?", "ftp_pass(?:word)?",
    "ldap_pass(?:word)?", "ssh_pass(?:word)?",
)
# name, pattern, groups, is a URI, cheap test that must hold first
PASSWORDS = (
    ("Hardcoded password assignment",
     r"(?im)(?:^|[,;{\s(])(?:" + "|".join(PASSWORD_NAMES) + r""")\s*[=:]\s*["']([^"']{3,})["']""",
     (1,), False, "[pP](?:[aA][sS][sS]|[wW][dD])"),
    ("ENV password variable",
     r"(?<![A-Za-z0-9_])(?:[A-Z][A-Z0-9]*_)?(?:PASSWORD|PASSWD|PASS)\s*=\s*"
     r"""(?:["']([^"'\r\n]{3,})["']|([^\s#"'\r\n]{3,}))""", (1, 2), False, "PASS"),
    ("PostgreSQL URI with embedded password",
     r"""(?i)postgres(?:ql)?(?:\+\w+)?://[^:@\s"']+:([^@\s"']{3,})@""", (1,), True, "://"),
    ("MySQL/MariaDB URI with embedded password",
     r"""(?i)(?:mysql|mariadb)(?:\+\w+)?://[^:@\s"']+:([^@\s"']{3,})@""", (1,), True, "://"),
    ("MongoDB URI with embedded password",
     r"""(?i)mongodb(?:\+srv)?://[^:@\s"']+:([^@\s"']{3,})@""", (1,), True, "://"),
    ("Redis URI with embedded password",
     r"""(?i)rediss?://[^@\s"']*:([^@\s"']{3,})@""", (1,), True, "://"),
    ("AMQP URI with embedded password",
     r"""(?i)amqps?://[^:@\s"']+:([^@\s"']{3,})@""", (1,), True, "://"),
    ("FTP URI with embedded password",
     r"""(?i)s?ftp://[^:@\s"']+:([^@\s"']{3,})@""", (1,), True, "://"),
    ("SMTP URI with embedded password",
     r"""(?i)smtps?://[^:@\s"']+:([^@\s"']{3,})@""", (1,), True, "://"),
)
# Own patterns: what reports hide, also where the evidence was cut inside a value.
_HIDDEN = (
    (r"""(['"`])[A-Za-z0-9+/=_\-!@#$%^&*]{6,}\z""", "[REDACTED]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "[REDACTED]"),
    (r"""(?i)((?:postgres(?:ql)?|mysql|mariadb|mongodb|rediss?|amqps?|s?ftp|smtps?)(?:\+\w+)?"""
     r"""://[^:@\s"'/]*:)[^@\s"']+(@|\z)""", "$1[REDACTED]$2"),
    (r"""(?i)(https?://[^:@\s"'/]*:)[^@\s"'/]+@""", "$1[REDACTED]@"),
    (r"""(?i)((?:pass(?:word|wd)?|pwd|secret|token|api[_\-]?key)["']?\s*[:=]\s*)["']?[^\s"',;&\[]{3,}["']?""",
     "$1[REDACTED]"),
)


def redact_secrets(evidence: Column) -> Column:
    """The text with every value hidden that a secret or password rule would find in it."""
    text = redact_snippet(evidence)["redacted_snippet"]
    for pattern, shown in _HIDDEN:
        text = F.regexp_replace(text, pattern, shown)
    for _, pattern, *_ in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


STACK_TRACE = (r"(?:Error|TypeError|ReferenceError|SyntaxError):[^\n]+\n\s+at\s+\S+\s+"
               r"\([^)]+\)")
VERSION = r'"version":\s*"(\d+\.\d+\.\d+)"'
DEVTOOLS = "__REACT_DEVTOOLS_GLOBAL_HOOK__"
INTERNAL_URL = (r"(?:https?://)?(?:localhost|127\.0\.0\.1|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+)"
                r"""(?::\d+)?(?:/[^\s"'<>]*)?""")
# name, path, severity
ENDPOINTS = (
    ("admin endpoint", "/admin", "medium"),
    ("internal endpoint", "/internal", "medium"),
    ("debug endpoint", "/debug", "medium"),
    ("staging endpoint", "/staging", "low"),
    ("test endpoint", "/test", "low"),
    ("private API endpoint", "/api/private", "medium"),
    ("admin API endpoint", "/api/admin", "medium"),
)
ANY_ENDPOINT = r"""["'`]/(?i:admin|internal|debug|staging|test|api/)"""
SOURCE_MAP = r"//[#@]\s*sourceMappingURL=([^\s]+)"


def endpoint_pattern(path: str) -> str:
    return r"""(?i)["'`](%s(?:/[^\s"'`]*)?)["'`]""" % path


# ---- bodies -----------------------------------------------------------------

_BODY = ["scan_id", "page_id", "url", "asset_url", "item_ord", "label", "content"]


def _dets(**names: str) -> Column:
    return F.struct(*[F.lit(DET[names[g]] if g in names else None).cast("int").alias(g)
                      for g in GROUPS])


def page_bodies(pages: DataFrame) -> DataFrame:
    """Markup, each inline script, and both joined, one row each."""
    inline = H.inline_scripts(F.col("html"))
    df = bind(pages.filter("html <> ''"), "_inline", inline)
    body = lambda ord_, label, text, dets: F.struct(
        ord_.cast("bigint").alias("item_ord"), F.lit(label).alias("label"),
        text.alias("content"), dets.alias("dets"))
    none = F.lit(0)
    rows = F.concat(
        F.array(
            body(none, "HTML source", F.col("html"), _dets(
                secrets="secrets_html", next_public="next_public_html",
                passwords="passwords_html", sourcemaps="sourcemaps")),
            body(none, "page", F.array_join(F.concat(F.array("html"), "_inline"), "\n"),
                 _dets(framework="framework", endpoints="endpoints"))),
        F.transform("_inline", lambda s, i: body(
            i, "inline script", s, _dets(secrets="inline_scripts", passwords="inline_scripts"))))
    rows = df.select(*KEYS, "url", F.explode(rows).alias("b"))
    return rows.select(*KEYS, "url", F.lit(None).cast("string").alias("asset_url"), "b.*")


def text_bodies(df: DataFrame, content: str, label: str) -> DataFrame:
    """Any text table (needs scan_id, page_id, url) read like page markup."""
    return df.select(
        *KEYS, "url", F.lit(None).cast("string").alias("asset_url"),
        F.lit(0).cast("bigint").alias("item_ord"), F.lit(label).alias("label"),
        F.col(content).alias("content"),
        _dets(secrets="secrets_html", next_public="next_public_html",
              passwords="passwords_html", framework="framework", endpoints="endpoints",
              sourcemaps="sourcemaps").alias("dets"))


def storage_bodies(storage: DataFrame) -> DataFrame:
    """Values under telling keys are searched for secrets."""
    local = _dets(secrets="localStorage")
    session = _dets(secrets="sessionStorage")
    rows = storage.filter(F.col("key").rlike(SENSITIVE_KEY) & (F.length("value") > 8))
    return rows.select(
        *KEYS, "url", F.lit(None).cast("string").alias("asset_url"), "item_ord",
        F.concat("storage_type", F.lit('["'), "key", F.lit('"]')).alias("label"),
        F.col("value").alias("content"),
        F.when(F.col("storage_type") == "localStorage", local).otherwise(session).alias("dets"))


def bundle_bodies(assets: DataFrame) -> DataFrame:
    """Script assets, once per asset; the page is attached to the findings later."""
    null = lambda t: F.lit(None).cast(t)
    return assets.select(
        null("bigint").alias("scan_id"), null("bigint").alias("page_id"),
        null("string").alias("url"), "asset_url", F.lit(0).cast("bigint").alias("item_ord"),
        F.concat(F.lit("JS bundle ("), "asset_url", F.lit(")")).alias("label"),
        F.col("body").alias("content"),
        _dets(secrets="bundle_secrets", next_public="bundle_next_public",
              passwords="bundle_passwords", endpoints="bundle_endpoints",
              sourcemaps="bundle_sourcemaps").alias("dets"))


# ---- matches ----------------------------------------------------------------

_MATCH = ("array<struct<grp:string,det_ord:int,rule_ord:int,pos:int,seen:string,value:string,"
          "whole:string,left:string,right:string>>")


# Many patterns make many expressions, so they are written as SQL text here.

def _match(group: str, rule: int, pos: str, seen: str, value: str, whole: str,
           left: str = "''", right: str = "''") -> str:
    return (f"struct('{group}' AS grp, dets.{group} AS det_ord, {rule} AS rule_ord, {pos} AS pos, "
            f"{seen} AS seen, {value} AS value, {whole} AS whole, {left} AS left, {right} AS right)")


def _guarded(test: str, found: str) -> Column:
    return F.expr(f"CAST(CASE WHEN {test} THEN {found} ELSE array() END AS {_MATCH})")


def _plain(group: str, rule: int, test: str, pattern: str, value_group: int,
           seen: bool = True) -> Column:
    """Matches without surrounding text."""
    p = sql_text(pattern)
    key = f"concat('{rule}:', " + ("m.v" if seen else "CAST(i AS STRING)") + ")"
    both = (f"zip_with(regexp_extract_all(content, {p}, 0), "
            f"regexp_extract_all(content, {p}, {value_group}), (w, v) -> struct(w AS w, v AS v))")
    return _guarded(f"dets.{group} IS NOT NULL AND {test}",
                    f"transform({both}, (m, i) -> {_match(group, rule, 'i', key, 'm.v', 'm.w')})")


def _contains(text: str) -> str:
    return f"contains(content, {sql_text(text)})"


def _rlike(pattern: str) -> str:
    return f"content RLIKE {sql_text(pattern)}"


def _with_candidates(bodies: DataFrame, only: tuple[str, ...],
                     rules: dict[str, tuple[int, ...]] | None) -> tuple[DataFrame, list[Column]]:
    """Bodies with one array of matches per wanted pattern."""
    wanted = lambda g, i: g in only and (not rules or g not in rules or i in rules[g])
    out: list[Column] = []
    searches: list[Search] = []
    for i, (_, pattern, group, _, needle) in enumerate(SECRETS):
        if wanted("secrets", i):
            cheap = _contains(needle) if needle else _rlike(pattern.split(r"\s*")[0])
            out.append(_plain("secrets", 10 + i, cheap, pattern, group))
    if wanted("next_public", 0):
        out.append(_plain("next_public", 0, _contains("NEXT_PUBLIC_"), NEXT_PUBLIC, 1))
    space = sql_text(WHITESPACE)
    for i, (name, pattern, groups, _, needle) in enumerate(PASSWORDS):
        if wanted("passwords", i):
            cheap = _rlike(needle) if i == 0 else _contains(needle)
            searches.append(Search(f"_pw{i}", f"dets.passwords IS NOT NULL AND {cheap}", pattern,
                                   groups, 60, 8))
            value = f"trim(BOTH {space} FROM m.value)"
            built = _match("passwords", 100 + i, "m.pos",
                           f"concat({sql_text(name + ':')}, left({value}, 24))", value, "m.whole",
                           "m.left", "m.right")
            out.append(_guarded(f"_pw{i} IS NOT NULL",
                                f"filter(transform(_pw{i}, m -> {built}), m -> m.value <> '')"))
    firsts = ((STACK_TRACE, 0), (VERSION, 1), (None, 0), (INTERNAL_URL, 0))
    for i, (pattern, group) in enumerate(firsts):
        if wanted("framework", i):
            if pattern is None:
                test, value = _contains(DEVTOOLS), sql_text(DEVTOOLS)
            else:
                value = f"regexp_extract(content, {sql_text(pattern)}, {group})"
                test = f"{value} <> ''"
            out.append(_guarded(f"dets.framework IS NOT NULL AND {test}", "array(" + _match(
                "framework", i, "0", f"'{i}'", value, value) + ")"))
    for i, (_, path, _) in enumerate(ENDPOINTS):
        if wanted("endpoints", i):
            pattern = endpoint_pattern(path)
            searches.append(Search(
                f"_ep{i}", f"dets.endpoints IS NOT NULL AND {_rlike(ANY_ENDPOINT)} AND {_rlike(pattern)}",
                pattern, (1,), 40, 7))
            built = _match("endpoints", i, "m.pos", "m.value", "m.value", "m.whole", "m.left", "m.right")
            out.append(_guarded(f"_ep{i} IS NOT NULL", f"transform(_ep{i}, m -> {built})"))
    if wanted("sourcemaps", 0):
        out.append(_plain("sourcemaps", 0, _contains("sourceMappingURL="), SOURCE_MAP, 1, seen=False))
    if searches:
        bodies = with_context_matches(bodies, "content", searches)
    return bodies, out


def matches(bodies: DataFrame, only: tuple[str, ...] = GROUPS,
            rules: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """Every match, first of equal ones per body (the reference point of 'first' is
    rule order, then position)."""
    keys = ["scan_id", "page_id", "url", "asset_url", "item_ord", "label"]
    bodies, found = _with_candidates(bodies, only, rules)
    rows = bodies.select(*keys, F.explode(F.flatten(F.array(*found))).alias("m"))
    rows = rows.select(*keys, "m.*")
    return first_per(
        rows, ["scan_id", "page_id", "asset_url", "det_ord", "item_ord", "grp", "seen"],
        ["rule_ord", "pos"])


def password_class(value: Column, uri: Column) -> Column:
    """struct<severity,confidence>, NULL when the value is not worth reporting."""
    pair = lambda s, c: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    return (
        F.when(is_password_placeholder(value), F.lit(None))
        .when(uri & is_trivial_password(value), pair("medium", "medium"))
        .when(uri, pair("high", "high"))
        .when(is_trivial_password(value), pair("low", "low"))
        .when(is_high_entropy(value), pair("high", "high"))
        .when(F.length(value) >= 6, pair("medium", "medium")))


def _by_rule(table, base: int, field: int) -> Column:
    out = F.lit(None).cast("string")
    for i, row in enumerate(table):
        out = F.when(F.col("rule_ord") == base + i, F.lit(row[field])).otherwise(out)
    return out


def content_findings(bodies: DataFrame, only: tuple[str, ...] = GROUPS,
                     rules: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    m = matches(bodies, only, rules)
    value, whole = F.col("value"), F.col("whole")
    around = F.concat("left", "whole", "right")
    snippet = strip(F.regexp_replace(around, r"\s+", " "))
    in_label = lambda name: F.concat(name, F.lit(" in "), F.col("label"))
    common = dict(item=F.col("item_ord"), pos=F.col("pos"), url=F.col("url"))
    f = lambda **kw: finding(F.col("det_ord"), F.col("rule_ord"), **{**common, **kw})
    grp = F.col("grp")
    branches: list[tuple[str, Column]] = []
    if "secrets" in only:
        branches.append(("secrets", f(
            severity=F.when(is_placeholder(value), "low").when(is_high_entropy(value), "high")
            .otherwise("medium"),
            category=_by_rule(SECRETS, 10, 3), title=in_label(_by_rule(SECRETS, 10, 0)),
            evidence=F.left(whole, F.lit(200)), asset_url=F.col("asset_url"),
            description="A value that looks like a live credential is readable by visitors.",
            confidence=F.when(is_placeholder(value), "low").when(is_high_entropy(value), "high")
            .otherwise("medium"))))
    if "next_public" in only:
        name = F.regexp_extract(whole, "^(NEXT_PUBLIC_[A-Z0-9_]+)", 1)
        risky = name.rlike("KEY|SECRET|TOKEN")
        branches.append(("next_public", f(
            severity=F.when(risky, "medium").otherwise("info"),
            category=F.when(risky, "secret_exposure").otherwise("info"),
            title=F.concat(F.lit("Public environment variable: "), name),
            evidence=F.left(whole, F.lit(200)), asset_url=F.col("asset_url"),
            description="The variable is compiled into client code.", confidence="medium")))
    if "passwords" in only:
        uri = F.col("rule_ord") >= 102
        level = password_class(value, uri)
        text = F.when(F.length(snippet) > 300, F.concat(F.left(snippet, F.lit(300)), F.lit("…"))
                      ).otherwise(snippet)
        branches.append(("passwords", F.when(level.isNotNull(), f(
            severity=level["severity"], category="hardcoded_password",
            title=in_label(_by_rule(PASSWORDS, 100, 0)), evidence=text,
            asset_url=F.col("asset_url"), confidence=level["confidence"],
            description="A password is written into a file that visitors can read."))))
    if "framework" in only:
        rule = F.col("rule_ord")
        pick = lambda *v: F.when(rule == 0, v[0]).when(rule == 1, v[1]).when(
            rule == 2, v[2]).otherwise(v[3])
        branches.append(("framework", f(
            severity=pick("medium", "low", "low", "medium"),
            category=F.when(rule == 0, "verbose_error").otherwise("framework_leakage"),
            title=pick(F.lit("Stack trace exposed in page content"),
                       F.concat(F.lit("Framework version exposed: "), value),
                       F.lit("React DevTools hook detected"),
                       F.lit("Internal/localhost URL exposed")),
            evidence=pick(F.left(value, F.lit(300)),
                          F.concat(F.lit("Detected version: "), value),
                          F.concat(F.lit("Found "), value), value),
            description="The page reveals how or where the site runs.",
            confidence=pick("high", "medium", "medium", "high"))))
    if "endpoints" in only:
        branches.append(("endpoints", f(
            severity=_by_rule(ENDPOINTS, 0, 2), category="suspicious_endpoint_reference",
            title=F.concat(F.lit("Reference to "), _by_rule(ENDPOINTS, 0, 0), F.lit(": "), value),
            evidence=F.left(strip(F.replace(around, F.lit("\n"), F.lit(" "))), F.lit(300)),
            asset_url=F.col("asset_url"), confidence="medium",
            description="Client code names a path that may be meant for staff only.")))
    if "sourcemaps" in only:
        branches.append(("sourcemaps", F.when(~value.startswith("data:"), f(
            severity="medium", category="sourcemap_exposure",
            title="Source map reference found in JS bundle", evidence=whole,
            asset_url=F.coalesce("asset_url", "url"), confidence="high",
            description="The referenced map may give away the original source."))))
    out = F.coalesce(*[F.when(grp == name, built) for name, built in branches])
    rows = bind(m, "f", out).filter("f IS NOT NULL")
    return rows.select(*KEYS, "f.*")


# ---- bundles ----------------------------------------------------------------

def first_references(script_refs: DataFrame) -> DataFrame:
    """Each asset once per scan: the first page (then first tag) that loads it."""
    return first_per(script_refs, ["scan_id", "asset_url"], ["page_id", "ord"])


def bundle_findings(assets: DataFrame, script_refs: DataFrame,
                    responses: DataFrame | None = None,
                    only: tuple[str, ...] = GROUPS) -> DataFrame:
    """Scan every DISTINCT asset body once, then hand its findings to the scans that
    load it.  Bodies never travel through a join; findings (small) do."""
    found = content_findings(bundle_bodies(assets), only).drop("scan_id", "page_id", "url")
    # the reference of an endpoint or secret is the asset itself
    refs = first_references(script_refs).select("scan_id", "page_id", "url", "asset_url")
    out = found.join(refs, "asset_url").select(*KEYS, *ORDER, "severity", "category", "title",
        "description", "url", "asset_url", "evidence", "confidence")
    if responses is not None and "sourcemaps" in only:
        maps = out if only == ("sourcemaps",) else bundle_findings(
            assets, script_refs, None, ("sourcemaps",))
        out = out.unionByName(reachable_source_maps(maps, responses))
    return out


def reachable_source_maps(references: DataFrame, responses: DataFrame) -> DataFrame:
    """Source-map references whose target was captured with a success status."""
    refs = references.filter(F.col("category") == "sourcemap_exposure").withColumn(
        "_ref", F.regexp_extract("evidence", r"sourceMappingURL=([^\s]+)", 1))
    refs = with_resolved(refs, "_ref", "asset_url", "_full").withColumn(
        "map_url", F.when(F.col("_ref").startswith("http"), F.col("_ref")).otherwise(F.col("_full")))
    ctype = F.coalesce("content_type", F.lit(""))
    ok = responses.filter(F.col("status").between(200, 299) & (
        ctype.contains("json") | ctype.contains("javascript") | F.col("url").endswith(".map")))
    ok = first_per(ok.select(F.col("url").alias("map_url"), "status", ctype.alias("_ctype")),
                   ["map_url"], ["status", "_ctype"])
    hits = refs.join(ok, "map_url")
    f = finding(F.col("det_ord"), F.col("rule_ord") + 1, item=F.col("item_ord"), pos=F.col("pos"),
                severity="high", category="sourcemap_exposure", url=F.col("url"),
                title="Source map file is publicly accessible", asset_url=F.col("map_url"),
                evidence=F.concat(F.lit("GET "), F.col("map_url"), F.lit(" → HTTP "),
                                  F.col("status").cast("string"), F.lit(" ("), F.col("_ctype"),
                                  F.lit(")")),
                confidence="high", description="Anyone can download the original source.")
    return hits.select(*KEYS, f.alias("f")).select(*KEYS, "f.*")
