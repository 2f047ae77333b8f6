"""Cookie, web-storage and console rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.text import truncate
from glasswake.operators.findings import DET, KEYS, emit, finding

# ---- fixed values -----------------------------------------------------------
AUTH_COOKIE = (
    r"(?i)(?<![A-Za-z0-9_])(?:sess(?:ion)?|sid|auth|token|jwt|access|refresh|connect\.sid"
    r"|next[-_]?auth|supabase|clerk|firebase|amp[-_]?token|remember|logged[-_]?in|user[-_]?id"
    r"|account|csrf|xsrf|login)(?![A-Za-z0-9_])"
)
STORED_TOKENS = (
    ("JWT", r"eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*"),
    ("Bearer Token", r"Bearer\s+[A-Za-z0-9\-_]{20,}"),
    ("API Key", r"sk-[A-Za-z0-9]{20,}"),
)
SENSITIVE_KEY = (
    r"(?i)token|auth|jwt|session|credential|password|secret|key|email|role|permission"
    r"|userid|user_id"
)
SECRET_KEY = r"(?i)password|secret|private"
STACK_FRAME = r"at\s+\S+\s+\("
SERVER_PATH = r"/home/|/usr/|/var/|/etc/|C:\\"
LONG_LIVED_DAYS, VERY_LONG_LIVED_DAYS = 90, 365


def is_auth_cookie(name: Column) -> Column:
    return name.rlike(AUTH_COOKIE)


def _days_left(as_of: int) -> Column:
    return (F.col("expires") - F.lit(as_of)) / 86400


def cookie_flags(as_of: int) -> Column:
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    days = F.floor(_days_left(as_of) + 0.5).cast("bigint").cast("string")
    expires = F.when(F.coalesce(F.col("expires"), F.lit(0)) != 0,
                     F.concat(F.lit("Expires=~"), days, F.lit("d"))).otherwise("Expires=session")
    return F.concat_ws(
        "; ", F.concat(F.lit("HttpOnly="), flag("http_only")),
        F.concat(F.lit("Secure="), flag("secure")),
        F.concat(F.lit("SameSite="), F.coalesce("same_site", F.lit("not set"))), expires)


def cookie_findings(cookies: DataFrame, as_of: int,
                    only: tuple[str, ...] | None = None) -> DataFrame:
    """``as_of`` (epoch seconds) stands for "now", so a run can be repeated exactly."""
    df = (cookies.withColumn("_auth", is_auth_cookie(F.col("name")))
          .withColumn("_ev", F.concat(F.col("name"), F.lit(" ["), cookie_flags(as_of), F.lit("]"))))
    auth, name = F.col("_auth"), F.col("name")
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    site = F.coalesce(F.col("same_site"), F.lit(""))
    pick = lambda a, b: F.when(auth, a).otherwise(b)
    days = _days_left(as_of)
    # group, order, condition, severity, title, confidence, description
    table = [
        ("httponly", 0, off("http_only"), pick("high", "medium"),
         pick("Auth/session cookie missing HttpOnly: ", "Cookie missing HttpOnly flag: "),
         pick("high", "medium"), "Scripts on the page can read the cookie."),
        ("secure", 1, F.col("url").startswith("https://") & off("secure"), pick("high", "medium"),
         pick("Auth/session cookie missing Secure flag: ", "Cookie missing Secure flag: "),
         F.lit("high"), "The cookie may travel over plain HTTP."),
        ("samesite", 2, site == "", pick("medium", "low"),
         pick("Auth/session cookie missing SameSite attribute: ",
              "Cookie missing SameSite attribute: "),
         pick("high", "medium"), "The cookie may be sent with cross-site requests."),
        ("samesite", 3, (site == "None") & off("secure"), F.lit("high"),
         F.lit("Cookie uses SameSite=None without Secure: "), F.lit("high"),
         "SameSite=None only works together with Secure."),
        ("longlived", 4,
         auth & (F.coalesce("expires", F.lit(0)) != 0) & (days > LONG_LIVED_DAYS),
         F.when(days > VERY_LONG_LIVED_DAYS, "medium").otherwise("low"),
         F.lit("Long-lived auth/session cookie: "), F.lit("medium"),
         "A stolen session stays usable for a long time."),
    ]
    return emit(df, [
        F.when(cond, finding("cookies", i, item=F.col("cookie_ord"), severity=sev,
                             category="insecure_cookie", title=F.concat(title, name),
                             url=F.col("url"), evidence=F.col("_ev"), confidence=conf,
                             description=why))
        for group, i, cond, sev, title, conf, why in table if not only or group in only])


def cookie_summary(cookies: DataFrame) -> DataFrame:
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return cookies.select(
        *KEYS, "cookie_ord", "name", is_auth_cookie(F.col("name")).alias("is_auth"),
        on("http_only").alias("http_only"), on("secure").alias("secure"),
        F.coalesce("same_site", F.lit("not set")).alias("same_site"),
        (F.coalesce("expires", F.lit(0)) <= 0).alias("session_only"))


def storage_findings(storage: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Token, key-name and JSON-field rules; secrets in values come from ``content``."""
    kind, key, value = F.col("storage_type"), F.col("key"), F.col("value")
    det = F.when(kind == "localStorage", DET["localStorage"]).otherwise(DET["sessionStorage"])
    label = F.concat(kind, F.lit('["'), key, F.lit('"] = '))
    cut = lambda n: F.concat(label, F.lit('"'), truncate(value, n), F.lit('"'))
    common = dict(item=F.col("item_ord"), category="storage_risk", url=F.col("url"))
    rules: list[Column] = []
    if not only or "tokens" in only:
        for i, (name, pattern) in enumerate(STORED_TOKENS):
            rules.append(F.when(value.rlike(pattern), finding(
                det, i, severity="high", title=F.concat(F.lit(f"{name} found in "), kind),
                evidence=cut(100), confidence="high",
                description="Every script on the page can read web storage.", **common)))
    if not only or "keys" in only:
        rules.append(F.when(
            key.rlike(SENSITIVE_KEY) & (F.length(value) > 8) & key.rlike(SECRET_KEY), finding(
                det, 100, severity="medium", evidence=cut(80), confidence="medium",
                title=F.concat(F.lit("Sensitive key in "), kind, F.lit(': "'), key, F.lit('"')),
                description="The key name suggests private data.", **common)))
    if not only or "json" in only:
        fields = F.array_join(F.json_object_keys(value), " ")
        rules.append(F.when(fields.rlike(SENSITIVE_KEY), finding(
            det, 101, severity="medium", confidence="medium",
            title=F.concat(F.lit("Object with sensitive fields in "), kind, F.lit(': "'), key,
                           F.lit('"')),
            evidence=F.concat(label, F.left(F.to_json(F.try_parse_json(value)), F.lit(200))),
            description="Field names suggest user data or credentials.", **common)))
    return emit(storage, rules)


def console_findings(console: DataFrame) -> DataFrame:
    """Per page: path leaks up to the first stack trace, then that trace, then stop.

    The position of the first trace is a plain minimum (partial aggregation), so a
    page with very many lines never has to sit in one task.
    """
    lines = (console.filter(F.col("type").isin("error", "warning"))
             .withColumn("_stack", F.col("text").rlike(STACK_FRAME))
             .filter(F.col("_stack") | F.col("text").rlike(SERVER_PATH)))
    stop = lines.filter("_stack").groupBy(*KEYS).agg(F.min("ord").alias("_stop"))
    kept = lines.join(stop, KEYS, "left").filter(
        F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop")))
    common = dict(category="verbose_error", url=F.col("url"), item=F.col("ord"),
                  evidence=F.left("text", F.lit(300)), confidence="high")
    return emit(kept, [
        F.when(F.col("_stack"), finding(
            "console", 0, severity="low", title="Stack trace in browser console",
            description="The console shows where the code failed.", **common)),
        F.when(~F.col("_stack"), finding(
            "console", 1, severity="medium", title="Internal file path in console error",
            description="The console names a path on the server.", **common)),
    ])
