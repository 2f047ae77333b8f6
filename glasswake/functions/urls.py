"""URL handling as column expressions (browser URL rules for http and https).

``with_url`` parses a URL column with ONE regular-expression pass into a struct;
everything else reads fields of that struct, so a URL is never parsed twice in
a plan.  International host names take their ASCII form (``hosts``); non-http
schemes are passed through as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.bind import bind
from glasswake.functions.hosts import ascii_host
from glasswake.functions.text import sql_text

# Links that change state, and schemes that are never crawled.
DESTRUCTIVE_WORDS = (
    "logout", "sign.?out", "log.?out", "delete", "remove",
    "unsubscribe", "checkout", "purchase", "pay", "destroy",
)
SKIPPED_SCHEMES = ("mailto:", "tel:", "javascript:", "blob:", "data:")

_SEP = "\u0001"
_HTTP_URL = (
    r"(?is)^(https?):[/\\]*"            # 1 scheme
    r"(?:([^/\\?#]*)@)?"                # 2 user info
    r"(\[[^\]/?#]*\]|[^:/\\?#@]*)"      # 3 host
    r"(?::(\d*))?(?=[/\\?#]|\z)"        # 4 port
    r"([^?#]*)(\?[^#]*)?(#.*)?\z"       # 5 path, 6 query, 7 fragment
)
_BAD_HOST = r"[\s%<>^|\\\]\[\x00-\x20]"
_PATH_ESCAPED = r'[^\x21-\x7e]|["<>`{}^]'
_QUERY_ESCAPED = r"""[^\x21-\x7e]|["<>']"""
# characters a path or query keeps as they are although form encoding escapes them
_PATH_KEPT = "/:@!$&'()+,;=~[]|\\"
_QUERY_KEPT = "/:@!$&()+,;=~[]|\\?`{}^"


def clean(c: Column) -> Column:
    """Strip outer control characters and spaces, drop tabs and newlines."""
    c = F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.regexp_replace(c, r"[\t\r\n]", "")


def _escape(c: str, needs: str, kept: str) -> str:
    """SQL text: percent-encode what a browser encodes, leave the rest alone."""
    out = f"replace(url_encode({c}), '+', '%20')"
    for ch in kept:
        out = f"replace({out}, '%{ord(ch):02X}', {sql_text(ch)})"
    return f"CASE WHEN {c} RLIKE {sql_text(needs)} THEN replace({out}, '%25', '%') ELSE {c} END"


_DOT, _DOTS = r"(?i)^(\.|%2e)\z", r"(?i)^(\.|%2e)(\.|%2e)\z"
_NO_TEXT = "CAST(array() AS array<string>)"


def _fold_dots(path: str) -> str:
    """SQL text: resolve '.' and '..' segments."""
    folded = (
        f"aggregate(split(substring({path}, 2), '/', -1), {_NO_TEXT}, (acc, s) -> CASE "
        f"WHEN s RLIKE {sql_text(_DOTS)} THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        f"WHEN s RLIKE {sql_text(_DOT)} THEN acc ELSE concat(acc, array(s)) END)")
    ends = r"(?i)/(\.|%2e){1,2}\z"
    tail = f"CASE WHEN {path} RLIKE {sql_text(ends)} THEN array('') ELSE {_NO_TEXT} END"
    anywhere = r"(?i)/(\.|%2e){1,2}(/|\z)"
    return (f"CASE WHEN {path} RLIKE {sql_text(anywhere)} THEN "
            f"concat('/', array_join(concat({folded}, {tail}), '/')) ELSE {path} END")


_NETLOC = ("CASE WHEN _u.port = '' OR (_u.scheme = 'http' AND _u.port = '80') "
           "OR (_u.scheme = 'https' AND _u.port = '443') THEN _u.host "
           "ELSE concat(_u.host, ':', _u.port) END")


def with_url(df: DataFrame, src: str | Column, out: str) -> DataFrame:
    """Add struct ``out``: scheme, user, host, netloc, origin, path, search, hash.

    All fields are NULL when ``src`` is no valid absolute http(s) URL.
    """
    c = F.col(src) if isinstance(src, str) else src
    groups = _SEP.join("$%d" % i for i in range(1, 8))
    df = df.withColumn("_g", F.split(F.regexp_replace(clean(c), _HTTP_URL, groups), _SEP, -1))
    g = [f"get(_g, {i})" for i in range(7)]
    df = df.withColumn("_u", F.expr(f"""CASE WHEN size(_g) = 7 THEN struct(
        lower({g[0]}) AS scheme, {g[1]} AS user, {ascii_host(f"lower({g[2]})")} AS host,
        regexp_replace({g[3]}, '^0+(?=.)', '') AS port,
        coalesce(nullif(replace({g[4]}, {sql_text(chr(92))}, '/'), ''), '/') AS path,
        CASE WHEN {g[5]} = '?' THEN '' ELSE {g[5]} END AS search, {g[6]} AS hash) END"""))
    return bind(df, out, F.expr(f"""CASE WHEN _u.host <> '' AND NOT _u.host RLIKE {sql_text(_BAD_HOST)}
        AND (_u.port = '' OR try_cast(_u.port AS INT) <= 65535) THEN struct(
        _u.scheme AS scheme, _u.user AS user, _u.host AS host, {_NETLOC} AS netloc,
        concat(_u.scheme, '://', {_NETLOC}) AS origin,
        {_fold_dots("(" + _escape("_u.path", _PATH_ESCAPED, _PATH_KEPT) + ")")} AS path,
        {_escape("_u.search", _QUERY_ESCAPED, _QUERY_KEPT)} AS search, _u.hash AS hash) END""")
                ).drop("_g", "_u")


def href(u: Column) -> Column:
    user = F.when(u["user"] != "", F.concat(u["user"], F.lit("@"))).otherwise(F.lit(""))
    return F.concat(u["scheme"], F.lit("://"), user, u["netloc"], u["path"], u["search"], u["hash"])


def _slashless(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/\z", ""))


def with_normalized(df: DataFrame, src: str, out: str) -> DataFrame:
    """Typed-in address -> https:// default, no fragment, no trailing slash."""
    t = F.trim(F.col(src), F.lit(" \t\r\n"))
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    df = with_url(df, full, "_n")
    u = F.col("_n")
    return df.withColumn(
        out, F.concat(u["origin"], _slashless(u["path"]), u["search"])).drop("_n")


def form_decode(c: Column) -> Column:
    """application/x-www-form-urlencoded decoding that tolerates stray percent signs."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_pairs(search: Column) -> Column:
    """'?a=1&b' -> array<struct<name,pos,value>>, decoded, in order of appearance."""
    parts = F.filter(F.split(F.regexp_replace(search, r"^\?", ""), "&", -1), lambda p: p != "")
    return F.transform(parts, lambda p, i: F.struct(
        form_decode(F.substring_index(p, "=", 1)).alias("name"),
        i.alias("pos"),
        F.when(p.contains("="), form_decode(F.regexp_replace(p, "^[^=]*=", "")))
        .otherwise(F.lit("")).alias("value"),
    ))


def with_canonical(df: DataFrame, src: str, out: str) -> DataFrame:
    """No fragment, query sorted stably by name, no trailing slash; invalid -> as is."""
    df = with_url(df, src, "_k")
    u = F.col("_k")
    # the common URL has no query: skip the sort for it
    sorted_query = F.array_join(F.transform(
        F.array_sort(query_pairs(u["search"])),
        lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    query = F.when(u["search"] == "", F.lit("")).otherwise(
        F.when(sorted_query == "", F.lit("")).otherwise(F.concat(F.lit("?"), sorted_query)))
    return bind(df, out, F.coalesce(
        F.concat(u["origin"], _slashless(u["path"]), query), F.col(src))).drop("_k")


def with_resolved(df: DataFrame, ref: str, base: str, out: str) -> DataFrame:
    """Resolve ``ref`` against the absolute URL ``base``; NULL when it cannot be."""
    df = with_url(df, base, "_b").withColumn("_r", clean(F.col(ref)))
    b, r = F.col("_b"), F.col("_r")
    same_page = F.concat(b["origin"], b["path"], b["search"])
    absolute = (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
        .when(r.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), r))
        .when(r.rlike(r"^[/\\]"), F.concat(b["origin"], r))
        .when(r == "", same_page)
        .when(r.startswith("#"), F.concat(same_page, r))
        .when(r.startswith("?"), F.concat(b["origin"], b["path"], r))
        .otherwise(F.concat(b["origin"], F.regexp_extract(b["path"], "^(.*/)", 1), r))
    )
    df = with_url(df.withColumn("_a", absolute), "_a", "_x")
    other = F.when(~F.col("_a").rlike("(?i)^https?:"), F.col("_a"))
    return bind(df, out, F.coalesce(href(F.col("_x")), other)).drop("_b", "_r", "_a", "_x")


def is_destructive(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(DESTRUCTIVE_WORDS))


def is_skippable(c: Column) -> Column:
    return c.rlike("(?i)^(" + "|".join(SKIPPED_SCHEMES) + ")")


def with_pull_request(df: DataFrame, src: str) -> DataFrame:
    """owner, repo, pr_number from a pull-request address; ``pr_url_error`` flags bad rows."""
    pattern = r"github\.com/([^/]+)/([^/]+)/pull/(\d+)"
    hit = F.col(src).rlike(pattern)
    part = lambda i: F.when(hit, F.regexp_extract(src, pattern, i))
    return (df.withColumn("owner", part(1)).withColumn("repo", part(2))
            .withColumn("pr_number", part(3).try_cast("bigint"))
            .withColumn("pr_url_error", ~F.coalesce(hit, F.lit(False))))
