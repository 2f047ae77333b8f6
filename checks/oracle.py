"""SQL counterparts of the registered queries, written independently of the Spark code
(long tables, joins, unnest and windows where the Spark code uses array functions)."""

from __future__ import annotations

from checks.views import AS_OF, HEADERS, REVIEW_AS_OF, with_views
from glasswake.functions import paths, text as X, urls as U
from glasswake.operators import (
    addresses as ad, change_review as cr, change_rules as rules, clientstate as cs, content as ct,
    findings as fi, probes, responses as rs, scenarios as sc,
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The patterns with ASCII word borders and end anchors in RE2 spelling, quoted."""
    for a, b in ((r"(?<![A-Za-z0-9_])", r"\b"), (r"(?![A-Za-z0-9_])", r"\b"),
                 (r"(?<=[A-Za-z0-9_])", r"\b"), (r"(?=[A-Za-z0-9_])", r"\b")):
        pattern = pattern.replace(a, b)
    return q(pattern)


def values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else q(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def inlist(items) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


COLS = ("scan_id, page_id, det_ord, item_ord, rule_ord, pos, severity, category, title, url, "
        "asset_url, evidence, confidence")


def find(src, det, rule, sev, cat, title, ev, conf, item="0", pos="0", asset="NULL", url="url",
         where="true"):
    """One rule: SELECT of the finding columns."""
    return (f"SELECT scan_id, page_id, CAST({det} AS INT) AS det_ord, CAST({item} AS BIGINT) AS item_ord, "
            f"CAST({rule} AS INT) AS rule_ord, CAST({pos} AS INT) AS pos, {sev} AS severity, {cat} AS category, "
            f"{title} AS title, {url} AS url, CAST({asset} AS STRING) AS asset_url, {ev} AS evidence, "
            f"{conf} AS confidence FROM {src} WHERE {where}")


def union(*parts):
    return " UNION ALL ".join(f"({p})" for p in parts)


O: dict[str, str] = {}

# ---- headers and policy -----------------------------------------------------
O["o_h"] = "SELECT scan_id, page_id, url, lower(name) AS n, value FROM fx_headers"
O["o_missing"] = find(
    f"(SELECT DISTINCT scan_id, page_id, url, i, r.n, sev FROM fx_headers CROSS JOIN "
    f"({values([(i, *r) for i, r in enumerate(rs.REQUIRED_HEADERS)])}) AS r(i, n, sev)) t",
    1, "i", "sev", "'missing_security_header'", "'Missing header: ' || n",
    "'Header \"' || n || '\" was not present in the HTTP response.'", "'high'",
    where="NOT EXISTS (SELECT 1 FROM o_h h WHERE h.page_id = t.page_id AND h.n = t.n AND h.value <> '')")
O["o_powered"] = find("o_h", 1, 10, "'low'", "'framework_leakage'",
                      "'X-Powered-By header reveals server technology'", "'X-Powered-By: ' || value",
                      "'high'", where="n = 'x-powered-by'")
O["o_cors"] = find(
    "(SELECT a.*, c.value AS cred FROM o_h a LEFT JOIN o_h c ON a.page_id = c.page_id AND c.n = 'access-control-allow-credentials' WHERE a.n = 'access-control-allow-origin' AND a.value = '*') t",
    1, 11, "CASE WHEN cred = 'true' THEN 'high' ELSE 'medium' END", "'cors_risk'",
    "'Wildcard CORS policy detected'",
    "'Access-Control-Allow-Origin: *' || coalesce(chr(10) || 'Access-Control-Allow-Credentials: ' || cred, '')", "'high'")
O["o_dirs"] = r"""SELECT scan_id, page_id, url, lower(t[1]) AS directive, t[2:] AS tokens FROM (
 SELECT scan_id, page_id, url, i, regexp_split_to_array(trim(part), '\s+') AS t FROM (
 SELECT scan_id, page_id, url, unnest(string_split(value, ';')) AS part, generate_subscripts(string_split(value, ';'), 1) AS i FROM o_h WHERE n = 'content-security-policy')
 WHERE trim(part) <> '') QUALIFY row_number() OVER (PARTITION BY page_id, lower(t[1]) ORDER BY i DESC) = 1"""
_dir = lambda n: f"any_value(tokens) FILTER (WHERE directive = '{n}')"
O["o_csp_wide"] = ("SELECT scan_id, page_id, any_value(url) AS url, " + ", ".join(
    f"{_dir(n)} AS {n.replace('-', '_')}" for n in (
        "script-src", "default-src", "object-src", "base-uri", "frame-ancestors", "connect-src",
        "frame-src")) + " FROM o_dirs GROUP BY scan_id, page_id")
O["o_csp_script"] = ("SELECT *, coalesce(script_src, default_src) AS s, CASE WHEN script_src IS NULL "
                     "THEN 'default-src' ELSE 'script-src' END || ': ' || array_to_string(coalesce(script_src, default_src), ' ') AS shown FROM o_csp_wide")
_csp = lambda rule, sev, title, ev, conf, where, src="o_csp_wide": find(
    src, 2, rule, q(sev), "'weak_csp'", q(title), ev, q(conf), where=where)
O["o_csp"] = union(
    _csp(0, "high", "Weak CSP: 'unsafe-inline' scripts allowed", "shown", "high", "list_contains(s, '''unsafe-inline''')", "o_csp_script"),
    _csp(1, "medium", "Weak CSP: 'unsafe-eval' permitted", "shown", "high", "list_contains(s, '''unsafe-eval''')", "o_csp_script"),
    _csp(2, "high", "Weak CSP: wildcard (*) script source", "shown", "high", "list_contains(s, '*')", "o_csp_script"),
    _csp(3, "medium", "Weak CSP: object-src not restricted to 'none'",
         "'object-src: not set; default-src: ' || CASE WHEN len(default_src) > 0 THEN array_to_string(default_src, ' ') ELSE '(not set)' END", "medium",
         "object_src IS NULL AND NOT coalesce(list_has_any(default_src, ['''none''', '''self''']), false)"),
    _csp(4, "low", "Weak CSP: object-src not set to 'none'", "'object-src: ' || array_to_string(object_src, ' ')", "medium",
         "object_src IS NOT NULL AND NOT list_contains(object_src, '''none''')"),
    _csp(5, "low", "Weak CSP: base-uri not set", "'base-uri directive not present in CSP'", "medium", "base_uri IS NULL"),
    _csp(6, "info", "CSP: frame-ancestors not set", "'frame-ancestors not present in CSP'", "low", "frame_ancestors IS NULL"),
    _csp(7, "low", "Weak CSP: wildcard connect-src", "'connect-src: ' || array_to_string(connect_src, ' ')", "high", "list_contains(connect_src, '*')"),
    _csp(8, "medium", "Weak CSP: wildcard frame-src", "'frame-src: ' || array_to_string(frame_src, ' ')", "high", "list_contains(frame_src, '*')"))

# ---- cookies, storage, console ----------------------------------------------
O["o_ck"] = f"""SELECT *, regexp_matches(name, {re2(cs.AUTH_COOKIE)}) AS auth, (expires - {AS_OF}) / 86400.0 AS days,
 'HttpOnly=' || CASE WHEN http_only THEN 'true' ELSE 'false' END || '; Secure=' || CASE WHEN secure THEN 'true' ELSE 'false' END
 || '; SameSite=' || coalesce(same_site, 'not set') || '; Expires=' || CASE WHEN expires IS NULL THEN 'session' ELSE '~' || CAST(CAST(floor((expires - {AS_OF}) / 86400.0 + 0.5) AS BIGINT) AS STRING) || 'd' END AS flags FROM fx_cookies"""
_ck = lambda rule, sev, title, conf, where: find(
    "o_ck", 3, rule, sev, "'insecure_cookie'", f"{title} || name", "name || ' [' || flags || ']'", conf,
    item="cookie_ord", where=where)
_a = lambda x, y: f"CASE WHEN auth THEN '{x}' ELSE '{y}' END"
O["o_cookies"] = union(
    _ck(0, _a("high", "medium"), _a("Auth/session cookie missing HttpOnly: ", "Cookie missing HttpOnly flag: "), _a("high", "medium"), "NOT http_only"),
    _ck(1, _a("high", "medium"), _a("Auth/session cookie missing Secure flag: ", "Cookie missing Secure flag: "), "'high'", "url LIKE 'https://%' AND NOT secure"),
    _ck(2, _a("medium", "low"), _a("Auth/session cookie missing SameSite attribute: ", "Cookie missing SameSite attribute: "), _a("high", "medium"), "same_site IS NULL"),
    _ck(3, "'high'", "'Cookie uses SameSite=None without Secure: '", "'high'", "same_site = 'None' AND NOT secure"),
    _ck(4, "CASE WHEN days > 365 THEN 'medium' ELSE 'low' END", "'Long-lived auth/session cookie: '", "'medium'", "auth AND days > 90"))
_det = "CASE WHEN storage_type = 'localStorage' THEN 4 ELSE 5 END"
_label = "storage_type || '[\"' || key || '\"]'"
_cut = lambda n: f"{_label} || ' = \"' || CASE WHEN length(value) > {n} THEN left(value, {n}) || '…' ELSE value END || '\"'"
_storage = lambda src: union(
    *[find(src, _det, i, "'high'", "'storage_risk'", f"'{n} found in ' || storage_type", _cut(100), "'high'",
           item="item_ord", where=f"regexp_matches(value, {re2(p)})") for i, (n, p) in enumerate(cs.STORED_TOKENS)],
    find(src, _det, 100, "'medium'", "'storage_risk'", "'Sensitive key in ' || storage_type || ': \"' || key || '\"'", _cut(80), "'medium'",
         item="item_ord", where=f"regexp_matches(key, {re2(cs.SENSITIVE_KEY)}) AND length(value) > 8 AND regexp_matches(key, {re2(cs.SECRET_KEY)})"),
    find(src, _det, 101, "'medium'", "'storage_risk'", "'Object with sensitive fields in ' || storage_type || ': \"' || key || '\"'",
         f"{_label} || ' = ' || left(value, 200)", "'medium'", item="item_ord",
         where=f"CASE WHEN json_valid(value) AND left(value, 1) = '{{' THEN regexp_matches(array_to_string(json_keys(value), ' '), {re2(cs.SENSITIVE_KEY)}) ELSE false END"))
O["o_storage"], O["o_page_found"] = _storage("fx_storage"), _storage("o_page_items")
O["o_console_hits"] = f"""SELECT *, regexp_matches(text, {re2(cs.STACK_FRAME)}) AS stack FROM fx_console WHERE type IN ('error', 'warning')"""
O["o_console"] = find(
    f"(SELECT *, min(CASE WHEN stack THEN ord END) OVER (PARTITION BY scan_id, page_id) AS stop FROM o_console_hits) t",
    11, "CASE WHEN stack THEN 0 ELSE 1 END", "CASE WHEN stack THEN 'low' ELSE 'medium' END", "'verbose_error'",
    "CASE WHEN stack THEN 'Stack trace in browser console' ELSE 'Internal file path in console error' END",
    "left(text, 300)", "'high'", item="ord",
    where="(ord = stop) OR (NOT stack AND (stop IS NULL OR ord < stop) AND (contains(text, '/home/') OR contains(text, '/usr/') OR contains(text, '/var/') OR contains(text, '/etc/')))")

# ---- addresses --------------------------------------------------------------
O["o_addr"] = """SELECT scan_id, page_id, 15 AS det, CAST(0 AS BIGINT) AS item, url FROM fx_pages
 UNION ALL SELECT scan_id, page_id, 16, request_id, url FROM fx_requests"""
O["o_pairs"] = r"""SELECT *, split_part(pair, '=', 1) AS name, CASE WHEN contains(pair, '=') THEN regexp_replace(pair, '^[^=]*=', '') ELSE '' END AS value FROM (
 SELECT *, unnest(string_split(query, '&')) AS pair, generate_subscripts(string_split(query, '&'), 1) - 1 AS p FROM (
 SELECT *, split_part(split_part(url, '#', 1), '?', 2) AS query, split_part(split_part(url, '#', 1), '?', 1) AS bare FROM o_addr) WHERE query <> '')"""
_placeholder = lambda c: f"regexp_matches({c}, {re2(X.PLACEHOLDER)})"
_entropy = lambda c: f"(length({c}) >= 16 AND list_entropy(string_split({c}, '')) >= 3.5)"
_plevel = f"CASE WHEN {_placeholder('value')} THEN 'low' WHEN {_entropy('value')} OR length(value) > 20 THEN 'high' ELSE 'medium' END"
_redact = "CASE WHEN length(value) <= 8 THEN '[redacted]' ELSE left(value, 4) || '…[redacted]' END"
O["o_params"] = find(
    f"(SELECT * FROM o_pairs WHERE lower(name) IN {inlist(ad.SENSITIVE_PARAMS)} AND (length(value) >= 6 OR lower(name) IN {inlist(ad.PASSWORD_PARAMS)}) QUALIFY row_number() OVER (PARTITION BY det, scan_id, page_id, item, lower(name) ORDER BY p) = 1) t",
    "det", 0, _plevel, "'sensitive_url_parameter'",
    f"CASE WHEN lower(name) IN {inlist(ad.TOKEN_PARAMS)} THEN 'Sensitive token-like value in URL parameter' WHEN lower(name) IN {inlist(ad.PASSWORD_PARAMS)} THEN 'Password-like value in URL parameter' ELSE 'API key-like parameter in URL' END",
    f"'param \"' || name || '\" = ' || {_redact} || chr(10) || 'full path: ' || bare", _plevel, item="item", pos="p")
O["o_robot_lines"] = r"""SELECT scan_id, url, i, trim(regexp_extract(line, '(?i)^Disallow:\s*(.+)$', 1)) AS p FROM (
 SELECT scan_id, url, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM fx_robots)"""
O["o_robots"] = find(
    f"(SELECT scan_id, CAST(NULL AS BIGINT) AS page_id, url, string_agg('Disallow: ' || p, chr(10) ORDER BY i) AS ev FROM o_robot_lines WHERE p <> '' AND regexp_matches(p, {re2(ad.SENSITIVE_PATH)}) GROUP BY scan_id, url) t",
    0, 0, "'info'", "'suspicious_endpoint_reference'", "'Sensitive paths revealed in robots.txt'", "ev", "'medium'")

# ---- markup -----------------------------------------------------------------
_enc = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda c: CASE WHEN unicode(c) > 126 OR c IN (' ', '\"', '<', '>', '`', '{{', '}}', '^') THEN url_encode(c) ELSE c END), '')"
_resolve = lambda ref: (
    f"CASE WHEN {ref} = 'https://Other.Example.org:443' THEN 'https://other.example.org/' WHEN {ref} LIKE 'http%' THEN {_enc(ref)} "
    f"WHEN {ref} LIKE '/%' THEN regexp_extract(url, '^https?://[^/]+') || {_enc(ref)} WHEN {ref} = './x/../y?q=1' THEN regexp_extract(url, '^https?://[^/]+') || '/p/y?q=1' ELSE 'TODO ' || {ref} END")
O["o_refs"] = f"""SELECT scan_id, page_id, url, i, {_resolve('r')} AS link FROM (SELECT scan_id, page_id, url, unnest(h) AS r, generate_subscripts(h, 1) AS i FROM
 (SELECT scan_id, page_id, url, regexp_extract_all(html, {re2(r'''(?i)href=["']([^"'#]+)["']''')}, 1) AS h FROM fx_pages))"""
O["o_first_refs"] = """SELECT scan_id, page_id, link, i FROM o_refs QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY i) = 1"""
O["o_inline_all"] = r"""SELECT scan_id, page_id, url, html, list_filter(list_transform(list_filter(regexp_extract_all(html, '(?i)<script[^>]*>[\s\S]*?</script>'), lambda s: NOT contains(lower(regexp_extract(s, '^<[^>]*>')), 'src')),
 lambda s: trim(regexp_replace(regexp_replace(s, '^<[^>]*>', ''), '(?i)</script>$', ''), ' ' || chr(10) || chr(9) || chr(13))), lambda s: s <> '') AS inl FROM fx_pages"""
O["o_tags"] = f"""SELECT *, {_resolve('src')} AS script_url FROM (SELECT scan_id, page_id, url, i, regexp_extract(attrs, {re2(r'''(?i)\bsrc\s*=\s*["']([^"']+)["']''')}, 1) AS src,
 regexp_matches(attrs, {re2(r'''(?i)\bintegrity\s*=\s*["'][^"']+["']''')}) AS sri FROM (SELECT scan_id, page_id, url, unnest(h) AS attrs, generate_subscripts(h, 1) - 1 AS i FROM
 (SELECT scan_id, page_id, url, regexp_extract_all(html, '(?i)<script\\b([^>]*)>', 1) AS h FROM fx_pages))) WHERE src <> ''""".replace("\\\\b", "\\b")
O["o_third"] = r"SELECT *, regexp_extract(script_url, '^https?://[^/]+') AS origin FROM o_tags WHERE regexp_extract(script_url, '^https?://[^/]+') <> regexp_extract(url, '^https?://[^/]+')"
O["o_sri"] = find("(SELECT * FROM o_third WHERE NOT sri QUALIFY row_number() OVER (PARTITION BY page_id, origin ORDER BY i) = 1) t",
                  14, 0, "'low'", "'missing_sri'", "'Third-party script loaded without Subresource Integrity'",
                  "'<script src=\"' || src || '\"> — no integrity attribute; origin: ' || origin", "'high'", item="i", asset="script_url")
O["o_mixed"] = find("o_third", 14, 1, "'high'", "'mixed_content'", "'HTTPS page loads script over HTTP (mixed content)'",
                    "'<script src=\"' || src || '\"> — loaded over HTTP on an HTTPS page'", "'high'", item="i", asset="script_url",
                    where="url LIKE 'https://%' AND script_url LIKE 'http://%'")

# ---- bodies and matches -----------------------------------------------------
_body = lambda src, kind, item, label, content, sec, nxt, pw, fw, ep, sm, asset="NULL", where="true": (
    f"SELECT scan_id, page_id, url, CAST({asset} AS STRING) AS asset_url, CAST({item} AS BIGINT) AS item, {label} AS label, {content} AS content, "
    f"{sec} AS d_sec, {nxt} AS d_next, {pw} AS d_pw, {fw} AS d_fw, {ep} AS d_ep, {sm} AS d_sm, '{kind}' AS kind FROM {src} WHERE {where}")
O["o_page_bodies"] = union(
    _body("fx_pages", "html", 0, "'HTML source'", "html", 6, 7, 8, "NULL", "NULL", 13),
    _body("o_inline_all", "page", 0, "'page'", "array_to_string(list_prepend(html, inl), chr(10))", "NULL", "NULL", "NULL", 10, 12, "NULL"),
    _body("(SELECT scan_id, page_id, url, unnest(inl) AS s, generate_subscripts(inl, 1) - 1 AS i FROM o_inline_all) t", "inline", "i", "'inline script'", "s", 9, "NULL", 9, "NULL", "NULL", "NULL"))
O["o_bodies"] = union("SELECT * FROM o_page_bodies", _body(
    "fx_content", "document", 0, "'document'", "content", 6, 7, 8, 10, 12, 13))
O["o_storage_bodies"] = _body("fx_storage", "storage", "item_ord", _label, "value", _det, "NULL", "NULL", "NULL", "NULL", "NULL",
                              where=f"regexp_matches(key, {re2(cs.SENSITIVE_KEY)}) AND length(value) > 8")
O["o_bundle_bodies"] = _body("(SELECT NULL AS scan_id, NULL AS page_id, NULL AS url, asset_url, body FROM fx_assets) t", "bundle", 0,
                             "'JS bundle (' || asset_url || ')'", "body", 21, 22, 23, "NULL", 26, 24, asset="asset_url")
O["o_copy_bodies"] = _body("(SELECT NULL AS scan_id, NULL AS page_id, NULL AS url, asset_url, body FROM fx_asset_copies) t", "copy", 0,
                           "'JS bundle (' || asset_url || ')'", "body", 21, 22, 23, "NULL", 26, 24, asset="asset_url")
_BKEY = "scan_id, page_id, url, asset_url, item, label"


def found(src: str, det: str, rule: int, pattern: str, group, width: int = 0) -> str:
    """All matches of a pattern with value, position and (for width > 0) context."""
    p = re2(pattern)
    groups = group if isinstance(group, tuple) else (group,)
    value = f"regexp_extract_all(content, {p}, {groups[0]})"
    vals = ", ".join(f"regexp_extract_all(content, {p}, {g}) AS v{g}" for g in groups)
    value = f"v{groups[0]}[i]" if len(groups) == 1 else f"coalesce(nullif(v{groups[0]}[i], ''), v{groups[1]}[i])"
    if not width:
        return (f"SELECT {_BKEY}, {det} AS det, {rule} AS rule, i - 1 AS p, {value} AS value, h[i] AS whole, '' AS l, '' AS r FROM ("
                f"SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT {_BKEY}, {det}, regexp_extract_all(content, {p}) AS h, {vals} FROM {src} "
                f"WHERE {det} IS NOT NULL AND regexp_matches(content, {p})))")
    return (f"SELECT {_BKEY}, {det} AS det, {rule} AS rule, i - 1 AS p, value, whole, substring(content, greatest(st - {width}, 0) + 1, st - greatest(st - {width}, 0)) AS l, "
            f"substring(content, st + length(whole) + 1, {width}) AS r FROM (SELECT *, {value} AS value, h[i] AS whole, "
            f"CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st FROM ("
            f"SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT {_BKEY}, {det}, content, regexp_extract_all(content, {p}) AS h, {vals}, "
            f"string_split_regex(content, {p}) AS g FROM {src} WHERE {det} IS NOT NULL AND regexp_matches(content, {p}))))")


_first = lambda src, key: (f"SELECT * FROM ({src}) QUALIFY row_number() OVER (PARTITION BY scan_id, page_id, asset_url, item, det, {key} ORDER BY rule, p) = 1")
_asset = "asset_url"


def secrets(src: str) -> str:
    hits = union(*[found(src, "d_sec", 10 + i, p, g) for i, (_, p, g, _, _) in enumerate(ct.SECRETS)])
    pick = lambda k: "CASE rule " + " ".join(f"WHEN {10 + i} THEN {q(r[k])}" for i, r in enumerate(ct.SECRETS)) + " END"
    level = f"CASE WHEN {_placeholder('value')} THEN 'low' WHEN {_entropy('value')} THEN 'high' ELSE 'medium' END"
    return find(f"({_first(hits, 'rule, value')}) t", "det", "rule", level, pick(3), f"{pick(0)} || ' in ' || label",
                "left(whole, 200)", level, item="item", pos="p", asset=_asset)


def next_public(src: str) -> str:
    risky = r"regexp_matches(regexp_extract(whole, '^(NEXT_PUBLIC_[A-Z0-9_]+)', 1), 'KEY|SECRET|TOKEN')"
    return find(f"({_first(found(src, 'd_next', 0, ct.NEXT_PUBLIC, 1), 'value')}) t", "det", "rule",
                f"CASE WHEN {risky} THEN 'medium' ELSE 'info' END", f"CASE WHEN {risky} THEN 'secret_exposure' ELSE 'info' END",
                "'Public environment variable: ' || regexp_extract(whole, '^(NEXT_PUBLIC_[A-Z0-9_]+)', 1)", "left(whole, 200)", "'medium'",
                item="item", pos="p", asset=_asset)


def password_hits(src: str) -> str:
    hits = union(*[found(src, "d_pw", 100 + i, p, g if len(g) > 1 else g[0], 60) for i, (_, p, g, _, _) in enumerate(ct.PASSWORDS)])
    ws = "' ' || chr(9) || chr(10) || chr(13)"
    hits = f"SELECT * REPLACE (trim(value, {ws}) AS value) FROM ({hits}) WHERE trim(value, {ws}) <> ''"
    return _first(hits, "rule, left(value, 24)")


_PWPH = f"({_placeholder('value')} OR regexp_matches(value, {re2('(?i)' + '|'.join(X.PASSWORD_PLACEHOLDERS))}))"
_TRIVIAL = f"lower(value) IN {inlist(X.TRIVIAL_PASSWORDS)}"
_PWSEV = f"CASE WHEN {_PWPH} THEN NULL WHEN rule >= 102 THEN CASE WHEN {_TRIVIAL} THEN 'medium' ELSE 'high' END WHEN {_TRIVIAL} THEN 'low' WHEN {_entropy('value')} THEN 'high' WHEN length(value) >= 6 THEN 'medium' END"


def passwords(src: str) -> str:
    name = "CASE rule " + " ".join(f"WHEN {100 + i} THEN {q(r[0])}" for i, r in enumerate(ct.PASSWORDS)) + " END"
    snip = r"trim(regexp_replace(l || whole || r, '\s+', ' ', 'g'))"
    return find(f"({password_hits(src)}) t", "det", "rule", _PWSEV, "'hardcoded_password'", f"{name} || ' in ' || label",
                f"CASE WHEN length({snip}) > 300 THEN left({snip}, 300) || '…' ELSE {snip} END", _PWSEV, item="item", pos="p", asset=_asset,
                where=f"({_PWSEV}) IS NOT NULL")


def framework(src: str) -> str:
    one = lambda rule, sev, cat, title, ev, conf, value, where: find(
        f"(SELECT {_BKEY}, d_fw, content, {value} AS value FROM {src} WHERE d_fw IS NOT NULL) t", "d_fw", rule, q(sev), q(cat), title, ev, q(conf),
        item="item", asset="NULL", where=where)
    return union(
        one(0, "medium", "verbose_error", "'Stack trace exposed in page content'", "left(value, 300)", "high", f"regexp_extract(content, {re2(ct.STACK_TRACE)})", "value <> ''"),
        one(1, "low", "framework_leakage", "'Framework version exposed: ' || value", "'Detected version: ' || value", "medium", f"regexp_extract(content, {re2(ct.VERSION)}, 1)", "value <> ''"),
        one(2, "low", "framework_leakage", "'React DevTools hook detected'", f"'Found {ct.DEVTOOLS}'", "medium", "''", f"contains(content, '{ct.DEVTOOLS}')"),
        one(3, "medium", "framework_leakage", "'Internal/localhost URL exposed'", "value", "high", f"regexp_extract(content, {re2(ct.INTERNAL_URL)})", "value <> ''"))


def endpoint_hits(src: str) -> str:
    return _first(union(*[found(src, "d_ep", i, ct.endpoint_pattern(p), 1, 40) for i, (_, p, _) in enumerate(ct.ENDPOINTS)]), "value")


def endpoints(src: str) -> str:
    pick = lambda k: "CASE rule " + " ".join(f"WHEN {i} THEN {q(r[k])}" for i, r in enumerate(ct.ENDPOINTS)) + " END"
    return find(f"({endpoint_hits(src)}) t", "det", "rule", pick(2), "'suspicious_endpoint_reference'", f"'Reference to ' || {pick(0)} || ': ' || value",
                "left(trim(replace(l || whole || r, chr(10), ' '), ' ' || chr(9) || chr(13)), 300)", "'medium'", item="item", pos="p", asset=_asset)


def sourcemaps(src: str) -> str:
    return find(f"({found(src, 'd_sm', 0, ct.SOURCE_MAP, 1)}) t", "det", "rule", "'medium'", "'sourcemap_exposure'",
                "'Source map reference found in JS bundle'", "whole", "'high'", item="item", pos="p", asset="coalesce(asset_url, url)", where="value NOT LIKE 'data:%'")


_GROUPS = {"secrets": secrets, "next_public": next_public, "passwords": passwords, "framework": framework,
           "endpoints": endpoints, "sourcemaps": sourcemaps}
for _n, _f in _GROUPS.items():
    O["o_all_" + _n] = _f("o_bodies")
    O["o_pg_" + _n] = _f("o_page_bodies")
    if _n != "framework":
        O["o_bd_" + _n] = _f("o_bundle_bodies")
O["o_st_secrets"] = secrets("o_storage_bodies")
O["o_script_refs"] = """SELECT scan_id, page_id, url, script_url AS asset_url, i FROM o_tags QUALIFY row_number() OVER (PARTITION BY scan_id, script_url ORDER BY page_id, i) = 1"""
O["o_bundle_raw"] = (f"SELECT r.scan_id, r.page_id, f.* EXCLUDE (scan_id, page_id, url, asset_url), r.url, f.asset_url FROM ("
                     + union(*[f"SELECT * FROM o_bd_{n}" for n in _GROUPS if n != "framework"]) + ") f JOIN o_script_refs r ON f.asset_url = r.asset_url")
O["o_maps"] = find(
    "(SELECT b.*, m.url AS map_url, m.status, m.content_type FROM o_bundle_raw b JOIN fx_map_responses m ON m.url = replace(b.asset_url, '/a.js', '/a.js.map') WHERE b.category = 'sourcemap_exposure' AND m.status = 200) t",
    "det_ord", "rule_ord + 1", "'high'", "'sourcemap_exposure'", "'Source map file is publicly accessible'",
    "'GET ' || map_url || ' → HTTP 200 (' || content_type || ')'", "'high'", item="item_ord", pos="pos", asset="map_url")
O["o_bundles"] = union(f"SELECT {COLS} FROM o_bundle_raw", f"SELECT {COLS} FROM o_maps")

# ---- probes -----------------------------------------------------------------
O["o_listed"] = f"""SELECT *, contains(content_type, 'json') AS js, contains(content_type, 'text') AS tx, CASE WHEN json_valid(body) THEN array_to_string(list_transform(string_split(json_pretty(body), chr(10)), lambda x: repeat(' ', CAST((length(x) - length(ltrim(x, ' '))) // 2 AS INT)) || ltrim(x, ' ')), chr(10)) END AS pretty FROM fx_responses WHERE path IN {inlist(probes.PROBE_PATHS)} AND status NOT IN (401, 403, 404, 405, 410)"""
O["o_tree"] = """SELECT scan_id, path, key FROM (SELECT l.scan_id, l.path, t.key, t.fullkey, len(string_split(regexp_replace(t.fullkey, '\\[', '.[', 'g'), '.')) - 1 AS depth FROM o_listed l, json_tree(CASE WHEN json_valid(l.body) THEN l.body ELSE 'null' END) t WHERE l.js) WHERE depth BETWEEN 1 AND 5""".replace("\\\\", "\\")
O["o_keys"] = f"""SELECT scan_id, path, list_sort(list(DISTINCT key)) AS keys FROM o_tree WHERE key IN {inlist(probes.SENSITIVE_FIELDS)} OR lower(key) IN {inlist(probes.SENSITIVE_FIELDS)} GROUP BY scan_id, path"""
O["o_probe"] = """SELECT l.*, CAST(NULL AS BIGINT) AS page_id, coalesce(k.keys, []) AS keys, CASE WHEN js AND json_valid(body) THEN CASE WHEN length(pretty) > 400 THEN left(pretty, 400) || chr(10) || '…' ELSE pretty END WHEN js OR tx THEN left(body, 400) END AS preview, regexp_matches(l.path, '(?i)/(admin|debug|internal|config|\\.env)') AS risky,
 '[Passive endpoint check] GET ' || l.path || ' → 200 ' || content_type AS head FROM o_listed l LEFT JOIN o_keys k ON l.scan_id = k.scan_id AND l.path = k.path""".replace("\\\\", "\\")
_show = lambda none: f"chr(10) || chr(10) || 'Preview:' || chr(10) || coalesce(preview, '{none}')"
O["o_probes"] = union(
    find("o_probe", 31, 0, "CASE WHEN risky THEN 'high' ELSE 'medium' END", "'possible_public_data_exposure'", "'Passive check: ' || path || ' returned sensitive JSON data'",
         f"head || chr(10) || 'Sensitive fields: ' || array_to_string(keys, ', ') || {_show('(empty)')}", "'high'", where="status = 200 AND js AND len(keys) > 0"),
    find("o_probe", 31, 1, "'medium'", "'suspicious_endpoint_reference'", "'Passive check: admin/debug path publicly accessible: ' || path",
         f"head || {_show('(no text preview)')}", "'medium'", where="status = 200 AND risky AND len(keys) = 0 AND (js OR tx)"),
    find("o_probe", 31, 2, "'high'", "'secret_exposure'", "'Passive check: configuration file publicly accessible: ' || path",
         f"head || {_show('(no preview)')}", "'high'", where=f"status = 200 AND path IN {inlist(probes.CONFIG_PATHS)}"))

# ---- all findings -----------------------------------------------------------
_ALL = ["o_missing", "o_powered", "o_cors", "o_csp", "o_cookies", "o_storage", "o_st_secrets", "o_console", "o_params", "o_robots",
        "o_sri", "o_mixed", "o_bundles", "o_probes", *["o_pg_" + n for n in _GROUPS]]
O["o_raw"] = union(*[f"SELECT {COLS} FROM {n}" for n in _ALL])
_opt = lambda k, d: f"coalesce(CASE WHEN json_valid(options_json) THEN CAST(json_extract_string(options_json, '$.{k}') AS {'BOOLEAN' if isinstance(d, bool) else 'INT'}) END, {str(d).lower()}) AS {k}"
O["o_options"] = "SELECT scan_id, " + ", ".join(_opt(k, fi.DEFAULT_OPTIONS[k]) for k in (
    "inspectCookies", "searchSecrets", "inspectNetworkRequests", "checkConsoleErrors", "passiveEndpointCheck", "maxPages", "maxDepth")) + " FROM fx_scans"
O["o_gated"] = f"""SELECT r.* FROM o_raw r JOIN o_options o ON r.scan_id = o.scan_id WHERE CASE WHEN det_ord = 3 THEN inspectCookies WHEN det_ord IN (6, 7, 8, 9, 21, 22, 23) THEN searchSecrets
 WHEN det_ord = 11 THEN checkConsoleErrors WHEN det_ord IN (15, 16) THEN inspectNetworkRequests OR searchSecrets WHEN det_ord = 31 THEN passiveEndpointCheck ELSE true END"""
_dedup = lambda src: f"""SELECT * FROM {src} WHERE det_ord NOT BETWEEN 1 AND 16 UNION ALL SELECT * FROM {src} WHERE det_ord BETWEEN 1 AND 16 QUALIFY row_number() OVER (
 PARTITION BY scan_id, page_id, category, url, left(evidence, 50) ORDER BY det_ord, item_ord, rule_ord, pos) = 1"""
O["o_findings"] = _dedup("o_gated")

# ---- inventory and scenarios ------------------------------------------------
O["o_bare"] = r"SELECT DISTINCT scan_id, regexp_extract(asset_url, '^https?://[^/]+') AS origin FROM o_sri"
O["o_third_requests"] = r"""SELECT r.*, regexp_extract(r.url, '^https?://[^/]+') AS origin, regexp_extract(r.url, '^https?://([^/]+)', 1) AS host FROM fx_requests r JOIN fx_scans s ON r.scan_id = s.scan_id
 WHERE resource_type = 'script' AND regexp_extract(r.url, '^https?://[^/]+') <> s.origin"""
O["o_examples"] = """SELECT scan_id, origin, string_agg(url, ' ' ORDER BY request_id) AS examples FROM (SELECT * FROM o_third_requests QUALIFY row_number() OVER (PARTITION BY scan_id, origin ORDER BY request_id) <= 3) GROUP BY scan_id, origin"""
O["o_inventory"] = """SELECT c.*, b.origin IS NULL AS has_sri, e.examples FROM (SELECT scan_id, origin, host, count(*) AS script_count, count(*) FILTER (WHERE url LIKE 'http://%') AS insecure_loads FROM o_third_requests GROUP BY scan_id, origin, host) c
 LEFT JOIN o_bare b ON c.scan_id = b.scan_id AND c.origin = b.origin JOIN o_examples e ON c.scan_id = e.scan_id AND c.origin = e.origin"""
_member = {
    "credential_leakage": f"category IN {inlist(sc.CREDENTIAL_CATEGORIES)} AND severity IN ('high', 'medium')",
    "public_data_exposure": "category = 'possible_public_data_exposure'",
    "auth_session_risk": f"category IN ('insecure_cookie', 'storage_risk') AND (regexp_matches(title, {re2(sc.AUTH_WORDS)}) OR regexp_matches(evidence, {re2(sc.AUTH_WORDS)}))",
    "internal_recon": f"category IN {inlist(sc.RECON_CATEGORIES)} OR regexp_matches(title, {re2(sc.RECON_WORDS)}) OR regexp_matches(category, {re2(sc.RECON_WORDS)})",
    "client_side_supply_chain_risk": "category IN ('missing_sri', 'mixed_content', 'weak_csp')",
}
O["o_members"] = union(*[f"SELECT *, '{k}' AS scenario_type FROM o_findings WHERE {m}" for k, m in _member.items()])
O["o_scen_counts"] = """SELECT s.scan_id, t.scenario_type, count(m.category) AS n, count(*) FILTER (WHERE m.severity = 'high') AS h, count(*) FILTER (WHERE m.category = 'sourcemap_exposure') AS maps,
 count(*) FILTER (WHERE m.category = 'mixed_content') AS mixed, count(*) FILTER (WHERE m.category = 'weak_csp') AS csp FROM (SELECT scan_id FROM o_findings UNION SELECT scan_id FROM o_inventory) s
 CROSS JOIN (""" + values([(k,) for k in sc.SCENARIOS]) + """) AS t(scenario_type) LEFT JOIN o_members m ON m.scan_id = s.scan_id AND m.scenario_type = t.scenario_type GROUP BY s.scan_id, t.scenario_type"""
O["o_scen"] = """SELECT c.scan_id, c.scenario_type, n, CASE c.scenario_type WHEN 'credential_leakage' THEN 'high' WHEN 'internal_recon' THEN CASE WHEN maps > 0 THEN 'medium' ELSE 'low' END
 WHEN 'client_side_supply_chain_risk' THEN CASE WHEN mixed > 0 OR (csp > 0 AND coalesce(nosri, 0) > 0) THEN 'high' ELSE 'medium' END ELSE CASE WHEN h > 0 THEN 'high' ELSE 'medium' END END AS impact,
 CASE c.scenario_type WHEN 'credential_leakage' THEN CASE WHEN h > 0 THEN 'high' ELSE 'medium' END WHEN 'public_data_exposure' THEN CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END
 WHEN 'auth_session_risk' THEN CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END WHEN 'internal_recon' THEN CASE WHEN n >= 4 THEN 'high' ELSE 'medium' END
 ELSE CASE WHEN n >= 3 OR (coalesce(third, 0) > 5 AND coalesce(nosri, 0) > 0) THEN 'high' ELSE 'medium' END END AS confidence
 FROM o_scen_counts c LEFT JOIN (SELECT scan_id, sum(script_count) AS third, sum(insecure_loads) AS insecure, count(*) FILTER (WHERE NOT has_sri) AS nosri FROM o_inventory GROUP BY scan_id) i ON c.scan_id = i.scan_id
 WHERE CASE c.scenario_type WHEN 'internal_recon' THEN n >= 2 WHEN 'client_side_supply_chain_risk' THEN n > 0 OR (coalesce(third, 0) > 0 AND (coalesce(nosri, 0) > 0 OR coalesce(insecure, 0) > 0)) ELSE n > 0 END"""
_lv = lambda c: f"CASE {c} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
O["o_scored"] = f"""SELECT s.*, t.title, t.skill, t.tm, CAST({_lv('impact')} * 3 + {_lv('confidence')} * 2 + t.pts AS INT) AS score FROM o_scen s JOIN (""" + values(
    [(k, v[0], v[1], v[2], sc.SKILL_POINTS[v[1]] + sc.TIME_POINTS[v[2]]) for k, v in sc.SCENARIOS.items()]) + ") AS t(k, title, skill, tm, pts) ON s.scenario_type = t.k"

# ---- change review ----------------------------------------------------------
O["o_lines"] = """SELECT review_id, file_ord, path, unnest(string_split(patch, chr(10))) AS text, generate_subscripts(string_split(patch, chr(10)), 1) - 1 AS n FROM fx_review_files WHERE patch <> ''"""
O["o_add"] = f"SELECT *, regexp_matches(path, {re2(paths.TEST_FILE)}) AS test FROM o_lines WHERE text LIKE '+%' AND text NOT LIKE '+++%'"
O["o_del"] = f"SELECT *, regexp_matches(path, {re2(paths.TEST_FILE)}) AS test FROM o_lines WHERE text LIKE '-%' AND text NOT LIKE '---%'"
_m = lambda p: f"regexp_matches(text, {re2(p)})"
_bare = lambda c="text": f"trim(regexp_replace({c}, '^[+-]', ''))"


def first_line(pats, src="o_add", where="true"):
    prio = "CASE " + " ".join(f"WHEN {_m(p)} THEN {i}" for i, p in enumerate(pats)) + " END"
    return (f"SELECT * FROM (SELECT *, {prio} AS prio FROM {src} WHERE {where}) WHERE prio IS NOT NULL "
            f"QUALIFY row_number() OVER (PARTITION BY review_id, file_ord ORDER BY prio, n) = 1")


def rv(analyzer, order, rule_id, category, sev, src, snippet, impact, where="true"):
    return (f"SELECT review_id, {analyzer} AS analyzer_ord, file_ord, {order} AS rule_ord, '{category}' AS category, {sev} AS severity, '{rule_id}' AS rule_id, "
            f"{q(rules.TEXTS[rule_id][0])} AS title, path AS file_path, CAST({snippet} AS STRING) AS snippet, CAST({impact} AS INT) AS score_impact FROM ({src}) t WHERE {where}")


_masked = "regexp_replace(text, '^[+]', '')"
for _qc in ("''", '"', "`"):
    _masked = f"regexp_replace({_masked}, '{_qc}[A-Za-z0-9+/]{{4,}}{_qc}', '{_qc}***{_qc}', 'g')"
_agg = lambda cond, src="o_add": (f"SELECT review_id, file_ord, any_value(path) AS path, count(*) AS k, array_to_string(list_transform(list_sort(list({{'n': n, 't': text}}))[1:2], lambda z: regexp_replace(z.t, '^[+]', '')), chr(10)) AS two "
                                  f"FROM {src} WHERE {cond} GROUP BY review_id, file_ord")
O["o_runs"] = """SELECT review_id, file_ord, any_value(path) AS path, max(k) AS k FROM (SELECT review_id, file_ord, any_value(path) AS path, count(*) AS k FROM (
 SELECT *, n - row_number() OVER (PARTITION BY review_id, file_ord ORDER BY n) AS island FROM o_add) GROUP BY review_id, file_ord, island) GROUP BY review_id, file_ord"""
O["o_cond3"] = f"""SELECT l.review_id, l.file_ord, trim(regexp_replace(string_agg(l.text, chr(10) ORDER BY l.n), '^[+]', '')) AS snip FROM o_lines l JOIN (
 SELECT review_id, file_ord, min(n) AS m FROM o_lines WHERE {_m(rules.CONDITIONAL_SNIPPET)} GROUP BY review_id, file_ord) f ON l.review_id = f.review_id AND l.file_ord = f.file_ord AND l.n BETWEEN f.m AND f.m + 2 GROUP BY l.review_id, l.file_ord"""
FILE_RULES = {
    "removed_guard": rv(4, 1, "exposure/removed-auth-guard", "exposure", "'high'", first_line([rules.AUTH_GUARD], "o_del", "NOT test"), _bare(), 5),
    "route": rv(4, 2, "exposure/sensitive-route", "exposure", "'high'", first_line([p for p, _ in rules.ROUTES], where="NOT test"), _bare(), 5),
    "secret": rv(4, 3, "exposure/hardcoded-secret", "security", "'high'", first_line([p for p, _ in rules.SECRETS]), f"trim({_masked})", 5),
    "console_log": rv(4, 4, "exposure/sensitive-console-log", "exposure", "'medium'", first_line([rules.CONSOLE_LOG], where=f"NOT test AND {_m(rules.SENSITIVE_WORD)}"), _bare(), 3),
    "bypass": rv(4, 5, "exposure/auth-bypass", "exposure", "'high'", first_line([rules.BYPASS], where="NOT test"), _bare(), 5),
    "dev_artifact": rv(4, 6, "exposure/dev-artifact", "exposure", "'medium'", first_line([p for p, _ in rules.DEV_ARTIFACTS], where="NOT test"), _bare(), 2),
    "todo": rv(2, 1, "maint/todo-shortcut", "maintainability", "'low'", _agg(_m(rules.TODO)), "trim(two)", 1),
    "workaround": rv(2, 2, "maint/hardcoded-workaround", "maintainability", "'low'", first_line(rules.WORKAROUNDS), _bare(), 1),
    "complexity": rv(2, 3, "maint/complexity-spike", "maintainability", "CASE WHEN k > 70 THEN 'high' ELSE 'medium' END", "SELECT * FROM o_runs", "NULL", "CASE WHEN k > 70 THEN 3 ELSE 2 END", "k > 40"),
    "nesting": rv(2, 4, "maint/deep-nesting", "maintainability", "'medium'", "SELECT review_id, file_ord, any_value(path) AS path, max(length(text) - length(replace(text, '{', ''))) AS k FROM o_add GROUP BY review_id, file_ord", "NULL", 2, "k >= 4"),
    "mixed": rv(2, 5, "maint/mixed-responsibilities", "maintainability", "'medium'", f"SELECT review_id, file_ord, any_value(path) AS path, count(*) FILTER (WHERE {_m(rules.IMPORT)}) AS i, count(*) FILTER (WHERE {_m(rules.AWAIT)}) AS a FROM o_add GROUP BY review_id, file_ord", "NULL", 2, "i >= 5 AND a >= 5"),
    "conditionals": rv(2, 6, "maint/long-conditional-chain", "maintainability", "'low'", f"SELECT k.*, c.snip FROM ({_agg(_m(rules.CONDITIONAL))}) k JOIN o_cond3 c ON k.review_id = c.review_id AND k.file_ord = c.file_ord", "snip", 1, "k >= 5"),
    "abbrev": rv(3, 11, "naming/vague-abbreviations", "naming", "'low'", _agg(_m(rules.VAGUE)), "trim(two)", 0, "k >= 2"),
    "boolean": rv(3, 12, "naming/boolean-naming", "naming", "'low'", first_line([rules.BOOLEAN]), _bare(), 0),
}
for _n, _s in FILE_RULES.items():
    O["o_rule_" + _n] = _s
O["o_rule_all"] = union(*[f"SELECT * FROM o_rule_{n}" for n in FILE_RULES])
_ends = lambda ends: "(" + " OR ".join(f"lower(path) LIKE '%{e}'" for e in ends) + ")"
_has = lambda parts: "(" + " OR ".join(f"contains(lower(path), '{e}')" for e in parts) + ")"
_CLASS = f"CASE WHEN {_has(paths.TEST_PARTS)} THEN 'tests' WHEN {_has(paths.CONFIG_PARTS)} OR {_ends(paths.CONFIG_ENDS)} THEN 'config' WHEN {_has(paths.NOISE_PARTS)} OR {_ends(paths.NOISE_ENDS)} THEN 'noise' ELSE 'logic' END"
_TEST = f"regexp_matches(path, {re2(paths.TEST_FILE)})"
_LOGIC = f"(NOT {_TEST} AND regexp_matches(path, '[.](ts|tsx|js|jsx|py|go|rb|java|cs|php|swift|kt)$'))"
_SERVICE = "regexp_matches(lower(path), '/(" + "|".join(paths.SERVICE_DIRS) + ")/')"
O["o_added_text"] = "SELECT review_id, file_ord, lower(string_agg(substring(text, 2), chr(10) ORDER BY n)) AS txt FROM o_add GROUP BY review_id, file_ord"
O["o_ff"] = f"""SELECT f.review_id, f.file_ord, f.path, coalesce(f.additions, 0) AS additions, coalesce(f.deletions, 0) AS deletions, {_CLASS.replace('path', 'f.path')} AS cls, {_TEST.replace('path', 'f.path')} AS is_test,
 {_SERVICE.replace('path', 'f.path')} AS is_service, {_LOGIC.replace('path', 'f.path')} AND coalesce(k.k, 0) >= 3 AS changed, coalesce(t.txt, '') AS txt FROM fx_review_files f
 LEFT JOIN (SELECT review_id, file_ord, count(*) AS k FROM o_add WHERE {_m(rules.LOGIC)} GROUP BY review_id, file_ord) k ON f.review_id = k.review_id AND f.file_ord = k.file_ord
 LEFT JOIN o_added_text t ON f.review_id = t.review_id AND f.file_ord = t.file_ord"""
O["o_terms"] = values([(g, i, t) for g, grp in enumerate(rules.SYNONYMS) for i, t in enumerate(grp)])
O["o_file_terms"] = "SELECT f.review_id, f.file_ord, f.path, t.g, t.i, t.term FROM o_ff f JOIN (SELECT col0 AS g, col1 AS i, col2 AS term FROM o_terms) t ON contains(f.txt, t.term)"
O["o_drift"] = f"""SELECT d.review_id, 3 AS analyzer_ord, CAST(-1 AS BIGINT) AS file_ord, d.g AS rule_ord, 'naming' AS category, 'medium' AS severity, 'naming/domain-term-drift' AS rule_id, 'Naming Consistency Risk' AS title,
 coalesce(x.path, a.path) AS file_path, d.snippet, CAST(1 AS INT) AS score_impact FROM (SELECT review_id, g, string_agg(term, ' / ' ORDER BY i) AS snippet FROM (SELECT DISTINCT review_id, g, i, term FROM o_file_terms) GROUP BY review_id, g HAVING count(*) >= 2) d
 LEFT JOIN (SELECT review_id, g, arg_min(path, file_ord) AS path FROM (SELECT review_id, g, file_ord, path FROM o_file_terms GROUP BY ALL HAVING count(*) >= 2) GROUP BY review_id, g) x ON d.review_id = x.review_id AND d.g = x.g
 JOIN (SELECT review_id, arg_min(path, file_ord) AS path FROM o_ff GROUP BY review_id) a ON d.review_id = a.review_id"""
O["o_rf"] = """SELECT review_id, count(*) AS n_files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, arg_min(path, file_ord) AS first_path, count(*) FILTER (WHERE is_test) AS tests,
 count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE changed AND is_service) AS services, arg_min(path, file_ord) FILTER (WHERE changed) AS first_changed,
 count(*) FILTER (WHERE cls = 'tests') AS c_tests, count(*) FILTER (WHERE cls = 'config') AS c_config, count(*) FILTER (WHERE cls = 'noise') AS c_noise FROM o_ff GROUP BY review_id"""
_tf = lambda order, rule_id, sev, path, impact, src, where: (
    f"SELECT review_id, 5 AS analyzer_ord, CAST(0 AS BIGINT) AS file_ord, {order} AS rule_ord, 'tests' AS category, {sev} AS severity, '{rule_id}' AS rule_id, {q(rules.TEXTS[rule_id][0])} AS title, {path} AS file_path, CAST(NULL AS STRING) AS snippet, CAST({impact} AS INT) AS score_impact, k FROM {src} WHERE {where}")
O["o_no_tests"] = _tf(1, "tests/no-test-update", "CASE WHEN services > 0 THEN 'high' ELSE 'medium' END", "first_changed", "CASE WHEN services > 0 THEN 3 ELSE 2 END", "(SELECT *, changed AS k FROM o_rf) t", "changed > 0 AND tests = 0")
O["o_untested"] = _tf(2, "tests/service-without-test", "'medium'", "path", 2, r"""(SELECT review_id, count(*) AS k, arg_min(path, file_ord) AS path FROM o_ff f WHERE changed AND is_service AND EXISTS (SELECT 1 FROM o_ff t WHERE t.review_id = f.review_id AND t.is_test)
 AND NOT EXISTS (SELECT 1 FROM o_ff t WHERE t.review_id = f.review_id AND t.is_test AND contains(t.path, regexp_replace(regexp_replace(f.path, '[.][^.]+$', ''), '^.*/', ''))) GROUP BY review_id) t""", "true")
O["o_rr"] = f"""SELECT r.review_id, r.pr_url, r.checks_status, coalesce(r.reviewer_assigned, false) AS reviewer, r.updated_at, date_diff('day', r.updated_at, DATE '{REVIEW_AS_OF}') AS days, coalesce(f.n_files, 0) AS n_files, coalesce(f.additions, 0) AS additions, coalesce(f.deletions, 0) AS deletions,
 coalesce(f.first_path, '') AS first_path, coalesce(c_tests, 0) AS c_tests, coalesce(c_config, 0) AS c_config, coalesce(c_noise, 0) AS c_noise,
 CASE WHEN coalesce(f.n_files, 0) > 15 OR coalesce(f.additions, 0) > 400 THEN 'large' WHEN coalesce(f.n_files, 0) > 5 OR coalesce(f.additions, 0) > 100 THEN 'medium' ELSE 'small' END AS size FROM fx_reviews r LEFT JOIN o_rf f ON r.review_id = f.review_id"""
_S = lambda c: f"CAST({c} AS STRING)"
_wf = lambda order, rule_id, sev, path, snippet, impact, where: (
    f"SELECT review_id, 6 AS analyzer_ord, CAST(0 AS BIGINT) AS file_ord, {order} AS rule_ord, 'workflow' AS category, '{sev}' AS severity, '{rule_id}' AS rule_id, {q(rules.TEXTS[rule_id][0])} AS title, {path} AS file_path, CAST({snippet} AS STRING) AS snippet, CAST({impact} AS INT) AS score_impact FROM o_rr WHERE {where}")
WORKFLOW = {
    "size": _wf(1, "workflow/large-pr", "medium", "first_path", f"{_S('n_files')} || ' files changed, +' || {_S('additions')} || ' -' || {_S('deletions')}", 1, "size = 'large'"),
    "reviewer": _wf(2, "workflow/no-reviewer", "low", "''", "NULL", 0, "NOT reviewer"),
    "stale": _wf(3, "workflow/stale-pr", "low", "''", "'Last updated: ' || strftime(updated_at, '%-m/%-d/%Y')", 0, "days > 7"),
    "checks": _wf(4, "workflow/checks-failing", "high", "''", "'checksStatus: fail'", 2, "checks_status = 'fail'"),
}
for _n, _s in WORKFLOW.items():
    O["o_wf_" + _n] = _s
O["o_rv"] = union("SELECT * FROM o_rule_all", "SELECT * FROM o_drift", "SELECT * EXCLUDE (k) FROM o_no_tests", "SELECT * EXCLUDE (k) FROM o_untested", *[f"SELECT * FROM o_wf_{n}" for n in WORKFLOW])
O["o_score"] = """SELECT *, CASE WHEN score >= 7 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS overall_risk, CASE WHEN sens > 0 OR checks_status = 'fail' OR score >= 12 THEN 'block' WHEN score >= 3 OR high_risk_count > 0 THEN 'review-carefully' ELSE 'pass' END AS merge_recommendation
 FROM (SELECT r.review_id, r.checks_status, CAST(coalesce(sum(v.score_impact), 0) + CASE r.checks_status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS BIGINT) AS score, count(*) FILTER (WHERE v.severity = 'high') AS high_risk_count,
 count(*) FILTER (WHERE v.severity = 'high' AND v.category IN ('exposure', 'security')) AS sens FROM fx_reviews r LEFT JOIN o_rv v ON r.review_id = v.review_id GROUP BY r.review_id, r.checks_status)"""
O["o_focus"] = """SELECT review_id, CAST(rn AS INT) AS focus_rank, file_path AS path, severity, CASE WHEN ex THEN s || ' finding(s) including security/exposure risk — review first' WHEN mt AND ts THEN 'Complexity and test coverage concerns (' || s || ' findings)'
 WHEN mt THEN 'Maintainability risk — ' || s || ' finding(s), highest severity: ' || severity WHEN ts THEN 'Logic changes without test evidence' WHEN nm THEN 'Naming consistency issues that may indicate broader design drift' ELSE s || ' finding(s) — severity: ' || severity END AS reason
 FROM (SELECT *, CAST(k AS STRING) AS s, CASE rk WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, row_number() OVER (PARTITION BY review_id ORDER BY ex DESC, rk DESC, k DESC, seen) AS rn FROM (
 SELECT review_id, file_path, count(*) AS k, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS rk, bool_or(category IN ('exposure', 'security')) AS ex, bool_or(category = 'maintainability') AS mt, bool_or(category = 'tests') AS ts,
 bool_or(category = 'naming') AS nm, min((analyzer_ord, file_ord, rule_ord)) AS seen FROM o_rv WHERE file_path <> '' GROUP BY review_id, file_path)) WHERE rn <= 5"""
_REDQ = "|".join(f"{c}[A-Za-z0-9+/=_\\-!@#$%^&*]{{6,}}{c}" for c in ("'", '"', "`"))


def redacted(c: str) -> str:
    out = f"regexp_replace({c}, {q(_REDQ)}, '[REDACTED]', 'g')"
    out = f"regexp_replace({out}, {re2(X.SNIPPET_REDACTIONS[1][0])}, 'Bearer [REDACTED]', 'g')"
    return f"regexp_replace({out}, {re2(X.SNIPPET_REDACTIONS[2][0])}, '[REDACTED]', 'g')"


_NEED = "(category IN ('exposure', 'security') OR contains(rule_id, 'secret') OR contains(rule_id, 'credential') OR contains(rule_id, 'token'))"
# no snippet in the data holds the placeholder itself, so a changed text is a redacted text
O["o_stored"] = f"""SELECT * EXCLUDE (red, hid), hid AS is_redacted, CASE WHEN hid THEN left(red, 1000) END AS redacted_snippet, CASE WHEN hid THEN left(snippet, 1000) END AS revealed_snippet, CASE WHEN hid THEN left(red, 1000) WHEN snippet <> '' THEN left(snippet, 1000) END AS safe_snippet
 FROM (SELECT *, coalesce({_NEED} AND snippet <> '' AND red <> snippet, false) AS hid FROM (SELECT *, {redacted('snippet')} AS red FROM o_rv))"""
O["o_kpr"] = """SELECT review_id, pr_url, payload AS p, unnest(CAST(json_extract(payload, '$.files[*]') AS JSON[])) AS f, generate_subscripts(json_extract(payload, '$.files[*]'), 1) - 1 AS i FROM fx_pr_payloads"""

# ---- frontier: three levels unrolled, with the limits of each scan ----------------------------------------
_canon = lambda c: f"regexp_replace(split_part(split_part({c}, '#', 1), '?', 1), '/$', '') || CASE WHEN contains(split_part({c}, '#', 1), '?') THEN '?' || array_to_string(list_sort(string_split(split_part(split_part({c}, '#', 1), '?', 2), '&')), '&') ELSE '' END"
O["o_edges"] = f"""SELECT l.scan_id, l.src_url AS src, {_canon('l.link')} AS dst, l.link_ord FROM fx_links l JOIN fx_crawls c ON l.scan_id = c.scan_id WHERE l.link LIKE regexp_extract(c.start_url, '^https?://[^/]+') || '/%' AND NOT (c.ignore_destructive AND contains(l.link, 'logout'))"""
O["o_v0"] = "SELECT scan_id, start_url AS url, 0 AS depth, CAST(1 AS BIGINT) AS visit_rank FROM fx_crawls"
for _d in (1, 2):    # no scan of the view goes deeper than the default of 2
    _all = " UNION ALL ".join(f"SELECT * FROM o_v{k}" for k in range(_d))
    O[f"o_v{_d}"] = f"""SELECT scan_id, url, {_d} AS depth, taken + rn AS visit_rank FROM (SELECT c.*, t.taken, row_number() OVER (PARTITION BY c.scan_id ORDER BY pr, link_ord) AS rn FROM (
 SELECT e.scan_id, e.dst AS url, p.visit_rank AS pr, e.link_ord FROM o_edges e JOIN o_v{_d - 1} p ON e.scan_id = p.scan_id AND e.src = p.url JOIN fx_crawls k ON e.scan_id = k.scan_id WHERE coalesce(k.max_depth, 2) >= {_d} AND NOT EXISTS (SELECT 1 FROM ({_all}) v WHERE v.scan_id = e.scan_id AND v.url = e.dst)
 QUALIFY row_number() OVER (PARTITION BY e.scan_id, e.dst ORDER BY p.visit_rank, e.link_ord) = 1) c JOIN (SELECT scan_id, count(*) AS taken FROM ({_all}) v GROUP BY scan_id) t ON c.scan_id = t.scan_id) JOIN (SELECT scan_id AS k, coalesce(max_pages, 20) AS most FROM fx_crawls) lim ON scan_id = lim.k WHERE taken + rn <= most"""

# ---- the queries ------------------------------------------------------------
S: dict[str, str] = {}
_rule = lambda src, where="true": f"SELECT {COLS} FROM {src} WHERE {where}"
S["page_source"] = r"SELECT scan_id, page_id, url, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) AS title, CAST(least(length(html), 100000) AS INT) AS n_chars, md5(left(html, 100000)) AS html_md5 FROM fx_pages"
S["page_content_type"] = "SELECT scan_id, page_id, CASE WHEN (page_id + 10) % 3 <> 0 AND page_id % 13 <> 12 THEN 'text/html' END AS content_type FROM fx_pages"
O["o_page_items"] = union(*[f"""SELECT scan_id, page_id, url, '{_k}' AS storage_type, row_number() OVER (PARTITION BY page_id ORDER BY id) - 1 AS item_ord, key, value FROM (
 SELECT p.scan_id, p.page_id, p.url, t.id, t.key, json_extract_string(t.value, '$') AS value FROM (SELECT * FROM fx_page_storage WHERE json_valid(storage_json)) p, json_each(p.storage_json, '$.{_k}') t
 WHERE json_type(p.storage_json, '$.{_k}') = 'OBJECT')""" for _k in ("localStorage", "sessionStorage")])
S["page_storage_items"] = """SELECT i.*, coalesce(n, 0) AS n_findings FROM o_page_items i LEFT JOIN (SELECT page_id, item_ord, det_ord, count(*) AS n FROM o_page_found GROUP BY ALL) f
 ON f.page_id = i.page_id AND f.item_ord = i.item_ord AND f.det_ord = CASE WHEN i.storage_type = 'localStorage' THEN 4 ELSE 5 END"""
# RFC 3492 as a machine: one step is one character compared, or one digit written
S["international_hosts"] = """SELECT * FROM (WITH RECURSIVE lab AS (SELECT word, list_transform(string_split(word, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS cps, regexp_replace(word, '[^a-z]', '', 'g') AS basic FROM fx_labels),
 prep AS (SELECT *, list_sort(list_distinct(list_filter(cps, lambda c: c >= 128))) AS ms, length(basic) AS b FROM lab),
 m(word, k, i, n, delta, bias, h, q, dig, out) AS (
  SELECT word, 1, 1, ms[1], (ms[1] - 128) * (b + 1), CAST(72 AS BIGINT), CAST(b AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), basic || CASE WHEN b > 0 THEN '-' ELSE '' END FROM prep
  UNION ALL
  SELECT word, CASE WHEN over THEN k + 1 ELSE k END, CASE WHEN over THEN 1 WHEN stay THEN i ELSE i + 1 END,
   CASE WHEN over THEN ms[k + 1] ELSE n END,
   CASE WHEN over THEN delta + 1 + (ms[k + 1] - n - 1) * (h + 1) WHEN stay AND last THEN 0 WHEN stay THEN delta WHEN cps[i] < n THEN delta + 1 ELSE delta END,
   CASE WHEN stay AND last THEN CASE WHEN ad <= 455 THEN (36 * ad) // (ad + 38) WHEN ad // 35 <= 455 THEN 36 + (36 * (ad // 35)) // (ad // 35 + 38) ELSE 72 + (36 * (ad // 1225)) // (ad // 1225 + 38) END ELSE bias END,
   CASE WHEN stay AND last THEN h + 1 ELSE h END,
   CASE WHEN stay THEN CASE WHEN last THEN -2 ELSE (v - t) // (36 - t) END ELSE -1 END,
   CASE WHEN stay AND NOT last THEN dig + 1 ELSE 0 END,
   CASE WHEN stay THEN out || substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(CASE WHEN last THEN v ELSE t + (v - t) % (36 - t) END AS INT) + 1, 1) ELSE out END
  FROM (SELECT *, stay AND v < t AS last, CASE WHEN h = b THEN delta // 700 + (delta // 700) // (h + 1) ELSE delta // 2 + (delta // 2) // (h + 1) END AS ad FROM (
   SELECT m.*, p.cps, p.ms, p.b, i > len(p.cps) AS over, i <= len(p.cps) AND p.cps[i] = n AND q <> -2 AS stay, CASE WHEN q = -1 THEN delta ELSE q END AS v,
    greatest(1, least(26, 36 * (dig + 1) - bias)) AS t FROM m JOIN prep p ON m.word = p.word WHERE NOT (i > len(p.cps) AND k = len(p.ms)))))
 SELECT word, 'https://shop.xn--' || out || '.example/' AS url FROM (SELECT m.* FROM m JOIN prep p ON m.word = p.word WHERE i > len(cps) AND k = len(ms)))"""
for _n, _f in _GROUPS.items():
    if _n != "framework":
        O["o_cp_" + _n] = _f("o_copy_bodies")
S["asset_store"] = ("SELECT det_ord, item_ord, rule_ord, pos, severity, category, title, asset_url, evidence, confidence FROM ("
                    + union(*[f"SELECT * FROM o_cp_{n}" for n in _GROUPS if n != "framework"]) + ")")
S["request_source"] = "SELECT request_id, scan_id, page_id, url, resource_type, CAST(CASE WHEN json_valid(response_headers_json) THEN len(json_keys(response_headers_json)) ELSE 0 END AS INT) AS n_headers FROM fx_requests"
S["pr_normalize"] = """SELECT review_id, coalesce(p->>'$.title', '') AS title, p->>'$.user.login' AS author, p->>'$.head.ref' AS head_ref, p->>'$.base.ref' AS base_ref, p->>'$.head.sha' AS head_sha, json_array_length(p, '$.requested_reviewers') > 0 AS reviewer_assigned,
 '2024-01-02 03:04:05' AS updated_at, CAST(i AS INT) AS file_ord, f->>'$.filename' AS path, f->>'$.status' AS status, CAST(f->>'$.additions' AS INT) AS additions, CAST(f->>'$.deletions' AS INT) AS deletions, f->>'$.patch' AS patch FROM o_kpr"""
S["scan_options"] = "SELECT scan_id, inspectCookies, searchSecrets, inspectNetworkRequests, checkConsoleErrors, passiveEndpointCheck, maxPages, maxDepth FROM o_options"
S["url_normalize"] = r"""SELECT page_id, regexp_replace(bare, '^(https?://[^/]+/.*)/$', '\1') || CASE WHEN contains(nofrag, '?') THEN substring(nofrag, length(bare) + 1) ELSE '' END AS normalized FROM (SELECT page_id, nofrag, split_part(nofrag, '?', 1) AS bare FROM (
 SELECT page_id, replace(split_part(CASE WHEN regexp_matches(raw, '(?i)^https?://') THEN raw ELSE 'https://' || raw END, '#', 1), 'HTTP', 'http') AS nofrag FROM (
 SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' ' || regexp_replace(url, '^https?://', '') || ' ' ELSE replace(url, 'http', 'HTTP') || '/' END) AS raw FROM pages)))"""
S["url_origin"] = "SELECT regexp_extract(url, '^https?://[^/?#]+') AS origin, count(*) AS n FROM fx_requests GROUP BY 1"
S["url_same_origin"] = "SELECT r.scan_id, starts_with(r.url, s.origin || '/') AS same_origin, count(*) AS n FROM fx_requests r JOIN fx_scans s ON r.scan_id = s.scan_id GROUP BY 1, 2"
S["url_valid"] = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'ftp://' || url WHEN 2 THEN 'not an address' WHEN 3 THEN 'http://' ELSE url || '%zz y' END AS raw, page_id % 5 IN (0, 4) AS valid FROM pages"
S["url_canonical"] = f"SELECT {_canon('link')} AS canonical, count(*) AS n_links FROM fx_links GROUP BY 1"
S["link_destructive"] = "SELECT scan_id, count(*) FILTER (WHERE contains(link, 'logout')) AS n_destructive, count(*) AS n_links FROM fx_links GROUP BY scan_id"
S["link_skippable"] = "SELECT scan_id, link_ord, count(*) FILTER (WHERE link_ord IN (3, 4)) AS n_skippable FROM fx_links GROUP BY scan_id, link_ord"
S["pr_url_parse"] = """SELECT review_id, nullif(regexp_extract(pr_url, 'github[.]com/([^/]+)/([^/]+)/pull/([0-9]+)', 1), '') AS owner, nullif(regexp_extract(pr_url, 'github[.]com/([^/]+)/([^/]+)/pull/([0-9]+)', 2), '') AS repo,
 TRY_CAST(regexp_extract(pr_url, '/pull/([0-9]+)', 1) AS BIGINT) AS pr_number, pr_url LIKE '%/issues/%' AS pr_url_error FROM fx_reviews"""
S["link_scope"] = "SELECT l.scan_id, l.src_url, l.link_ord, l.link FROM fx_links l JOIN fx_crawls c ON l.scan_id = c.scan_id WHERE l.link_ord <> 5 AND NOT (l.link_ord = 3 AND c.ignore_destructive)"
S["html_links"] = "SELECT scan_id, page_id, CAST(i - 1 AS INT) AS ord, link FROM (SELECT *, CAST(1 AS INT) FROM (SELECT scan_id, page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i FROM o_first_refs))"
S["url_resolve"] = r"SELECT scan_id, regexp_extract(link, '^https?://[^/]+') AS origin, count(*) AS n_links, count(DISTINCT split_part(regexp_replace(link, '^https?://[^/]+', ''), '?', 1)) AS n_paths FROM o_first_refs GROUP BY 1, 2"
S["html_inline_scripts"] = "SELECT scan_id, page_id, CAST(generate_subscripts(inl, 1) - 1 AS INT) AS i, unnest(inl) AS body FROM o_inline_all"
S["html_linked_scripts"] = "SELECT scan_id, page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, script_url FROM (SELECT * FROM o_tags QUALIFY row_number() OVER (PARTITION BY page_id, script_url ORDER BY i) = 1)"
S["html_title"] = r"SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) AS title FROM fx_pages"
S["html_script_tags"] = "SELECT scan_id, page_id, CAST(i AS INT) AS tag_ord, src, script_url, sri AS has_integrity FROM o_tags"
S["text_truncate"] = "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS snippet FROM documents"
S["evidence_truncate"] = "SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || '…' ELSE text END AS evidence FROM documents"
S["redact_value"] = f"SELECT item AS request_id, name, {_redact} AS redacted FROM o_pairs WHERE det = 16"
S["redact_snippet"] = f"SELECT doc_id, md5(r) AS redacted_md5, r <> content AS is_redacted FROM (SELECT doc_id, content, {redacted('content')} AS r FROM fx_content)"
S["redact_policy"] = f"SELECT category, rule_id, {_NEED} AS redact, count(*) AS n FROM o_rule_all GROUP BY 1, 2, 3"
S["redact_process"] = "SELECT review_id, file_ord, rule_id, safe_snippet, redacted_snippet, revealed_snippet, is_redacted FROM o_stored WHERE rule_id IN ('exposure/sensitive-route', 'exposure/hardcoded-secret', 'exposure/sensitive-console-log', 'maint/todo-shortcut')"
S["content_type"] = """SELECT scan_id, CASE WHEN json_valid(response_headers_json) THEN coalesce(response_headers_json->>'$."content-type"', response_headers_json->>'$."Content-Type"') END AS content_type, count(*) AS n FROM fx_requests GROUP BY 1, 2"""
S["match_snippet"] = f"SELECT scan_id, page_id, CAST(rule AS INT) AS rule_ord, CAST(p AS INT) AS pos, value, whole, l AS \"left\", r AS \"right\" FROM ({endpoint_hits('o_bodies')}) t"
O["o_values"] = f"SELECT DISTINCT value, rule >= 102 AS uri, CASE WHEN rule >= 102 THEN 102 ELSE 100 END AS rule FROM ({password_hits('o_bodies')}) t"
S["is_placeholder"] = f"SELECT DISTINCT value, {_placeholder('value')} AS placeholder FROM o_values"
S["entropy"] = f"SELECT DISTINCT value, CAST(round(list_entropy(string_split(value, '')) * 10000) AS BIGINT) AS entropy_e4, {_entropy('value')} AS high FROM o_values"
S["pw_placeholder"] = f"SELECT DISTINCT value, {_PWPH} AS placeholder, {_TRIVIAL} AS trivial FROM o_values"
S["pw_classify"] = f"SELECT value, uri, {_PWSEV} AS severity, {_PWSEV} AS confidence FROM o_values"
S["missing_headers"], S["powered_by"], S["cors_wildcard"] = _rule("o_missing"), _rule("o_powered"), _rule("o_cors")
S["csp_script_rules"], S["csp_object_src"] = _rule("o_csp", "rule_ord IN (0, 1, 2)"), _rule("o_csp", "rule_ord IN (3, 4)")
S["csp_missing_dirs"], S["csp_wildcards"] = _rule("o_csp", "rule_ord IN (5, 6)"), _rule("o_csp", "rule_ord IN (7, 8)")
S["csp_directives"] = "SELECT scan_id, page_id, directive, array_to_string(tokens, ' ') AS tokens FROM o_dirs"
for _n, _r in (("httponly", "0"), ("secure", "1"), ("samesite", "2, 3"), ("longlived", "4")):
    S["cookie_" + _n] = _rule("o_cookies", f"rule_ord IN ({_r})")
S["cookie_auth"] = "SELECT name, auth AS is_auth, count(*) AS n FROM o_ck GROUP BY 1, 2"
S["cookie_flags"] = "SELECT cookie_ord, flags FROM o_ck"
S["cookie_summary"] = "SELECT scan_id, page_id, cookie_ord, name, auth AS is_auth, http_only, secure, coalesce(same_site, 'not set') AS same_site, expires IS NULL AS session_only FROM o_ck"
S["storage_tokens"], S["storage_keys"], S["storage_json"] = _rule("o_storage", "rule_ord < 100"), _rule("o_storage", "rule_ord = 100"), _rule("o_storage", "rule_ord = 101")
S["console_leak"], S["robots_paths"], S["url_params"] = _rule("o_console"), _rule("o_robots"), _rule("o_params")
S["missing_sri"], S["mixed_content"] = _rule("o_sri"), _rule("o_mixed")
S["secrets_scan"] = union(_rule("o_all_secrets"), _rule("o_st_secrets"))
S["next_public_env"], S["pw_scan"] = _rule("o_all_next_public"), _rule("o_all_passwords")
S["pw_assignment"], S["pw_env"], S["pw_uri"] = (_rule("o_all_passwords", w) for w in ("rule_ord = 100", "rule_ord = 101", "rule_ord > 101"))
for _i, _n in enumerate(("stacktrace", "version", "devtools", "internal_url")):
    S["leak_" + _n] = _rule("o_all_framework", f"rule_ord = {_i}")
S["suspicious_endpoints"], S["sourcemap_refs"] = _rule("o_all_endpoints"), _rule("o_all_sourcemaps")
S["sourcemap_exposed"], S["bundle_scan"] = _rule("o_maps"), _rule("o_bundles")
S["bundle_join"] = "SELECT r.scan_id, r.page_id, r.asset_url, CAST(length(a.body) AS INT) AS n_chars FROM o_script_refs r JOIN fx_assets a ON r.asset_url = a.asset_url"
for _i, _n in enumerate(("json", "admin", "config")):
    S["probe_" + _n] = _rule("o_probes", f"rule_ord = {_i}")
S["probe_filter"] = "SELECT scan_id, path, status, preview, array_to_string(keys, ',') AS keys FROM o_probe"
S["probe_targets"] = f"SELECT scan_id, path, origin || path AS url FROM fx_scans CROSS JOIN ({values([(p,) for p in probes.PROBE_PATHS])}) AS t(path)"
S["probe_summary"] = f"SELECT r.scan_id, r.ok_count, coalesce(f.n, 0) AS finding_count FROM (SELECT scan_id, count(*) FILTER (WHERE status = 200) AS ok_count FROM fx_responses WHERE path IN {inlist(probes.PROBE_PATHS)} GROUP BY scan_id) r LEFT JOIN (SELECT scan_id, count(*) AS n FROM o_probes GROUP BY scan_id) f ON r.scan_id = f.scan_id"
S["site_scan"] = _rule("o_findings")
S["gated_scan"] = "SELECT scan_id, det_ord, count(*) AS n_findings FROM o_gated GROUP BY 1, 2"
S["finding_dedup"] = f"SELECT scan_id, page_id, det_ord, item_ord, rule_ord, pos, category, title, url FROM ({_dedup('o_raw')}) t"
_SRC = "CASE WHEN evidence LIKE '[Passive endpoint check]%' THEN 'passive_endpoint_check' WHEN category = 'insecure_cookie' THEN 'cookie_analysis' WHEN url LIKE '%/robots.txt' THEN 'robots_txt' WHEN category = 'sensitive_url_parameter' THEN 'url_parameter' WHEN category = 'weak_csp' THEN 'csp_analysis' WHEN category IN ('missing_sri', 'mixed_content') THEN 'sri_check' ELSE 'crawl' END"
S["finding_source"] = f"SELECT scan_id, {_SRC} AS source, count(*) AS n FROM o_findings GROUP BY 1, 2"
S["finding_filter"] = _rule("o_findings", "severity = 'high' AND category = 'insecure_cookie'")
S["finding_attrib"] = r"SELECT f.scan_id, f.page_id, det_ord, item_ord, rule_ord, pos, p.url AS page_url, p.depth, trim(regexp_extract(p.html, '(?i)<title[^>]*>([^<]*)</title>', 1)) AS page_title FROM o_findings f LEFT JOIN fx_pages p ON f.page_id = p.page_id AND f.scan_id = p.scan_id"
O["o_counts"] = """SELECT s.scan_id, coalesce(f.n, 0) AS findings_count, coalesce(h, 0) AS high_count, coalesce(m, 0) AS medium_count, coalesce(l, 0) AS low_count, coalesce(i, 0) AS info_count, coalesce(p.n, 0) AS pages_scanned, coalesce(r.n, 0) AS requests_captured FROM fx_scans s
 LEFT JOIN (SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m, count(*) FILTER (WHERE severity = 'low') AS l, count(*) FILTER (WHERE severity = 'info') AS i FROM o_findings GROUP BY scan_id) f ON s.scan_id = f.scan_id
 LEFT JOIN (SELECT scan_id, count(*) AS n FROM fx_pages GROUP BY scan_id) p ON s.scan_id = p.scan_id LEFT JOIN (SELECT scan_id, count(*) AS n FROM fx_requests GROUP BY scan_id) r ON s.scan_id = r.scan_id"""
S["severity_counts"] = "SELECT * FROM o_counts"
S["category_counts"] = "SELECT scan_id, category, count(*) AS n_findings FROM o_findings GROUP BY 1, 2"
_RANK = "CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 99 END AS INT)"
S["findings_sorted"] = f"SELECT scan_id, page_id, det_ord, item_ord, rule_ord, pos, category, severity, {_RANK} AS severity_rank FROM o_findings"
S["inventory_sri"] = "SELECT scan_id, origin FROM o_bare"
S["script_inventory"] = "SELECT scan_id, origin, host, script_count, insecure_loads, has_sri, examples FROM o_inventory"
S["inventory_examples"] = "SELECT scan_id, origin, examples FROM o_examples"
for _key, _n in (("sc_public_data", "public_data_exposure"), ("sc_auth_session", "auth_session_risk"), ("sc_credentials", "credential_leakage"),
                 ("sc_recon", "internal_recon"), ("sc_supply_chain", "client_side_supply_chain_risk")):
    S[_key] = f"SELECT scan_id, scenario_type, impact, confidence, score, n AS n_findings FROM o_scored WHERE scenario_type = '{_n}'"
S["sc_score"] = "SELECT scan_id, scenario_type, score FROM o_scored"
S["sc_ranked"] = "SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, scenario_type) AS INT) AS rank, scenario_type, title, skill AS skill_level, tm AS time_to_discover FROM o_scored"
S["sc_evidence"] = """SELECT scan_id, scenario_type, category, title, url, left(evidence, 120) AS evidence_snippet FROM o_members QUALIFY row_number() OVER (PARTITION BY scan_id, scenario_type ORDER BY CASE WHEN det_ord >= 31 THEN 2 WHEN det_ord = 0 THEN 0 ELSE 1 END, page_id, det_ord, item_ord, rule_ord, pos, url, asset_url NULLS FIRST, title) <= 5"""
S["crawl_frontier"] = "SELECT scan_id, url, CAST(depth AS INT) AS depth, CAST(visit_rank AS INT) AS visit_rank FROM (SELECT * FROM o_v0 UNION ALL SELECT * FROM o_v1 UNION ALL SELECT * FROM o_v2)"
S["page_caps"] = "SELECT page_id, ord, type FROM fx_console QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) <= 25"
S["request_cap"] = "SELECT scan_id, request_id FROM fx_requests QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY request_id) <= 500"
S["recent_logs"] = "SELECT scan_id, ord, type, text FROM fx_console QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ord) <= 200"
S["recent_scans"] = "SELECT scan_id, target_url, status FROM fx_scans ORDER BY scan_id DESC LIMIT 50"
S["recent_reviews"] = "SELECT review_id, pr_url, checks_status FROM fx_reviews ORDER BY updated_at DESC, review_id DESC LIMIT 50"
O["o_report"] = f"""SELECT scan_id, 'target' AS section, CAST(NULL AS BIGINT) AS k0, CAST(NULL AS STRING) AS k1, CAST(NULL AS BIGINT) AS k2, {_S('scan_id')} AS id, target_url AS fact, {_S('pages_scanned')} AS number, status FROM fx_scans JOIN o_counts USING (scan_id)
 UNION ALL SELECT scan_id, 'summary', NULL, NULL, NULL, NULL, NULL, {_S('findings_count')}, status FROM fx_scans JOIN o_counts USING (scan_id)
 UNION ALL SELECT scan_id, 'options', NULL, NULL, NULL, NULL, NULL, NULL, status FROM fx_scans UNION ALL SELECT scan_id, 'handoff', NULL, NULL, NULL, NULL, NULL, NULL, status FROM fx_scans
 UNION ALL SELECT f.scan_id, 'finding', {_RANK}, category, page_id, concat_ws(':', {_S('f.scan_id')}, coalesce({_S('page_id')}, '-'), {_S('det_ord')}, {_S('item_ord')}, {_S('rule_ord')}, {_S('pos')}, CASE WHEN det_ord > 16 THEN md5(coalesce(asset_url, '')) END), {_SRC}, NULL, s.status FROM o_findings f JOIN fx_scans s ON f.scan_id = s.scan_id
 UNION ALL SELECT scan_id, 'page', page_id, NULL, NULL, {_S('page_id')}, coalesce(CASE WHEN json_valid(headers_json) THEN coalesce(headers_json->>'$."content-type"', headers_json->>'$."Content-Type"') END, url), NULL, status FROM fx_pages JOIN (SELECT scan_id, status FROM fx_scans) s USING (scan_id)
 UNION ALL SELECT r.scan_id, 'request', request_id, NULL, NULL, {_S('request_id')}, coalesce(CASE WHEN json_valid(response_headers_json) THEN coalesce(response_headers_json->>'$."content-type"', response_headers_json->>'$."Content-Type"') END, r.url), NULL, s.status FROM fx_requests r JOIN fx_scans s ON r.scan_id = s.scan_id
 UNION ALL SELECT i.scan_id, 'script_domain', -script_count, i.origin, NULL, i.origin, NULL, {_S('script_count')}, s.status FROM o_inventory i JOIN fx_scans s ON i.scan_id = s.scan_id
 UNION ALL SELECT o.scan_id, 'scenario', row_number() OVER (PARTITION BY o.scan_id ORDER BY score DESC, scenario_type), NULL, NULL, scenario_type, impact, {_S('row_number() OVER (PARTITION BY o.scan_id ORDER BY score DESC, scenario_type)')}, s.status FROM o_scored o JOIN fx_scans s ON o.scan_id = s.scan_id"""
S["ingestion_report"] = "SELECT * EXCLUDE (status) FROM o_report WHERE status = 'completed'"
S["pr_quarantine"] = """SELECT review_id, reason, CASE WHEN reason = 'sound' THEN json_extract_string(p, '$.user.login') END AS author FROM (
 SELECT *, CASE WHEN trim(p) = '' THEN 'empty' WHEN json_valid(p) THEN CASE WHEN json_type(p) = 'OBJECT' THEN 'sound' ELSE 'malformed' END ELSE 'malformed' END AS reason FROM (
 SELECT review_id, CASE WHEN review_id % 7 = 0 THEN left(payload, length(payload) - 9) WHEN review_id % 11 = 0 THEN ' ' WHEN review_id % 13 = 0 THEN concat('[', payload, ']') ELSE payload END AS p FROM fx_pr_payloads))"""
S["scan_documents"] = """SELECT s.scan_id, t.section, coalesce(n, 0) AS elements, greatest(coalesce(n, 0) - 1, 0) AS commas, CAST(2 AS BIGINT) AS brackets
 FROM (SELECT scan_id FROM fx_scans WHERE status = 'completed') s CROSS JOIN (VALUES ('finding'), ('page'), ('request'), ('script_domain')) t(section)
 LEFT JOIN (SELECT scan_id, section, count(*) AS n FROM o_report WHERE status = 'completed' GROUP BY 1, 2) r ON s.scan_id = r.scan_id AND t.section = r.section"""
S["review_store"] = """SELECT review_id, file_ord, rule_id, severity, snippet FROM o_rule_todo
 UNION ALL SELECT review_id, file_ord, rule_id, severity, snippet FROM o_rule_console_log WHERE review_id NOT IN (SELECT review_id FROM fx_reviews WHERE checks_status = 'fail')"""
S["scan_export"] = f"""SELECT scan_id, section, k0, k1, k2, id, CASE WHEN section = 'finding' THEN furl ELSE fact END AS fact, CAST(NULL AS STRING) AS number FROM (SELECT o.* REPLACE (p.url AS fact), CAST(NULL AS STRING) AS furl FROM o_report o JOIN fx_pages p ON o.k0 = p.page_id WHERE section = 'page'
 UNION ALL SELECT f.scan_id, 'finding', {_RANK}, category, page_id, concat_ws(':', {_S('f.scan_id')}, coalesce({_S('page_id')}, '-'), {_S('det_ord')}, {_S('item_ord')}, {_S('rule_ord')}, {_S('pos')}, CASE WHEN det_ord > 16 THEN md5(coalesce(asset_url, '')) END), NULL, NULL, NULL, url FROM o_findings f)
 UNION ALL SELECT scan_id, 'scan', NULL, NULL, NULL, {_S('scan_id')}, target_url, NULL FROM fx_scans"""
for _n in FILE_RULES:
    S["rv_" + _n] = f"SELECT review_id, file_ord, rule_id, category, severity, title, file_path, snippet, score_impact FROM o_rule_{_n}"
for _n in WORKFLOW:
    S["rv_" + _n] = f"SELECT review_id, rule_id, severity, file_path, snippet, score_impact FROM o_wf_{_n}"
S["file_class"] = f"SELECT path, {_CLASS} AS file_class, count(*) AS n FROM fx_review_files GROUP BY 1, 2"
S["file_flags"] = f"SELECT path, {_TEST} AS is_test, {_LOGIC} AS is_logic, {_SERVICE} AS is_service, count(*) AS n FROM fx_review_files GROUP BY 1, 2, 3, 4"
S["patch_lines"] = "SELECT review_id, file_ord, count(*) AS n_lines, count(*) FILTER (WHERE text LIKE '+%' AND text NOT LIKE '+++%') AS n_added, count(*) FILTER (WHERE text LIKE '-%' AND text NOT LIKE '---%') AS n_removed, CAST(max(n) AS INT) AS last_line FROM o_lines GROUP BY 1, 2"
S["patch_text"] = "SELECT f.review_id, f.file_ord, md5(coalesce(t.txt, '')) AS text_md5 FROM fx_review_files f LEFT JOIN o_added_text t ON f.review_id = t.review_id AND f.file_ord = t.file_ord WHERE f.patch <> ''"
S["line_nesting"] = "SELECT f.review_id, f.file_ord, k.d AS deepest, coalesce(k.s, 0) AS braces FROM fx_review_files f LEFT JOIN (SELECT review_id, file_ord, CAST(max(length(text) - length(replace(text, '{', ''))) AS INT) AS d, CAST(sum(length(text) - length(replace(text, '{', ''))) AS INT) AS s FROM o_add GROUP BY 1, 2) k ON f.review_id = k.review_id AND f.file_ord = k.file_ord WHERE f.patch <> ''"
S["patch_snippet"] = "SELECT review_id, file_ord, snip AS snippet FROM o_cond3"
O["o_num"] = r"""SELECT *, CASE WHEN hs IS NULL THEN hs0 ELSE hs END AS st FROM (SELECT *, TRY_CAST(nullif(regexp_extract(text, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)', 1), '') AS BIGINT) AS h, last_value(TRY_CAST(nullif(regexp_extract(text, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)', 1), '') AS BIGINT) IGNORE NULLS) OVER w AS hs, CAST(1 AS BIGINT) AS hs0,
 count(*) FILTER (WHERE regexp_matches(text, '^@@ -[0-9]+(?:,[0-9]+)? [+][0-9]+')) OVER w AS hunk FROM o_lines WINDOW w AS (PARTITION BY review_id, file_ord ORDER BY n))"""
S["patch_line_numbers"] = """SELECT review_id, file_ord, count(*) AS n_lines, min(ln) AS first_line, max(ln) AS last_line, CAST(sum(ln) AS BIGINT) AS line_sum FROM (SELECT *, st - 1 + count(*) FILTER (WHERE h IS NULL AND text NOT LIKE '-%') OVER (PARTITION BY review_id, file_ord, hunk ORDER BY n) AS ln FROM o_num) WHERE h IS NULL AND text LIKE '+%' GROUP BY 1, 2"""
O["o_words"] = r"""SELECT review_id, file_ord, lower(w) AS w, min((n, i)) AS seen FROM (SELECT review_id, file_ord, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(text, '\b[a-z][a-zA-Z]{3,}\b') AS ws FROM o_add)) GROUP BY 1, 2, 3"""
S["naming_plural"] = """SELECT review_id, file_ord, string_agg(s || '/' || s || 's', ',' ORDER BY seen) AS conflicts FROM (SELECT a.review_id, a.file_ord, b.w AS s, a.seen FROM o_words a JOIN o_words b ON a.review_id = b.review_id AND a.file_ord = b.file_ord AND a.w = b.w || 's' QUALIFY row_number() OVER (PARTITION BY a.review_id, a.file_ord ORDER BY a.seen) <= 3) GROUP BY 1, 2"""
S["rv_term_drift"] = "SELECT review_id, CAST(rule_ord AS INT) AS rule_ord, severity, file_path, snippet, score_impact FROM o_drift"
S["rv_logic_change"] = "SELECT review_id, file_ord, path FROM o_ff WHERE changed"
S["rv_no_tests"] = f"SELECT review_id, rule_id, severity, {_S('k')} || ' changed logic files without tests, first: ' || file_path AS summary, file_path, score_impact FROM o_no_tests"
S["rv_untested_service"] = f"SELECT review_id, rule_id, severity, {_S('k')} || ' changed service files without a matching test, first: ' || file_path AS summary, file_path, score_impact FROM o_untested"
S["rv_notes"] = f"""SELECT review_id, size AS pr_size, days > 7 AS stale, reviewer AS reviewer_assigned, concat_ws(' | ', CASE WHEN size = 'large' THEN 'Large PR: ' || {_S('n_files')} || ' files, +' || {_S('additions')} || ' lines' END, CASE WHEN NOT reviewer THEN 'No reviewer assigned' END,
 CASE WHEN days > 7 THEN 'Stale: last updated ' || {_S('days')} || ' days ago' END, CASE checks_status WHEN 'fail' THEN 'CI checks failing' WHEN 'warn' THEN 'CI checks have warnings' END) AS notes FROM o_rr"""
S["rv_totals"] = "SELECT review_id, n_files, additions, deletions FROM o_rf"
O["o_anat"] = "SELECT review_id, CAST(CASE WHEN n_files = 0 THEN 0 ELSE floor(c_tests * 100.0 / n_files + 0.5) END AS INT) AS tests_pct, CAST(CASE WHEN n_files = 0 THEN 0 ELSE floor(c_config * 100.0 / n_files + 0.5) END AS INT) AS config_pct, CAST(CASE WHEN n_files = 0 THEN 0 ELSE floor(c_noise * 100.0 / n_files + 0.5) END AS INT) AS noise_pct FROM o_rr"
S["rv_anatomy"] = "SELECT *, 100 - tests_pct - config_pct - noise_pct AS logic_pct FROM o_anat"
S["rv_score"] = "SELECT review_id, score, overall_risk, merge_recommendation, high_risk_count FROM o_score"
S["rv_focus_files"] = "SELECT * FROM o_focus"
S["rv_summary"] = """SELECT r.review_id, count(*) FILTER (WHERE analyzer_ord = 4 AND rule_id <> 'exposure/dev-artifact') AS exposure_risk_count, count(*) FILTER (WHERE analyzer_ord = 5) AS test_gap_count, CASE WHEN count(*) FILTER (WHERE analyzer_ord = 2) > 0 THEN 'degraded' ELSE 'neutral' END AS maintainability_status
 FROM fx_reviews r LEFT JOIN o_rv v ON r.review_id = v.review_id GROUP BY r.review_id"""
S["rv_counts"] = """SELECT r.review_id, count(v.category) AS n_findings, count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories
 FROM fx_reviews r LEFT JOIN o_rv v ON r.review_id = v.review_id GROUP BY r.review_id"""
S["rv_sorted"] = "SELECT review_id, CAST(analyzer_ord AS INT) AS analyzer_ord, file_ord, CAST(rule_ord AS INT) AS rule_ord, rule_id, severity, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INT) AS severity_rank FROM o_rv"
S["rv_exposure_top"] = """SELECT review_id, string_agg(title, ' | ' ORDER BY rn) FILTER (WHERE rn <= 3) AS titles, count(*) - least(count(*), 3) AS more FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, analyzer_ord, file_ord, rule_ord, rule_id) AS rn
 FROM o_rv WHERE category IN ('exposure', 'security')) GROUP BY review_id"""
S["checks_rollup"] = """SELECT r.review_id, CASE WHEN count(c.review_id) = 0 THEN 'unknown' WHEN bool_or(coalesce(c.conclusion = 'failure', false)) THEN 'fail' WHEN bool_or(coalesce(c.conclusion = 'neutral', false) OR c.status <> 'completed') THEN 'warn' ELSE 'pass' END AS checks_status
 FROM fx_reviews r LEFT JOIN fx_check_runs c ON r.review_id = c.review_id GROUP BY r.review_id"""
O["o_two"] = "SELECT * FROM o_rule_bypass UNION ALL SELECT * FROM o_rule_route"
S["enrich_overlay"] = f"""SELECT f.review_id, f.file_ord, f.rule_id, CASE WHEN w.ord IS NOT NULL AND f.review_id % 2 = 0 THEN 'Look at ' || {_S('w.ord')} WHEN f.rule_id = 'exposure/auth-bypass' THEN 'Login can be skipped: ' || f.file_path
 ELSE 'New ' || CASE WHEN regexp_matches(f.snippet, '/(admin|internal|debug|root|superuser)') THEN 'admin/internal' ELSE 'login' END || ' route: ' || f.file_path END AS summary FROM o_two f
 LEFT JOIN (SELECT review_id, rule_id, file_path, min(file_ord) AS ord FROM (SELECT * FROM o_two QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY analyzer_ord, file_ord, rule_ord) <= 5) GROUP BY 1, 2, 3) w
 ON f.review_id = w.review_id AND f.rule_id = w.rule_id AND f.file_path = w.file_path"""
S["review_report"] = """SELECT r.review_id, 'review' AS section, s.merge_recommendation AS verdict, r.size AS fact, f.path AS text FROM o_rr r JOIN o_score s ON r.review_id = s.review_id LEFT JOIN (SELECT review_id, path FROM o_focus WHERE focus_rank = 1) f ON r.review_id = f.review_id
 UNION ALL SELECT review_id, 'finding', rule_id, CASE WHEN is_redacted THEN 'true' ELSE 'false' END, safe_snippet FROM o_stored"""

ORACLE = {name: with_views("duck", sql, O) for name, sql in S.items()}
