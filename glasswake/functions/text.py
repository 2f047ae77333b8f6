"""Text expressions: truncation, placeholders, entropy, redaction, match context."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WHITESPACE = " \t\n\r\f\u000b\u00a0\ufeff"

# ---- fixed values -----------------------------------------------------------
# Values nobody would use as a real secret.
PLACEHOLDER = (
    r"(?i)^(your|example|sample|dummy|fake|test|demo|placeholder|changeme|todo|x{3,}"
    r"|<.*>|\{.*\}|\$\{.*\})"
)
PASSWORD_PLACEHOLDERS = (
    r"^password\z", r"^passwd\z", r"^pass\z", r"^pwd\z", r"^secret\z",
    r"^<[^>]+>\z", r"^\{[^}]+\}\z", r"^\$\{[^}]+\}\z", r"^%[a-z(]",
    r"^\*+\z", r"^\.+\z", r"^x+\z", r"^n/?a\z", r"^null\z", r"^undefined\z", r"^none\z",
    r"^empty\z", r"^required\z", r"^todo\z", r"^fixme\z", r"^changeme\z", r"^changeit\z",
    r"^replace.?me\z", r"^your.?pass(word)?\z", r"^enter.?pass(word)?\z", r"^my.?pass(word)?\z",
    r"^test", r"^demo", r"^example", r"^sample", r"^fake", r"^dummy", r"^placeholder",
    r"^insert.?here\z", r"^type.?here\z", r"^123+\z", r"^abc+\z",
)
TRIVIAL_PASSWORDS = (
    "root", "admin", "toor", "pass", "qwerty", "letmein",
    "welcome", "monkey", "dragon", "password1", "iloveyou",
)
# Redaction of review snippets: pattern, replacement, in this order.
SNIPPET_REDACTIONS = (
    (r"""(['"`])([A-Za-z0-9+/=_\-!@#$%^&*]{6,})(\1)""", "[REDACTED]"),
    (r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"),
    (r"(?<![A-Za-z0-9_])[A-Fa-f0-9]{32,}(?![A-Za-z0-9_])", "[REDACTED]"),
)
REDACTED_CATEGORIES = ("exposure", "security")
SECRET_RULE_WORDS = ("secret", "credential", "token")
ENTROPY_MIN_LENGTH, ENTROPY_MIN_BITS = 16, 3.5


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def truncate(c: Column, limit: int = 500) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def is_placeholder(c: Column) -> Column:
    return c.rlike(PLACEHOLDER)


def is_password_placeholder(c: Column) -> Column:
    return is_placeholder(c) | c.rlike("(?i)" + "|".join(PASSWORD_PLACEHOLDERS))


def is_trivial_password(c: Column) -> Column:
    return F.lower(c).isin(*TRIVIAL_PASSWORDS)


def entropy(c: Column) -> Column:
    """Shannon entropy, bits per character; one pass per DISTINCT character."""
    n = F.length(c)
    return F.aggregate(
        F.transform(F.array_distinct(F.split(c, "", -1)),
                    lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))) / n),
        F.lit(0.0),
        lambda acc, p: F.when(p > 0, acc - p * F.log2(p)).otherwise(acc),
    )


def is_high_entropy(c: Column) -> Column:
    return F.when(F.length(c) >= ENTROPY_MIN_LENGTH,
                  entropy(c) >= ENTROPY_MIN_BITS).otherwise(F.lit(False))


def redact_value(c: Column) -> Column:
    return F.when(F.length(c) <= 8, F.lit("[redacted]")).otherwise(
        F.concat(F.left(c, F.lit(4)), F.lit("…[redacted]")))


def redact_snippet(c: Column) -> Column:
    """struct<redacted_snippet, is_redacted>; every match of the patterns counts."""
    text, hit = c, F.lit(False)
    for pattern, replacement in SNIPPET_REDACTIONS:
        # a Bearer match always holds 'Bearer', so no match is under 6 characters
        hit = hit | text.rlike(pattern)
        text = F.regexp_replace(text, pattern, replacement)
    return F.struct(text.alias("redacted_snippet"), hit.alias("is_redacted"))


def needs_redaction(category: Column, rule_id: Column) -> Column:
    by_rule = F.lit(False)
    for word in SECRET_RULE_WORDS:
        by_rule = by_rule | rule_id.contains(word)
    return category.isin(*REDACTED_CATEGORIES) | by_rule


def process_snippet(df, raw: str, category: str, rule_id: str, limit: int = 1000):
    """Safe snippet, redacted form, revealed form (only if something was hidden)."""
    df = df.withColumn("_p", F.when(
        (F.col(raw) != "") & needs_redaction(F.col(category), F.col(rule_id)),
        redact_snippet(F.col(raw))))
    hidden = F.coalesce(F.col("_p")["is_redacted"], F.lit(False))
    cut = lambda c: F.left(c, F.lit(limit))
    return (
        df.withColumn("is_redacted", hidden)
        .withColumn("redacted_snippet", F.when(hidden, cut(F.col("_p")["redacted_snippet"])))
        .withColumn("revealed_snippet", F.when(hidden, cut(F.col(raw))))
        .withColumn("safe_snippet", F.when(hidden, cut(F.col("_p")["redacted_snippet"]))
                    .otherwise(F.when(F.col(raw) != "", cut(F.col(raw)))))
        .drop("_p")
    )


def sql_text(value: str) -> str:
    """A Python string as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Search:
    """One pattern to look for: output column, SQL condition to look at all, groups whose
    first non-empty one is the value, context width, length of the shortest match."""
    name: str
    guard: str
    pattern: str
    groups: tuple[int, ...]
    width: int
    shortest: int


def with_context_matches(df: DataFrame, content: str, searches: list[Search]) -> DataFrame:
    """Add, per search, an array of all matches with the text around each.

    Spark has no match offsets, so the text is split at the matches and put
    together again around each of them.  A window of ``width`` characters spans at
    most ``width / shortest`` neighbouring matches, so the work is linear in the
    matches.  The helper arrays are columns of their own: an expression inside a
    lambda would be evaluated once per element.
    Yields array<struct<pos, value, whole, left, right>>, NULL where nothing is found.
    """
    hits, parts, sides, out = {}, {}, {}, {}
    for s in searches:
        n, w, p = s.name, s.width, sql_text(s.pattern)
        near = math.ceil(w / s.shortest) + 1
        hits[f"{n}_hits"] = f"CASE WHEN {s.guard} THEN regexp_extract_all({content}, {p}, 0) END"
        found = f"CASE WHEN size({n}_hits) > 0 THEN"
        parts[f"{n}_gaps"] = f"{found} split({content}, {p}, -1) END"
        for g in s.groups:
            parts[f"{n}_v{g}"] = f"{found} regexp_extract_all({content}, {p}, {g}) END"
        sides[f"{n}_before"] = (f"zip_with({n}_hits, slice({n}_gaps, 1, size({n}_hits)), "
                                f"(m, g) -> right(concat(g, m), {w}))")
        sides[f"{n}_after"] = (f"zip_with({n}_hits, slice({n}_gaps, 2, size({n}_hits)), "
                               f"(m, g) -> left(concat(m, g), {w}))")
        value = f"get({n}_v{s.groups[-1]}, i)"
        for g in reversed(s.groups[:-1]):
            value = f"coalesce(nullif(get({n}_v{g}, i), ''), {value})"
        left = (f"concat(array_join(slice({n}_before, greatest(i + 1 - {near}, 1), "
                f"i + 1 - greatest(i + 1 - {near}, 1)), ''), get({n}_gaps, i))")
        right = (f"concat(get({n}_gaps, i + 1), array_join(slice({n}_after, i + 2, "
                 f"least({near}, greatest(size({n}_hits) - i - 1, 0))), ''))")
        out[n] = (f"{found} transform({n}_hits, (m, i) -> struct(i AS pos, {value} AS value, "
                  f"m AS whole, right({left}, {w}) AS left, left({right}, {w}) AS right)) END")
    for step in (hits, parts, sides, out):
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df.drop(*hits, *parts, *sides)
