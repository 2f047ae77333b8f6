"""Quality rules, line first: lines that look like menus, boilerplate or junk are removed, and a
document that loses too much of its text that way is rejected. Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.bind import bind

MIN_WORDS = 50
MOST_LOSS = 50              # per cent of the characters in words
SYMBOLS = "[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"

# How lines of boilerplate begin.
BOILERPLATE = ("^[ \\t]*(all rights reserved|copyright|accept (all )?cookies|cookie (policy|settings|notice)|"
               "privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in|click here|read more|"
               "share (this|on)|follow us|skip to content|back to top|powered by|page [0-9]+ of [0-9]+)")


def line_fails(x: Column) -> Column:
    """Whether a line with words breaks a rule: over a tenth symbols; three separators of menus or
    tables; capitals; short without any mark that ends a sentence; a phrase of boilerplate."""
    return (_symbols(x) | _navigation(x) | _shouting(x) | _no_sentence(x) | _boilerplate(x))


def _only(x: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(x, f"[^{kept}]", ""))


def _symbols(x: Column) -> Column:
    return _only(x, "#*$%&|<>") * 10 > F.length(x)


def _navigation(x: Column) -> Column:
    return _only(x, "|>»›•·") >= 3


def _shouting(x: Column) -> Column:
    capitals = _only(x, "A-Z")
    return (capitals >= 20) & (capitals > _only(x, "a-z"))


def _no_sentence(x: Column) -> Column:
    return (F.length(x) < 200) & ~x.rlike("[.!?;:…。！？]")


def _boilerplate(x: Column) -> Column:
    return F.lower(x).rlike(BOILERPLATE)


def _word_chars(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, WORD, ""))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the whole row as struct ``__row``, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept_chars, clean_text, kept. Null and empty texts
    have no words and fail. The work on a row is about linear in its length, and no row meets
    another, so repeated rows and ties all get the same answer."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = bind(docs.select(F.struct("*").alias("__row"), text.alias("t")), "w",
              F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = bind(df, "h", F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), "
                              "i -> xxhash64(w[i], w[i + 1], w[i + 2])))").cast("array<bigint>"))
    # windows that occur twice, found by sorting; most texts have none
    df = bind(df, "s", F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<struct<x:bigint,i:int>>), "
                              "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))))"))
    df = bind(df, "p", F.expr("sort_array(transform(filter(s, (e, k) -> (k > 0 AND e.x = s[k - 1].x) OR "
                              "(k < size(s) - 1 AND e.x = s[k + 1].x)), e -> e.i))"))
    df = bind(df, "l", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    clean = F.array_join(F.filter("l", lambda x: ~line_fails(x)), "\n")
    df = bind(df, "clean_text", clean)
    df = df.select(
        "__row", "clean_text", F.size("w").cast("long").alias("n_words"), _word_chars(F.col("t")).alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, k) -> if(k = size(p) - 1, 3, least(3, p[k + 1] - x))), 0L, (a, b) -> a + b)")
        .alias("n_repeat_words"),
        _word_chars(F.col("clean_text")).alias("kept_chars"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (100 * F.col("kept_chars") >= (100 - MOST_LOSS) * F.col("word_chars"))
    return df.select("*", kept.alias("kept"))


def rules(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept_chars, kept."""
    return measure(docs).select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept_chars", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept rows with their columns; ``text`` has lost the lines that fail, ``n_chars`` follows."""
    own = [F.col("clean_text").alias("text") if c == "text" else
           F.length("clean_text").cast(t).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c)
           for c, t in docs.dtypes]
    return measure(docs).where("kept").select(*own)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
l AS (SELECT *, list_filter(ls, lambda x: NOT (
        length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 10 > length(x)
        OR length(regexp_replace(x, '[^|>»›•·]', '', 'g')) >= 3
        OR (length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 20
            AND length(regexp_replace(x, '[^A-Z]', '', 'g')) > length(regexp_replace(x, '[^a-z]', '', 'g')))
        OR (length(x) < 200 AND NOT regexp_matches(x, '[.!?;:…。！？]'))
        OR regexp_matches(lower(x), '^[ \t]*(all rights reserved|copyright|accept (all )?cookies|cookie (policy|settings|notice)|privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in|click here|read more|share (this|on)|follow us|skip to content|back to top|powered by|page [0-9]+ of [0-9]+)')
      )) AS good FROM w),
m AS (SELECT l.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(length(regexp_replace(coalesce(array_to_string(good, chr(10)), ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS kept_chars
      FROM l LEFT JOIN cov ON l.r = cov.r),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars,
       (NOT base_failed AND 100 * kept_chars >= 50 * word_chars) AS kept
FROM b
"""
