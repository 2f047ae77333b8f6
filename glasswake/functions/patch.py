"""Unified-diff helpers.  A file's patch is one string on one row, so line work is
done with array functions inside the row: no explode, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.bind import bind
from glasswake.functions.text import strip

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)"


def is_added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def is_removed(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def split_patch(files: DataFrame) -> DataFrame:
    """All files with arrays ``lines``, ``added`` and ``removed`` (empty without a patch), each
    made once per row however many rules read it."""
    df = bind(files, "lines", F.split(F.coalesce("patch", F.lit("")), "\n", -1))
    df = bind(df, "signed", F.struct(F.filter("lines", is_added).alias("added"), F.filter("lines", is_removed).alias("removed")))
    return df.select("*", "signed.added", "signed.removed").drop("signed")


def with_lines(files: DataFrame) -> DataFrame:
    """Files that have a patch, with arrays ``lines``, ``added`` and ``removed``."""
    return split_patch(files.filter("patch <> ''"))


def patch_lines(files: DataFrame) -> DataFrame:
    """Long form: one row per diff line with its sign."""
    rows = files.filter("patch <> ''").select(
        "review_id", "file_ord", F.posexplode(F.split("patch", "\n", -1)).alias("line_no", "text"))
    sign = F.when(is_added(F.col("text")), "+").when(is_removed(F.col("text")), "-")
    return rows.withColumn("sign", sign)


def patch_text(added: Column) -> Column:
    return F.lower(F.array_join(F.transform(added, lambda l: F.substring(l, 2, 1 << 30)), "\n"))


def first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), 0)


def unsigned(line: Column, sign: str = "+") -> Column:
    return strip(F.regexp_replace(line, "^\\" + sign, ""))


def nesting(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("{"), F.lit("")))


def longest_run(lines: Column) -> Column:
    """Longest run of consecutive added lines."""
    state = F.aggregate(
        lines, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, l: F.struct(
            F.when(is_added(l), s["run"] + 1).otherwise(0).alias("run"),
            F.when(is_added(l), F.greatest(s["best"], s["run"] + 1)).otherwise(s["best"])
            .alias("best")))
    return state["best"]


def first_with_context(text: Column, pattern: str, n: int = 3) -> Column:
    """First line of a text that matches and the ones after it, ``n`` in all; '' if none does.  ``pattern``
    must not cross a line's end: the text is read up to the match in one compiled pass and never split."""
    found = r"(?<![^\n])[^\n]*?(?:" + pattern + r")[^\n]*(?:\n[^\n]*){0," + str(n - 1) + "}"
    return unsigned(F.regexp_extract(text, found, 0))


def snippets(files: DataFrame, pattern: str, words: tuple[str, ...]) -> DataFrame:
    """``first_with_context`` of every patch that matches.  What matches holds one of ``words``, which
    are looked for first."""
    df = bind(files.filter("patch <> ''").select("review_id", "file_ord", "patch"), "text", F.col("patch")).drop("patch")
    df = df.filter(reduce(or_, [F.col("text").contains(w) for w in words]))
    return bind(df, "snippet", first_with_context(F.col("text"), pattern)).drop("text").filter("snippet <> ''")


def line_numbers(files: DataFrame) -> DataFrame:
    """New-file line number of every added line.

    Within a hunk the lines that are not removed are numbered from the header's number on, so
    the place among these is the number: every step is linear in the lines of the row.
    """
    rows = files.filter("patch <> ''").select("review_id", "file_ord", F.split("patch", "\n", -1).alias("lines"))
    header = lambda l, i: F.when(l.startswith("@@ -"), F.when(l.rlike(HUNK), i))
    rows = bind(rows, "hunks", F.filter(F.transform("lines", header), lambda i: i.isNotNull()))
    # lines before the first header are numbered from 1
    span = lambda h, k: F.struct(
        (h + 2).alias("at"), (F.coalesce(F.get("hunks", k), F.size("lines")) - h - 1).alias("n"),
        F.when(h < 0, F.lit(1).cast("bigint")).otherwise(
            F.regexp_extract(F.get("lines", h), HUNK, 1).try_cast("bigint")).alias("first"))
    rows = rows.withColumn("spans_", F.transform(F.concat(F.array(F.lit(-1)), "hunks"), span)).withColumn(
        "numbered_", F.transform("lines", lambda l, i: F.struct(i.alias("line_no"), l.alias("text"))))
    rows = bind(bind(rows, "spans", F.col("spans_")), "numbered", F.col("numbered_"))
    added = rows.select("review_id", "file_ord", F.flatten(F.transform("spans", _added)).alias("added"))
    return added.select("review_id", "file_ord", F.explode("added").alias("l")).select("review_id", "file_ord", "l.*")


def _added(span: Column) -> Column:
    """The added lines of one hunk with their numbers."""
    kept = F.filter(F.slice("numbered", span["at"], span["n"]), lambda x: ~x["text"].startswith("-"))
    rows = F.transform(kept, lambda x, k: F.struct(x["line_no"].alias("line_no"), (span["first"] + k).alias("new_line"),
                                                   x["text"].alias("text")))
    return F.filter(rows, lambda x: x["text"].startswith("+"))
