"""Markup extraction with JVM-side regular expressions over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.text import strip
from glasswake.functions.urls import with_resolved

# ---- fixed values: markup patterns ------------------------------------------
LINK = r"""(?i)href=["']([^"'#]+)["']"""
INLINE_SCRIPT = r"(?i)<script(?![^>]*src)[^>]*>([\s\S]*?)</script>"
LINKED_SCRIPT = r"""(?i)<script[^>]+src=["']([^"']+)["'][^>]*>"""
SCRIPT_TAG = r"(?i)<script\b([^>]*)>"
SCRIPT_SRC = r"""(?i)\bsrc\s*=\s*["']([^"']+)["']"""
SCRIPT_INTEGRITY = r"""(?i)\bintegrity\s*=\s*["'][^"']+["']"""
TITLE = r"(?i)<title[^>]*>([^<]*)</title>"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def title(html: Column) -> Column:
    return strip(F.regexp_extract(html, TITLE, 1))


def inline_scripts(html: Column) -> Column:
    return F.filter(F.transform(_all(html, INLINE_SCRIPT), strip), lambda s: s != "")


def _resolved_refs(pages: DataFrame, keys: list[str], refs: Column, out: str) -> DataFrame:
    """Explode references, resolve them, keep the first of equal ones per page.

    References of one page are de-duplicated as written before the explode; the
    few that only become equal by resolving are merged by the group below.
    """
    rows = pages.select(*keys, "url", F.posexplode(F.array_distinct(refs)).alias("ord", "ref"))
    rows = with_resolved(rows, "ref", "url", out).filter(F.col(out).isNotNull())
    return rows.groupBy(*keys, out).agg(F.min("ord").alias("ord"))


def links(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (page, distinct absolute link); ``ord`` is the order of appearance."""
    return _resolved_refs(pages, keys, _all(F.col("html"), LINK), "link")


def linked_scripts(pages: DataFrame, keys: list[str]) -> DataFrame:
    return _resolved_refs(pages, keys, _all(F.col("html"), LINKED_SCRIPT), "script_url")


def script_tags(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Script tags that have a source, in order, with the integrity flag."""
    tags = pages.select(
        *keys, "url", F.posexplode(_all(F.col("html"), SCRIPT_TAG)).alias("tag_ord", "attrs"))
    tags = tags.withColumn("src", F.regexp_extract("attrs", SCRIPT_SRC, 1)).filter("src <> ''")
    tags = with_resolved(tags, "src", "url", "script_url").filter("script_url IS NOT NULL")
    return tags.withColumn("has_integrity", F.col("attrs").rlike(SCRIPT_INTEGRITY)).drop("attrs")
