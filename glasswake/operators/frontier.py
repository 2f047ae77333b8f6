"""Crawl frontier: which captured pages a breadth-first crawl would visit, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glasswake.functions.urls import (
    is_destructive, is_skippable, with_canonical, with_url,
)
from glasswake.operators.findings import DEFAULT_OPTIONS, first_per
from glasswake.plans.lineage import cut


def in_scope(url: Column, origin: Column, scan_origin: Column,
             same_origin: Column, ignore_destructive: Column) -> Column:
    return (~is_skippable(url)
            & (~same_origin | F.coalesce(origin == scan_origin, F.lit(False)))
            & (~ignore_destructive | ~is_destructive(url)))


def scoped_links(links: DataFrame, scans: DataFrame) -> DataFrame:
    """Links (scan_id, src_url, link_ord, link) inside the scope of their scan.  A scan
    without a row has the default scope around the page that holds the link."""
    rules = scans.select("scan_id", "scan_origin", "same_origin", "ignore_destructive")
    rows = with_url(links, "link", "u").withColumn("_o", F.col("u")["origin"]).drop("u")
    rows = rows.join(rules.withColumn("_known", F.lit(True)), "scan_id", "left")
    rows = with_url(rows, "src_url", "u").withColumn("scan_origin", F.when(
        F.col("_known"), F.col("scan_origin")).otherwise(F.col("u")["origin"])).drop("u")
    default = lambda c, option: F.coalesce(c, F.lit(DEFAULT_OPTIONS[option]))
    return rows.filter(in_scope(
        F.col("link"), F.col("_o"), F.col("scan_origin"),
        default("same_origin", "sameOriginOnly"),
        default("ignore_destructive", "ignoreDestructiveLinks"))).select(
        "scan_id", "src_url", "link_ord", "link")


def crawl(scans: DataFrame, links: DataFrame) -> DataFrame:
    """Visited pages per scan: url, depth, visit_rank (first in, first out).

    ``scans``: scan_id, start_url, same_origin, ignore_destructive, max_pages, max_depth
    (NULL: the default option).  The loop has as many rounds as the deepest scan has levels,
    whatever the data size; each keeps at most max_pages rows per scan, so visited sets stay
    small and the joins spread over (scan, source page).
    """
    scans = with_canonical(with_url(scans, "start_url", "u"), "start_url", "start")
    scans = scans.withColumn("scan_origin", F.col("u")["origin"]).withColumns({
        c: F.coalesce(c, F.lit(DEFAULT_OPTIONS[o])) for c, o in (("max_pages", "maxPages"), ("max_depth", "maxDepth"))})
    limits = scans.select("scan_id", "max_pages", "max_depth")
    most_pages, most_depth = scans.agg(F.max("max_pages"), F.max("max_depth")).first()
    edges = with_canonical(scoped_links(links, scans), "src_url", "src")
    # written once: every level reads the parsed addresses
    edges = cut(with_canonical(edges, "link", "dst").select("scan_id", "src", "dst", "link_ord"))
    start_ok = in_scope(F.col("start"), F.col("scan_origin"), F.col("scan_origin"),
                        F.col("same_origin"), F.col("ignore_destructive"))
    level = scans.filter(start_ok & (F.col("max_pages") > 0)).select(
        "scan_id", F.col("start").alias("url"), F.lit(0).alias("depth"), F.lit(1).alias("visit_rank"))
    visited = level = cut(level)
    for depth in range(1, (most_depth or 0) + 1):
        deep = limits.filter(F.col("max_depth") >= depth)
        parents = level.join(deep, "scan_id", "left_semi").select(
            "scan_id", F.col("url").alias("src"), F.col("visit_rank").alias("parent_rank"))
        found = edges.join(parents, ["scan_id", "src"]).select(
            "scan_id", F.col("dst").alias("url"), "parent_rank", "link_ord")
        fresh = found.join(visited.select("scan_id", "url"), ["scan_id", "url"], "left_anti")
        fresh = first_per(fresh, ["scan_id", "url"], ["parent_rank", "link_ord"])
        w = Window.partitionBy("scan_id").orderBy("parent_rank", "link_ord", "url")
        # the constant bound lets each partition drop what can never be kept
        ranked = fresh.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most_pages)
        taken = visited.groupBy("scan_id").agg(F.count("*").alias("_taken")).join(limits, "scan_id")
        ranked = ranked.join(taken, "scan_id").withColumn(
            "visit_rank", (F.col("_taken") + F.col("_rn")).cast("int"))
        level = cut(ranked.filter(F.col("visit_rank") <= F.col("max_pages")).select(
            "scan_id", "url", F.lit(depth).alias("depth"), "visit_rank"))
        visited = visited.unionByName(level)
    return visited
