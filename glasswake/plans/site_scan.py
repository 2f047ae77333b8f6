"""The site scan: captured tables in, deduplicated findings out, one lazy plan.

Rules are kept in a registry by name.  A rule whose table was not captured does not
apply; a rule that cannot be planned for a given table (say, a column is missing) is an
error, so that no result looks complete without it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from glasswake.functions.html import linked_scripts
from glasswake.operators import (
    addresses, clientstate, content, findings as fi, probes, responses, scripts,
)
from glasswake.sources.captures import storage_items


@dataclass
class Captures:
    """Tables of one capture; any but ``scans`` and ``pages`` may be missing."""
    scans: DataFrame                       # scan_id, target_url, origin, options_json, status
    pages: DataFrame                       # scan_id, page_id, url, depth, html, headers
    as_of: int                             # "now" in epoch seconds
    cookies: DataFrame | None = None
    storage: DataFrame | None = None
    console: DataFrame | None = None
    requests: DataFrame | None = None
    robots: DataFrame | None = None        # scan_id, url, body
    assets: DataFrame | None = None        # asset_url, body
    responses: DataFrame | None = None     # scan_id, path, url, status, content_type, body
    map_responses: DataFrame | None = None
    options: DataFrame | None = None       # scan_id, opt
    strict_dedup: bool = False


def _page_addresses(pages: DataFrame) -> DataFrame:
    return pages.select(*fi.KEYS, F.lit(0).cast("bigint").alias("item_ord"), "url")


def _request_addresses(requests: DataFrame) -> DataFrame:
    return requests.select(*fi.KEYS, F.col("request_id").alias("item_ord"), "url")


def script_references(pages: DataFrame) -> DataFrame:
    rows = linked_scripts(pages, [*fi.KEYS, "url"])
    return rows.select(*fi.KEYS, "url", "ord", F.col("script_url").alias("asset_url"))


Rule = Callable[[Captures], DataFrame]

REGISTRY: dict[str, Rule] = {
    "headers": lambda c: responses.header_findings(c.pages),
    "policy": lambda c: responses.policy_findings(c.pages),
    "page_content": lambda c: content.content_findings(content.page_bodies(c.pages)),
    "scripts": lambda c: scripts.script_findings(c.pages),
    "page_url": lambda c: addresses.param_findings(_page_addresses(c.pages), "page_url"),
    "cookies": lambda c: clientstate.cookie_findings(c.cookies, c.as_of),
    "storage": lambda c: clientstate.storage_findings(c.storage),
    "storage_secrets": lambda c: content.content_findings(
        content.storage_bodies(c.storage), ("secrets",)),
    "console": lambda c: clientstate.console_findings(c.console),
    "request_url": lambda c: addresses.param_findings(
        _request_addresses(c.requests), "request_url"),
    "robots": lambda c: addresses.robots_findings(c.robots),
    "bundles": lambda c: content.bundle_findings(
        c.assets, script_references(c.pages), c.map_responses),
    "probes": lambda c: probes.probe_findings(c.responses),
}
NEEDS = {"cookies": "cookies", "storage": "storage", "storage_secrets": "storage",
         "console": "console", "request_url": "requests", "robots": "robots",
         "bundles": "assets", "probes": "responses"}


def raw_findings(c: Captures, enabled: tuple[str, ...] | None = None) -> DataFrame:
    parts = []
    if c.storage is None and "storage_json" in c.pages.columns:
        c = replace(c, storage=storage_items(c.pages))
    for name, rule in REGISTRY.items():
        if enabled and name not in enabled:
            continue
        if name in NEEDS and getattr(c, NEEDS[name]) is None:
            continue
        parts.append(rule(c))
    if not parts:
        raise ValueError("no enabled rule has its table")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def site_scan(c: Captures, enabled: tuple[str, ...] | None = None) -> DataFrame:
    """All findings: gated by the scan's options (without a table of options: the defaults),
    first of equal ones per page."""
    found = fi.gate(raw_findings(c, enabled), c.options)
    return fi.with_finding_id(fi.deduplicate(found, c.strict_dedup))
