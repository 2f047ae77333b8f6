"""The registered queries: each runs an operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.views import AS_OF, REVIEW_AS_OF, spark_view
from glasswake.functions import html as H, patch as P, paths, text as X, urls as U
from glasswake.operators import (
    addresses, change_review as cr, change_rules as rules, clientstate, content,
    findings as fi, frontier, probes, responses, scenarios as sc, scripts,
)
from glasswake.plans import change_review as review_plan, documents, reports, site_scan as scan_plan
from glasswake.plans.lineage import checkpoint_dir, cut
from glasswake.sources import captures
from glasswake.sources.asset_store import AssetStore
from glasswake.sources.review_store import ReviewStore

SHOW = [*fi.KEYS, *fi.ORDER, "severity", "category", "title", "url", "asset_url", "evidence",
        "confidence"]
RULE = ["review_id", "file_ord", "rule_id", "category", "severity", "title", "file_path",
        "snippet", "score_impact"]


class Views:
    """The derived capture tables of one data folder, planned anew for every query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        view = spark_view(self.spark, self.sf_dir, "fx_" + name)
        self.__dict__[name] = view          # plans only, no data
        return view

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pages(self) -> DataFrame:
        return captures.pages(spark_view(self.spark, self.sf_dir, "fx_pages"))

    @cached_property
    def requests(self) -> DataFrame:
        return captures.requests(spark_view(self.spark, self.sf_dir, "fx_requests"))

    @cached_property
    def options(self) -> DataFrame:
        return self.scans.select("scan_id", captures.merged_options(F.col("options_json")).alias("opt"))

    @cached_property
    def captures(self) -> scan_plan.Captures:
        return scan_plan.Captures(
            scans=self.scans, pages=self.pages, as_of=AS_OF, cookies=self.cookies,
            storage=self.storage, console=self.console, requests=self.requests,
            robots=self.robots, assets=self.assets, responses=self.responses,
            map_responses=self.map_responses, options=self.options)

    @cached_property
    def findings(self) -> DataFrame:
        """Written once, read by every count, scenario and report part."""
        return cut(scan_plan.site_scan(self.captures))

    @cached_property
    def inventory(self) -> DataFrame:
        return scripts.script_inventory(self.requests, self.scans,
                                        scripts.script_findings(self.pages, ("missing_sri",)))

    @cached_property
    def scan_counts(self) -> DataFrame:
        return fi.severity_counts(self.scans, self.findings, self.pages, self.requests)

    @cached_property
    def documents_as_bodies(self) -> DataFrame:
        return content.text_bodies(self.content, "content", "document")

    @cached_property
    def bodies(self) -> DataFrame:
        """Page markup and documents together."""
        return content.page_bodies(self.pages).unionByName(self.documents_as_bodies)

    @cached_property
    def review_analysed(self) -> tuple[DataFrame, DataFrame]:
        return cr.analysed(self.review_files)

    @cached_property
    def review_findings(self) -> DataFrame:
        """For a query that reads them more than once."""
        return review_plan.review_findings(self.reviews, self.review_files, REVIEW_AS_OF, again=True, made=self.review_analysed)

    @cached_property
    def review_findings_short(self) -> DataFrame:
        """The same rows without summaries and snippets, for a query that reads them more than once."""
        return review_plan.review_findings(self.reviews, self.review_files, REVIEW_AS_OF, texts=False, again=True)

    @cached_property
    def review_findings_once(self) -> DataFrame:
        """The same rows without summaries and snippets, for a query that reads them once: they aren't
        written before."""
        return review_plan.review_findings(self.reviews, self.review_files, REVIEW_AS_OF, texts=False)

    @cached_property
    def review_facts(self) -> DataFrame:
        return cr.review_facts(cr.file_facts(self.review_files))


def _content(*groups: str, rules_=None, pages_only=False):
    def run(v: Views) -> DataFrame:
        bodies = content.page_bodies(v.pages) if pages_only else v.bodies
        return content.content_findings(bodies, groups, rules_).select(SHOW)
    return run


def _values(v: Views) -> DataFrame:
    """Candidate values of the password rules, distinct."""
    m = content.matches(v.bodies, ("passwords",))
    return m.select("value").distinct()


def _file_rule(name: str):
    return lambda v: rules.file_findings(v.review_files, (name,)).select(RULE)


def _workflow(name: str):
    return lambda v: cr.workflow_findings(v.reviews, v.review_facts, REVIEW_AS_OF, (name,)).select(
        "review_id", "rule_id", "severity", "file_path", "snippet", "score_impact")


def _scenario(name: str):
    return lambda v: sc.scenarios(v.findings, v.inventory, (name,)).select(
        "scan_id", "scenario_type", "impact", "confidence", "score", "n_findings")


def _lines(v: Views) -> DataFrame:
    return P.with_lines(v.review_files)


def _report_view(report: DataFrame, key: str, sections: str = "section") -> DataFrame:
    get = lambda *paths_: F.coalesce(*[F.get_json_object("body", p) for p in paths_])
    return report.select(
        key, sections, "k0", "k1", "k2",
        get("$.id", "$.scanId", "$.ruleId", "$.origin").alias("id"),
        get("$.source", "$.contentType", "$.targetUrl", "$.url", "$.impact").alias("fact"),
        get("$.findingsCount", "$.scriptCount", "$.pagesScanned", "$.rank").alias("number"))


QUERIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f
    return add


# ---- sources ----------------------------------------------------------------

@query("page_source")
def _(v):
    return captures.stored_pages(v.pages).select(
        "scan_id", "page_id", "url", "title", F.length("html_snapshot").alias("n_chars"),
        F.md5("html_snapshot").alias("html_md5"))


@query("request_source")
def _(v):
    return v.requests.select("request_id", "scan_id", "page_id", "url", "resource_type",
                             F.coalesce(F.size("response_headers"), F.lit(0)).alias("n_headers"))


@query("page_storage_items")
def _(v):
    """Web storage as the pages carry it, with the findings on it counted."""
    items = captures.storage_items(v.page_storage)
    found = clientstate.storage_findings(items).groupBy("page_id", "det_ord", "item_ord").agg(
        F.count("*").alias("n_findings"))
    det = F.when(F.col("storage_type") == "localStorage", fi.DET["localStorage"]).otherwise(fi.DET["sessionStorage"])
    return items.withColumn("det_ord", det).join(found, ["page_id", "det_ord", "item_ord"], "left").select(
        "scan_id", "page_id", "url", "storage_type", "item_ord", "key", "value",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


@query("page_content_type")
def _(v):
    return captures.pages(v.pages.drop("headers")).select("scan_id", "page_id", "content_type")


@query("international_hosts")
def _(v):
    """Every word of the documents that has a letter beyond ASCII, as the name of a host."""
    named = U.with_normalized(v.labels.withColumn("raw", F.concat(F.lit("shop."), "word", F.lit(".example"))), "raw", "url")
    return named.select("word", "url")


@query("asset_store")
def _(v):
    """Assets under two addresses each, in two runs: every body is scanned once."""
    store = AssetStore(v.spark, f"{checkpoint_dir(v.spark)}/asset-store-{uuid.uuid4().hex}")
    store.add(v.assets)
    store.add(v.asset_copies)
    return store.findings(v.asset_copies).select(*fi.ORDER, "severity", "category", "title", "asset_url", "evidence", "confidence")


@query("pr_normalize")
def _(v):
    reviews, files = captures.normalize_pull_requests(v.pr_payloads)
    return files.join(reviews, "review_id").select(
        "review_id", "title", "author", "head_ref", "base_ref", "head_sha", "reviewer_assigned",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "file_ord", "path",
        "status", "additions", "deletions", "patch")


@query("scan_options")
def _(v):
    return v.options.select("scan_id", *[F.col("opt")[c].alias(c) for c in (
        "inspectCookies", "searchSecrets", "inspectNetworkRequests", "checkConsoleErrors",
        "passiveEndpointCheck", "maxPages", "maxDepth")])


@query("ingestion_report")
def _(v):
    pages = captures.stored_pages(v.pages)
    return _report_view(reports.ingestion_report(
        v.scans, v.findings, pages, v.requests, v.inventory, v.scan_counts), "scan_id")


@query("scan_export")
def _(v):
    return _report_view(reports.scan_export(
        v.scans, v.findings, captures.stored_pages(v.pages)), "scan_id")


@query("review_report")
def _(v):
    f = v.review_findings
    report = reports.review_report(
        v.reviews, review_plan.stored_findings(f),
        review_plan.review_summary(v.reviews, v.review_files, f, REVIEW_AS_OF, v.review_analysed[1])
        .drop("checks_status"), cr.focus_files(f))
    get = lambda p: F.get_json_object("body", p)
    return report.select("review_id", "section", F.coalesce(
        get("$.ruleId"), get("$.summary.mergeRecommendation")).alias("verdict"),
        F.coalesce(get("$.evidence.canReveal"), get("$.workflow.prSize")).alias("fact"),
        F.coalesce(get("$.evidence.snippet"), get("$.focusFiles[0].path")).alias("text"))


@query("pr_quarantine")
def _(v):
    """Saved answers, some of them cut off, empty or wrapped: every row is sound or rejected."""
    n, payload = F.col("review_id"), F.col("payload")
    raw = v.pr_payloads.withColumn("payload", F.when(n % 7 == 0, F.expr("left(payload, length(payload) - 9)"))
                                   .when(n % 11 == 0, " ").when(n % 13 == 0, F.concat(F.lit("["), payload, F.lit("]")))
                                   .otherwise(payload))
    sound, rejected = captures.quarantine(raw)
    reviews, _ = captures.normalize_pull_requests(sound)
    return reviews.select("review_id", F.lit("sound").alias("reason"), "author").unionByName(
        rejected.select("review_id", "reason", F.lit(None).cast("string").alias("author")))


@query("scan_documents")
def _(v):
    """Pieces of the nested documents: what stands where, and which pieces start with a comma."""
    pieces = documents.scan_documents(reports.ingestion_report(
        v.scans, v.findings, captures.stored_pages(v.pages), v.requests, v.inventory, v.scan_counts))
    listed = F.col("section").isin("finding", "page", "request", "script_domain")
    return pieces.where(listed).groupBy("scan_id", "section").agg(
        F.count_if(F.col("edge") == documents.ELEMENT).alias("elements"),
        F.count_if((F.col("edge") == documents.ELEMENT) & F.col("text").startswith(",")).alias("commas"),
        F.count_if(F.col("edge") != documents.ELEMENT).alias("brackets"))


@query("review_store")
def _(v):
    """All changes reviewed by two rules, those with failing checks again by one of them."""
    store = ReviewStore(v.spark, f"{checkpoint_dir(v.spark)}/review-store-{uuid.uuid4().hex}", buckets=16)
    store.commit(rules.file_findings(v.review_files, ("todo", "console_log")), v.reviews, "first")
    again = v.reviews.where("checks_status = 'fail'")
    store.commit(rules.file_findings(v.review_files, ("todo",)), again, "second")
    store.compact(batches=2)
    return store.read().select("review_id", "file_ord", "rule_id", "severity", "snippet")


# ---- addresses and markup ---------------------------------------------------

@query("url_normalize")
def _(v):
    raw = (F.when(F.col("page_id") % 3 == 0, F.col("url"))
           .when(F.col("page_id") % 3 == 1, F.concat(
               F.lit(" "), F.regexp_replace("url", "^https?://", ""), F.lit(" ")))
           .otherwise(F.concat(F.replace("url", F.lit("http"), F.lit("HTTP")), F.lit("/"))))
    df = v.table("pages").select("page_id", raw.alias("raw"))
    return U.with_normalized(df, "raw", "normalized").select("page_id", "normalized")


@query("url_origin")
def _(v):
    df = U.with_url(v.requests, "url", "u")
    return df.groupBy(F.col("u")["origin"].alias("origin")).agg(F.count("*").alias("n"))


@query("url_same_origin")
def _(v):
    df = U.with_url(v.requests, "url", "u").join(
        v.scans.select("scan_id", F.col("origin").alias("own")), "scan_id")
    same = F.coalesce(F.col("u")["origin"] == F.col("own"), F.lit(False))
    return df.groupBy("scan_id", same.alias("same_origin")).agg(F.count("*").alias("n"))


@query("url_valid")
def _(v):
    k = F.col("page_id") % 5
    raw = (F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("ftp://"), F.col("url")))
           .when(k == 2, F.lit("not an address")).when(k == 3, F.lit("http://"))
           .otherwise(F.concat("url", F.lit("%zz y"))))
    df = U.with_url(v.table("pages").select("page_id", raw.alias("raw")), "raw", "u")
    return df.select("page_id", "raw", F.col("u").isNotNull().alias("valid"))


@query("url_canonical")
def _(v):
    df = U.with_canonical(v.links, "link", "canonical")
    return df.groupBy("canonical").agg(F.count("*").alias("n_links"))


@query("link_destructive")
def _(v):
    return v.links.groupBy("scan_id").agg(
        F.count_if(U.is_destructive(F.col("link"))).alias("n_destructive"),
        F.count("*").alias("n_links"))


@query("link_skippable")
def _(v):
    link = F.when(F.col("link_ord") == 4, F.concat(F.lit("MailTo:"), F.col("link"))).when(
        F.col("link_ord") == 3, F.concat(F.lit("data:"), F.col("link"))).otherwise(F.col("link"))
    return v.links.groupBy("scan_id", "link_ord").agg(
        F.count_if(U.is_skippable(link)).alias("n_skippable"))


@query("pr_url_parse")
def _(v):
    return U.with_pull_request(v.reviews, "pr_url").select(
        "review_id", "owner", "repo", "pr_number", "pr_url_error")


def _crawl_scans(v):
    return U.with_url(v.crawls, "start_url", "u").withColumn("scan_origin", F.col("u")["origin"])


@query("link_scope")
def _(v):
    return frontier.scoped_links(v.links, _crawl_scans(v)).select(
        "scan_id", "src_url", "link_ord", "link")


@query("html_links")
def _(v):
    return H.links(v.pages, [*fi.KEYS]).select(*fi.KEYS, "ord", "link")


@query("url_resolve")
def _(v):
    df = U.with_url(H.links(v.pages, [*fi.KEYS]), "link", "u")
    return df.groupBy("scan_id", F.col("u")["origin"].alias("origin")).agg(
        F.count("*").alias("n_links"), F.countDistinct(F.col("u")["path"]).alias("n_paths"))


@query("html_inline_scripts")
def _(v):
    return v.pages.select(*fi.KEYS, F.posexplode(H.inline_scripts(F.col("html"))).alias("i", "body"))


@query("html_linked_scripts")
def _(v):
    return H.linked_scripts(v.pages, [*fi.KEYS]).select(*fi.KEYS, "ord", "script_url")


@query("html_title")
def _(v):
    return v.pages.select("page_id", H.title(F.col("html")).alias("title"))


@query("html_script_tags")
def _(v):
    return H.script_tags(v.pages, [*fi.KEYS]).select(
        *fi.KEYS, "tag_ord", "src", "script_url", "has_integrity")


# ---- text -------------------------------------------------------------------

@query("text_truncate")
def _(v):
    return v.table("documents").select("doc_id", X.truncate(F.col("text")).alias("snippet"))


@query("evidence_truncate")
def _(v):
    return v.table("documents").select(
        "doc_id", X.truncate(F.col("text"), reports.EVIDENCE_LENGTH).alias("evidence"))


@query("redact_value")
def _(v):
    df = U.with_url(v.requests, "url", "u").select(
        "request_id", F.explode(U.query_pairs(F.col("u")["search"])).alias("p"))
    return df.select("request_id", F.col("p")["name"].alias("name"),
                     X.redact_value(F.col("p")["value"]).alias("redacted"))


@query("redact_snippet")
def _(v):
    df = v.content.select("doc_id", X.redact_snippet(F.col("content")).alias("r"))
    return df.select("doc_id", F.md5(F.col("r")["redacted_snippet"]).alias("redacted_md5"),
                     F.col("r")["is_redacted"].alias("is_redacted"))


@query("redact_policy")
def _(v):
    f = rules.file_findings(v.review_files)
    return f.groupBy("category", "rule_id", X.needs_redaction(
        F.col("category"), F.col("rule_id")).alias("redact")).agg(F.count("*").alias("n"))


@query("redact_process")
def _(v):
    f = rules.file_findings(v.review_files, ("route", "secret", "console_log", "todo"))
    return X.process_snippet(f, "snippet", "category", "rule_id").select(
        "review_id", "file_ord", "rule_id", "safe_snippet", "redacted_snippet",
        "revealed_snippet", "is_redacted")


@query("content_type")
def _(v):
    return v.requests.groupBy(
        "scan_id", responses.content_type(F.col("response_headers")).alias("content_type")).agg(
        F.count("*").alias("n"))


@query("match_snippet")
def _(v):
    return content.matches(v.bodies, ("endpoints",)).select(
        *fi.KEYS, "rule_ord", "pos", "value", "whole", "left", "right")


@query("is_placeholder")
def _(v):
    return _values(v).select("value", X.is_placeholder(F.col("value")).alias("placeholder"))


@query("entropy")
def _(v):
    return _values(v).select(
        "value", F.round(X.entropy(F.col("value")) * 10000).cast("bigint").alias("entropy_e4"),
        X.is_high_entropy(F.col("value")).alias("high"))


@query("pw_placeholder")
def _(v):
    return _values(v).select("value", X.is_password_placeholder(F.col("value")).alias("placeholder"),
                             X.is_trivial_password(F.col("value")).alias("trivial"))


@query("pw_classify")
def _(v):
    m = content.matches(v.bodies, ("passwords",)).select(
        "value", (F.col("rule_ord") >= 102).alias("uri")).distinct()
    m = m.withColumn("c", content.password_class(F.col("value"), F.col("uri")))
    return m.select("value", "uri", F.col("c")["severity"].alias("severity"),
                    F.col("c")["confidence"].alias("confidence"))


# ---- page rules -------------------------------------------------------------

for _name, _only in (("missing_headers", "missing"), ("powered_by", "powered_by"),
                     ("cors_wildcard", "cors")):
    QUERIES[_name] = lambda v, o=_only: responses.header_findings(v.pages, (o,)).select(SHOW)
for _name, _only in (("csp_script_rules", "script"), ("csp_object_src", "object"),
                     ("csp_missing_dirs", "missing"), ("csp_wildcards", "wildcard")):
    QUERIES[_name] = lambda v, o=_only: responses.policy_findings(v.pages, (o,)).select(SHOW)
for _name in ("httponly", "secure", "samesite", "longlived"):
    QUERIES["cookie_" + _name] = lambda v, o=_name: clientstate.cookie_findings(
        v.cookies, AS_OF, (o,)).select(SHOW)
for _name in ("tokens", "keys", "json"):
    QUERIES["storage_" + _name] = lambda v, o=_name: clientstate.storage_findings(
        v.storage, (o,)).select(SHOW)
for _name in ("missing_sri", "mixed_content"):
    QUERIES[_name] = lambda v, o=_name: scripts.script_findings(v.pages, (o,)).select(SHOW)
for _name in ("json", "admin", "config"):
    QUERIES["probe_" + _name] = lambda v, o=_name: probes.probe_findings(
        v.responses, (o,)).select(SHOW)
for _i, _name in enumerate(("stacktrace", "version", "devtools", "internal_url")):
    QUERIES["leak_" + _name] = _content("framework", rules_={"framework": (_i,)})
QUERIES["secrets_scan"] = lambda v: content.content_findings(v.bodies, ("secrets",)).unionByName(
    content.content_findings(content.storage_bodies(v.storage), ("secrets",))).select(SHOW)
QUERIES["next_public_env"] = _content("next_public")
QUERIES["pw_assignment"] = _content("passwords", rules_={"passwords": (0,)})
QUERIES["pw_env"] = _content("passwords", rules_={"passwords": (1,)})
QUERIES["pw_uri"] = _content("passwords", rules_={"passwords": tuple(range(2, 9))})
QUERIES["pw_scan"] = _content("passwords")
QUERIES["suspicious_endpoints"] = _content("endpoints")
QUERIES["sourcemap_refs"] = _content("sourcemaps")


@query("csp_directives")
def _(v):
    return responses.policy_directives(v.pages).select(
        *fi.KEYS, "directive", F.array_join("tokens", " ").alias("tokens"))


@query("cookie_auth")
def _(v):
    return v.cookies.groupBy("name", clientstate.is_auth_cookie(F.col("name")).alias("is_auth")).agg(
        F.count("*").alias("n"))


@query("cookie_flags")
def _(v):
    return v.cookies.select("cookie_ord", clientstate.cookie_flags(AS_OF).alias("flags"))


@query("cookie_summary")
def _(v):
    return clientstate.cookie_summary(v.cookies)


@query("console_leak")
def _(v):
    return clientstate.console_findings(v.console).select(SHOW)


@query("robots_paths")
def _(v):
    return addresses.robots_findings(v.robots).select(SHOW)


@query("sourcemap_exposed")
def _(v):
    f = content.bundle_findings(v.assets, scan_plan.script_references(v.pages),
                                v.map_responses, ("sourcemaps",))
    return f.filter(F.col("title") == "Source map file is publicly accessible").select(SHOW)


@query("url_params")
def _(v):
    pages = addresses.param_findings(scan_plan._page_addresses(v.pages), "page_url")
    requests = addresses.param_findings(scan_plan._request_addresses(v.requests), "request_url")
    return pages.unionByName(requests).select(SHOW)


@query("probe_filter")
def _(v):
    return probes.listed(v.responses).select(
        "scan_id", "path", "status", "preview", F.array_join("keys", ",").alias("keys"))


@query("probe_targets")
def _(v):
    return probes.probe_targets(v.scans)


@query("probe_summary")
def _(v):
    return probes.probe_summary(v.responses)


@query("bundle_scan")
def _(v):
    return content.bundle_findings(v.assets, scan_plan.script_references(v.pages),
                                   v.map_responses).select(SHOW)


@query("bundle_join")
def _(v):
    first = content.first_references(scan_plan.script_references(v.pages))
    return first.join(v.assets, "asset_url").select(
        *fi.KEYS, "asset_url", F.length("body").alias("n_chars"))


# ---- findings ---------------------------------------------------------------

@query("site_scan")
def _(v):
    return scan_plan.site_scan(v.captures).select(SHOW)


@query("gated_scan")
def _(v):
    return fi.gate(scan_plan.raw_findings(v.captures), v.options).groupBy("scan_id", "det_ord").agg(
        F.count("*").alias("n_findings"))


@query("finding_dedup")
def _(v):
    return fi.deduplicate(scan_plan.raw_findings(v.captures)).select(
        *fi.KEYS, *fi.ORDER, "category", "title", "url")


@query("finding_source")
def _(v):
    return v.findings.groupBy("scan_id", fi.finding_source(
        F.col("evidence"), F.col("category"), F.col("url")).alias("source")).agg(F.count("*").alias("n"))


@query("finding_filter")
def _(v):
    return fi.select_findings(v.findings, "high", "insecure_cookie").select(SHOW)


@query("finding_attrib")
def _(v):
    return fi.attribute(v.findings, captures.stored_pages(v.pages)).select(
        *fi.KEYS, *fi.ORDER, "page_url", "depth", "page_title")


@query("severity_counts")
def _(v):
    return v.scan_counts


@query("category_counts")
def _(v):
    return fi.category_counts(v.findings)


@query("findings_sorted")
def _(v):
    return fi.in_report_order(v.findings).select(
        *fi.KEYS, *fi.ORDER, "category", "severity", "severity_rank")


@query("inventory_sri")
def _(v):
    return scripts.origins_without_integrity(scripts.script_findings(v.pages, ("missing_sri",)))


@query("script_inventory")
def _(v):
    return v.inventory.select("scan_id", "origin", "host", "script_count", "insecure_loads", "has_sri",
                              F.array_join("example_urls", " ").alias("examples"))


@query("inventory_examples")
def _(v):
    return scripts.example_urls(scripts.third_party_requests(v.requests, v.scans)).select(
        "scan_id", "origin", F.array_join("example_urls", " ").alias("examples"))


for _key, _name in (("sc_public_data", "public_data_exposure"),
                    ("sc_auth_session", "auth_session_risk"),
                    ("sc_credentials", "credential_leakage"), ("sc_recon", "internal_recon"),
                    ("sc_supply_chain", "client_side_supply_chain_risk")):
    QUERIES[_key] = _scenario(_name)


@query("sc_score")
def _(v):
    return sc.scenarios(v.findings, v.inventory).select("scan_id", "scenario_type", "score")


@query("sc_ranked")
def _(v):
    return sc.scenarios(v.findings, v.inventory).select(
        "scan_id", "rank", "scenario_type", "title", "skill_level", "time_to_discover")


@query("sc_evidence")
def _(v):
    return sc.scenario_evidence(v.findings).select(
        "scan_id", "scenario_type", "category", "title", "url", "evidence_snippet")


@query("crawl_frontier")
def _(v):
    return frontier.crawl(v.crawls, v.links).select("scan_id", "url", "depth", "visit_rank")


@query("page_caps")
def _(v):
    return captures.page_caps(v.console, ["page_id"], ["ord"], 25).select("page_id", "ord", "type")


@query("request_cap")
def _(v):
    return captures.page_caps(v.requests, ["scan_id"], ["request_id"], 500).select(
        "scan_id", "request_id")


@query("recent_logs")
def _(v):
    return captures.page_caps(v.console, ["scan_id"], ["ord"], 200).select(
        "scan_id", "ord", "type", "text")


@query("recent_scans")
def _(v):
    return v.scans.orderBy(F.desc("scan_id")).limit(50).select("scan_id", "target_url", "status")


@query("recent_reviews")
def _(v):
    return v.reviews.orderBy(F.desc("updated_at"), F.desc("review_id")).limit(50).select(
        "review_id", "pr_url", "checks_status")


# ---- change review ----------------------------------------------------------

for _name in rules.FILE_RULES:
    QUERIES["rv_" + _name] = _file_rule(_name)
for _name in ("size", "reviewer", "stale", "checks"):
    QUERIES["rv_" + _name] = _workflow(_name)


@query("file_class")
def _(v):
    return v.review_files.groupBy("path", paths.file_class(F.col("path")).alias("file_class")).agg(
        F.count("*").alias("n"))


@query("file_flags")
def _(v):
    p = F.col("path")
    return v.review_files.groupBy(
        "path", paths.is_test(p).alias("is_test"), paths.is_logic(p).alias("is_logic"),
        paths.is_service(p).alias("is_service")).agg(F.count("*").alias("n"))


@query("patch_lines")
def _(v):
    return P.patch_lines(v.review_files).groupBy("review_id", "file_ord").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("sign") == "+").alias("n_added"),
        F.count_if(F.col("sign") == "-").alias("n_removed"),
        F.max("line_no").alias("last_line"))


@query("patch_text")
def _(v):
    return _lines(v).select("review_id", "file_ord", F.md5(P.patch_text(F.col("added"))).alias("text_md5"))


@query("line_nesting")
def _(v):
    levels = F.transform("added", P.nesting)
    return _lines(v).select("review_id", "file_ord", F.array_max(levels).alias("deepest"),
                            F.aggregate(levels, F.lit(0), lambda a, x: a + x).alias("braces"))


@query("patch_snippet")
def _(v):
    return P.snippets(v.review_files, rules.CONDITIONAL_SNIPPET, rules.WORDS[rules.CONDITIONAL][0])


@query("patch_line_numbers")
def _(v):
    return P.line_numbers(v.review_files).groupBy("review_id", "file_ord").agg(
        F.count("*").alias("n_lines"), F.min("new_line").alias("first_line"),
        F.max("new_line").alias("last_line"), F.sum("new_line").alias("line_sum"))


@query("naming_plural")
def _(v):
    return rules.plural_conflicts(v.review_files).select(
        "review_id", "file_ord", F.array_join("conflicts", ",").alias("conflicts"))


@query("rv_term_drift")
def _(v):
    return cr.term_drift(v.review_facts).select(
        "review_id", "rule_ord", "severity", "file_path", "snippet", "score_impact")


@query("rv_logic_change")
def _(v):
    return cr.file_facts(v.review_files).filter("logic_changed").select("review_id", "file_ord", "path")


@query("rv_no_tests")
def _(v):
    return cr.missing_tests(v.review_facts).select(
        "review_id", "rule_id", "severity", "summary", "file_path", "score_impact")


@query("rv_untested_service")
def _(v):
    return cr.untested_services(cut(cr.file_facts(v.review_files))).select(
        "review_id", "rule_id", "severity", "summary", "file_path", "score_impact")


@query("rv_notes")
def _(v):
    return cr.workflow_summary(v.reviews, v.review_facts, REVIEW_AS_OF).select(
        "review_id", "pr_size", "stale", "reviewer_assigned", F.array_join("notes", " | ").alias("notes"))


@query("rv_totals")
def _(v):
    return cr.totals(v.review_files)


@query("rv_anatomy")
def _(v):
    return cr.anatomy(v.reviews, v.review_facts)


@query("rv_score")
def _(v):
    return cr.score(v.reviews, v.review_findings_once)


@query("rv_focus_files")
def _(v):
    return cr.focus_files(v.review_findings_once)


@query("rv_summary")
def _(v):
    return cr.finding_summary(v.reviews, v.review_findings_once)


@query("rv_counts")
def _(v):
    return cr.counts(v.reviews, v.review_findings_once).withColumn(
        "categories", F.array_join("categories", ","))


@query("rv_sorted")
def _(v):
    return cr.in_review_order(v.review_findings_short).select(
        "review_id", *cr.ORDER, "rule_id", "severity", "severity_rank")


@query("rv_exposure_top")
def _(v):
    return cr.exposure_top(v.review_findings_short).withColumn("titles", F.array_join("titles", " | "))


@query("checks_rollup")
def _(v):
    return cr.checks_rollup(v.reviews, v.check_runs)


@query("enrich_overlay")
def _(v):
    f = cut(rules.file_findings(v.review_files, ("bypass", "route")))       # read twice, made once
    wording = cr.enrichment_requests(f).select(
        "review_id", "rule_id", "file_path", F.col("file_ord").alias("ord"),
        F.when(F.col("review_id") % 2 == 0, F.concat(
            F.lit("Look at "), F.col("file_ord").cast("string"))).otherwise("").alias("summary"),
        F.lit(None).cast("string").alias("why_flagged"), F.lit("").alias("suggestion"))
    return cr.overlay(f, wording).select("review_id", "file_ord", "rule_id", "summary")
