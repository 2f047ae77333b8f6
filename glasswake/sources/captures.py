"""Readers: captured pages and requests, saved pull-request payloads, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from glasswake.functions.bind import bind
from glasswake.functions.html import title
from glasswake.operators.findings import DEFAULT_OPTIONS

STORED_HTML = 100_000          # fixed value: characters of markup kept in the page table

PAGE_SCHEMA = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("status_code", T.IntegerType()), T.StructField("html", T.StringType()),
    T.StructField("headers_json", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("storage_json", T.StringType()),
])
REQUEST_SCHEMA = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("page_id", T.LongType()),
    T.StructField("request_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("resource_type", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_headers_json", T.StringType()),
    T.StructField("request_headers_json", T.StringType()),
    T.StructField("response_snippet", T.StringType()),
])
STORAGE = ("localStorage", "sessionStorage")        # fixed values: members of storage_json
PR_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    T.StructField("head", T.StructType([T.StructField("ref", T.StringType()),
                                        T.StructField("sha", T.StringType())])),
    T.StructField("base", T.StructType([T.StructField("ref", T.StringType())])),
    T.StructField("updated_at", T.StringType()),
    T.StructField("requested_reviewers", T.ArrayType(T.StructType([
        T.StructField("login", T.StringType())]))),
    T.StructField("files", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("additions", T.IntegerType()), T.StructField("deletions", T.IntegerType()),
        T.StructField("patch", T.StringType())]))),
])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages(spark.read.schema(PAGE_SCHEMA).parquet(path))


def pages(raw: DataFrame) -> DataFrame:
    """Headers parsed to a map, and the content type taken from them where it was not captured;
    the markup stays whole for the rules."""
    df = raw.withColumn("headers", F.from_json("headers_json", "map<string,string>"))
    named = F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == "content-type"))
    given = [F.col("content_type")] if "content_type" in raw.columns else []
    return df.withColumn("content_type", F.coalesce(*given, F.get(named, F.lit(0))))


def storage_items(pages: DataFrame) -> DataFrame:
    """Web storage items from the pages' storage_json, in the order of each object; ``item_ord``
    counts within a page and kind of storage. A page whose text is NULL or no JSON has none;
    a name that occurs twice, which no browser writes, is two items."""
    kinds = F.from_json("storage_json", ", ".join(f"{s} map<string,string>" for s in STORAGE))
    none = F.create_map().cast("map<string,string>")
    of = lambda kind: F.transform(F.map_entries(F.coalesce(kinds[kind], none)), lambda e, i: F.struct(
        i.cast("bigint").alias("item_ord"), F.lit(kind).alias("storage_type"),
        e["key"].alias("key"), e["value"].alias("value")))
    items = F.flatten(F.array(*map(of, STORAGE)))
    rows = pages.where("storage_json IS NOT NULL")
    return rows.select("scan_id", "page_id", "url", F.explode(items).alias("i")).select(
        "scan_id", "page_id", "url", "i.*")


def stored_pages(pages: DataFrame, limit: int = STORED_HTML) -> DataFrame:
    """What the page table keeps: a title and a snapshot of the markup."""
    return pages.withColumn("title", title(F.col("html"))).withColumn(
        "html_snapshot", F.left("html", F.lit(limit))).drop("html")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return requests(spark.read.schema(REQUEST_SCHEMA).parquet(path))


def requests(raw: DataFrame) -> DataFrame:
    """Headers of both directions parsed to maps, where they were captured."""
    df = raw
    for kind in ("response", "request"):
        if f"{kind}_headers_json" in raw.columns:
            df = df.withColumn(f"{kind}_headers", F.from_json(f"{kind}_headers_json", "map<string,string>"))
    return df


RAW_PULL_REQUESTS = "review_id bigint, pr_url string, payload string"


def read_pull_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, files) from folders of saved API answers, one JSON object per line with
    review_id and payload. Answers that cannot be read are left to ``quarantine``."""
    return normalize_pull_requests(quarantine(read_raw_pull_requests(spark, path))[0])


def read_raw_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """The saved answers as they are; ``broken`` has the text of lines that are no such object."""
    return (spark.read.schema(RAW_PULL_REQUESTS + ", broken string")
            .option("columnNameOfCorruptRecord", "broken").json(path))


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound, rejected): rows of review_id, pr_url, payload whose payload can be read, and the
    others with a ``reason``. No row is in both or in neither.

    Reasons: ``line`` (the saved line is broken), ``review`` (no review_id), ``empty`` (no
    payload), ``malformed`` (no JSON object, or a field of another type than the API's).
    """
    schema = T.StructType([*PR_SCHEMA.fields, T.StructField("broken_", T.StringType())])
    parsed = F.from_json("payload", schema, {"columnNameOfCorruptRecord": "broken_"})
    line = F.col("broken").isNotNull() if "broken" in raw.columns else F.lit(False)
    checked = bind(raw, "reason", F.when(line, "line").when(F.col("review_id").isNull(), "review")
                   .when(F.trim(F.coalesce("payload", F.lit(""))) == "", "empty")
                   .when(~F.ltrim("payload").startswith("{") | parsed["broken_"].isNotNull(), "malformed"))
    keep = ["review_id", "pr_url", "payload"]
    kept = [*keep, "broken"] if "broken" in raw.columns else keep
    return checked.where("reason IS NULL").select(*keep), checked.where("reason IS NOT NULL").select(*kept, "reason")


def write_rejected(rejected: DataFrame, path: str, run_id: str) -> None:
    """Rejected rows by run and reason; a retried run replaces its own."""
    (rejected.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "reason").parquet(path))


def normalize_pull_requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, files) from rows of review_id, pr_url, payload (JSON text)."""
    df = raw.withColumn("p", F.from_json("payload", PR_SCHEMA))
    p = F.col("p")
    text = lambda c: F.coalesce(c, F.lit(""))
    reviews = df.select(
        "review_id", "pr_url", text(p["title"]).alias("title"),
        text(p["user"]["login"]).alias("author"), text(p["head"]["ref"]).alias("head_ref"),
        text(p["base"]["ref"]).alias("base_ref"), p["head"]["sha"].alias("head_sha"),
        (F.coalesce(F.size(p["requested_reviewers"]), F.lit(0)) > 0).alias("reviewer_assigned"),
        p["updated_at"].try_cast("timestamp").alias("updated_at"))
    files = df.select("review_id", F.posexplode(p["files"]).alias("file_ord", "f")).select(
        "review_id", "file_ord", F.col("f")["filename"].alias("path"),
        F.col("f")["status"].alias("status"), F.col("f")["additions"].alias("additions"),
        F.col("f")["deletions"].alias("deletions"), F.col("f")["patch"].alias("patch"))
    return reviews, files


def merged_options(options_json: Column) -> Column:
    """Options over defaults as one struct; malformed text means all defaults."""
    kind = {bool: "boolean", int: "int"}
    schema = ", ".join(f"{k} {kind[type(v)]}" for k, v in DEFAULT_OPTIONS.items())
    given = F.from_json(options_json, schema)
    return F.struct(*[F.coalesce(given[k], F.lit(v)).alias(k) for k, v in DEFAULT_OPTIONS.items()])


def page_caps(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Capture limits per page (console lines, requests).  Only for replaying a
    limited capture; the rules never need it."""
    from glasswake.operators.findings import first_per
    return first_per(rows, keys, order, n)
