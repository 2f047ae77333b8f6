"""Writers.  Findings append by day; review findings replace what they supersede."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from glasswake.plans.lineage import cut

BUCKETS = 64


def append_findings(findings: DataFrame, path: str, scan_date: str, run_id: str) -> None:
    """Add the findings of one run.  A retried run replaces its own rows only."""
    (findings.withColumn("scan_date", F.lit(scan_date)).withColumn("run_id", F.lit(run_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("scan_date", "run_id").parquet(path))


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def replace_reviews(findings: DataFrame, reviews: DataFrame, path: str,
                    buckets: int = BUCKETS) -> None:
    """Delete-then-insert per review without a transactional table.

    The store is partitioned by a hash bucket of review_id.  Only buckets that hold a
    reviewed id are rewritten (dynamic partition overwrite): their other reviews are
    carried over by an anti join, and a review that now has no findings loses its old
    ones.  Re-running after a lost job gives the same result.
    """
    spark = findings.sparkSession
    bucket = F.pmod(F.xxhash64("review_id"), F.lit(buckets)).cast("int")
    fresh = findings.withColumn("bucket", bucket)
    touched = reviews.select("review_id").distinct().withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":    # an unreadable store must not be overwritten
            raise
        old = None                              # first run: nothing to replace
    if old is not None:
        # at most ``buckets`` distinct integers, so they can prune partitions directly
        hit = [r[0] for r in touched.select("bucket").distinct().collect()]
        kept = old.filter(F.col("bucket").isin(hit)).join(
            touched.select("review_id"), "review_id", "left_anti")
        fresh = fresh.unionByName(kept)
        # a bucket that ends up empty has no rows to overwrite it with: write a stub
        stub = touched.select("bucket").distinct()
        for f in fresh.schema.fields:
            if f.name != "bucket":
                stub = stub.withColumn(f.name, F.lit(None).cast(f.dataType))
        fresh = fresh.unionByName(stub)
        fresh = cut(fresh)                      # the old files are replaced below
    # rebalance keeps files large but splits the bucket of a hot review
    (fresh.hint("rebalance", F.col("bucket")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def read_reviews(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("review_id IS NOT NULL")
