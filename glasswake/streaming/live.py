"""The same rules over arriving captures (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from glasswake.operators.findings import KEYS
from glasswake.plans.change_review import review_findings, startable, stored_findings
from glasswake.sources.sinks import replace_reviews


def read_arriving(spark: SparkSession, path: str, schema: StructType,
                  files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def scan_batches(arriving: DataFrame, rule: Callable[[DataFrame], DataFrame], out: str,
                 checkpoint: str) -> DataStreamWriter:
    """Incremental scan: a rule runs on each batch (first-wins stays inside the batch)
    and its findings are written under the batch id, so a retried batch overwrites
    its own output and nothing is counted twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (rule(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))
    return arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def live_counts(findings: DataFrame) -> DataFrame:
    """Running counters per scan and severity (use output mode update or complete)."""
    return findings.groupBy("scan_id", "severity").agg(F.count("*").alias("n_findings"))


def first_seen(findings: DataFrame, time: str, within: str) -> DataFrame:
    """Duplicate suppression across batches; state is dropped after ``within``."""
    key = F.substring("evidence", 1, 50)
    return (findings.withColumn("evidence_key", key).withWatermark(time, within)
            .dropDuplicatesWithinWatermark([*KEYS, "category", "url", "evidence_key"]))


def review_batches(work: DataFrame, files: Callable[[DataFrame], DataFrame], as_of: str,
                   out: str, checkpoint: str) -> DataStreamWriter:
    """Reviews that may start are run batch by batch; results replace older ones."""
    def write(batch: DataFrame, _: int) -> None:
        todo = startable(batch, "review")
        found = review_findings(todo, files(todo), as_of)
        replace_reviews(stored_findings(found), todo, out)
    return work.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
