"""Tables that streams keep up to date, exact whatever the order and number of deliveries.

Each batch writes what it adds under its own number, so a batch that is delivered again
replaces its own rows and nothing else; what the batches add up to is merged when the table
is read. ``fold`` sums the older batches up into a snapshot, which a late repetition of one
of them no longer changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from glasswake.operators.findings import deduplicate

Merge = Callable[[DataFrame], DataFrame]


def sum_counts(rows: DataFrame) -> DataFrame:
    """Findings per scan and severity, from findings counted by batch."""
    return rows.groupBy("scan_id", "severity").agg(F.sum("n_findings").alias("n_findings"))


def count_findings(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "severity").agg(F.count("*").alias("n_findings"))


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}/batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":      # an unreadable table is not an empty one
            raise
        return None


def read_table(spark: SparkSession, path: str, merge: Merge) -> DataFrame | None:
    """The latest snapshot and the batches after it, merged; None before the first batch."""
    batches, folded = _read(spark, path, "batches"), _read(spark, path, "snapshots")
    if batches is None:
        return None
    if folded is None:
        return merge(batches.drop("batch"))
    last = folded.agg(F.max("batch")).first()[0]
    later = batches.where(F.col("batch") > last).unionByName(folded.where(F.col("batch") == last))
    return merge(later.drop("batch"))


def fold(spark: SparkSession, path: str, upto: int, merge: Merge) -> None:
    """Merge all batches up to ``upto`` into a snapshot. The snapshot is one write, visible as a
    whole; the batches stay where they are and are no longer read."""
    batches, folded = _read(spark, path, "batches"), _read(spark, path, "snapshots")
    if batches is None:
        return
    rows = batches.where(F.col("batch") <= upto)
    if folded is not None:
        last = folded.agg(F.max("batch")).first()[0]
        if last >= upto:
            return
        rows = rows.where(F.col("batch") > last).unionByName(folded.where(F.col("batch") == last))
    merge(rows.drop("batch")).write.mode("overwrite").parquet(f"{path}/snapshots/batch={upto}")


def count_batches(arriving: DataFrame, rule: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Live counters of findings per scan and severity; read with ``counters``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(count_findings(rule(batch)), batch_id, path)
    return arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def counters(spark: SparkSession, path: str) -> DataFrame | None:
    return read_table(spark, path, sum_counts)


def winner_batches(arriving: DataFrame, rule: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Incremental scan in which the first finding of a kind wins across batches, by the order of
    the findings and not of their arrival. A batch keeps its own winners; read with ``winners``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(deduplicate(rule(batch)), batch_id, path)
    return arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def winners(spark: SparkSession, path: str) -> DataFrame | None:
    return read_table(spark, path, deduplicate)
