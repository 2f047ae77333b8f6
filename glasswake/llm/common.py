"""Shared folder, tables that cut lineage, and prefix sums over ordered rows."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WHITE = r"\x20\x09-\x0D"
ROWS_PER_BUCKET = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a temporary folder is
    used, on one machine only; a cluster has to name a folder that all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", path := tempfile.mkdtemp(prefix="glasswake-"))
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/glasswake-llm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later steps neither
    recompute it nor lose it with an executor. The folder's owner removes old tables."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, size: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // size))


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column | str],
               value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before.

    ``bucket`` must not contradict ``order``. Only one sum per bucket is ordered over a
    whole group; the rows are ordered within their bucket, so a group that holds most
    rows is spread over many tasks.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cond = F.lit(True)
    for c in [*group, bucket]:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = df.alias("a").join(sums.alias("b"), cond).select("a.*", "b.__base")
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__base")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus
