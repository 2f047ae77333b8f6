"""Findings of script assets kept by the digest of their body.

The same bundle is served under many addresses and scanned again in every run. Here a body is
scanned once for a set of rules, whatever its addresses; later runs look its findings up:

    results/token=<t>/     findings of bodies that were new to a run, by digest
    scanned/token=<t>/     their digests, written after the findings

A digest in ``scanned`` always has all its findings in ``results`` of the same token, so a run
that stops between the two leaves rows nobody reads. Two runs that meet may both scan a body;
the smallest token is read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from glasswake.operators.content import GROUPS, bundle_bodies, content_findings
from glasswake.operators.findings import ORDER

FOUND = ["digest", *ORDER, "severity", "category", "title", "description", "evidence", "confidence"]


def with_digest(assets: DataFrame) -> DataFrame:
    return assets.withColumn("digest", F.sha2("body", 256))


class AssetStore:
    """Findings by body below ``path``. ``rules`` names the version of the rules; another one
    starts anew beside it."""

    def __init__(self, spark: SparkSession, path: str, rules: str = "1", only: tuple[str, ...] = GROUPS):
        self.spark, self.only = spark, only
        self.path = f"{path.rstrip('/')}/rules={rules}"

    def _read(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":     # an unreadable store is not an empty one
                raise
            return None

    def scanned(self) -> DataFrame | None:
        """digest, token: one row per body."""
        known = self._read("scanned")
        return None if known is None else known.groupBy("digest").agg(F.min("token").alias("token"))

    def add(self, assets: DataFrame) -> str:
        """Scan the bodies of ``assets`` (asset_url, body) that are new; returns the token of
        the run. NULL bodies are passed over. Of equal bodies the one with the smallest address
        is scanned; only addresses and digests are compared to find it."""
        token = uuid.uuid4().hex
        address = F.coalesce("asset_url", F.lit("")).alias("asset_url")
        bodies = with_digest(assets.select(address, "body")).where("body IS NOT NULL")
        new = bodies.select("digest", "asset_url").groupBy("digest").agg(F.min("asset_url").alias("asset_url"))
        known = self.scanned()
        if known is not None:
            new = new.join(known, "digest", "left_anti")
        picked = f"{self.path}/picked/token={token}"
        new.write.parquet(picked)
        chosen = self.spark.read.parquet(picked)
        # by address as well: the copies of a frequent body do not meet in one task
        one = bodies.join(chosen, ["digest", "asset_url"], "left_semi")
        # the digest stands for the address in every text until a run asks for its own addresses
        named = one.select(F.col("digest").alias("asset_url"), "body")
        found = content_findings(bundle_bodies(named), self.only).withColumnRenamed("asset_url", "digest")
        # an address that is listed twice with one body was scanned twice
        found.select(*FOUND).dropDuplicates().write.parquet(f"{self.path}/results/token={token}")
        chosen.select("digest").write.parquet(f"{self.path}/scanned/token={token}")
        return token

    def findings(self, assets: DataFrame) -> DataFrame:
        """Findings of each distinct (address, body) of ``assets``, under its own address. All
        bodies have to be added before; those that were not have no rows."""
        known = self.scanned()
        if known is None:
            raise ValueError("add the assets first")
        rows = self._read("results").join(known, ["digest", "token"], "left_semi").drop("token")
        urls = with_digest(assets).where("body IS NOT NULL").select("digest", "asset_url").distinct()
        out = rows.join(urls, "digest")
        own = lambda c: F.replace(F.col(c), F.col("digest"), F.coalesce("asset_url", F.lit("")))
        return out.withColumn("title", own("title")).withColumn("evidence", own("evidence"))
