"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession

from glasswake.llm import (alignment, digest, licenses, lm, mixing, overlap, packing, pages, quality, simhash, tokens,
                           toxicity, whitening)
from glasswake.llm.common import table

CAPACITY = 2048
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_workers(run):
    """``run`` with this library's folder on the import path of Python workers, for sessions that
    were started without it (a cluster gets the library with --py-files)."""

    @functools.wraps(run)
    def started(spark: SparkSession, *args):
        path = spark.sparkContext.environment.get("PYTHONPATH", "")
        if HOME not in path.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, HOME]))
        return run(spark, *args)

    return started


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@on_workers
def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_to_files(table(spark, sf_dir, "documents"), vocabulary())


@on_workers
def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@on_workers
def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@on_workers
def op4_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(table(spark, sf_dir, "documents"))


@on_workers
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


@on_workers
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@on_workers
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@on_workers
def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


@on_workers
def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@on_workers
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), CAPACITY)


@on_workers
def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@on_workers
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


@on_workers
def op13_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_index, op2_license_digests, op3_fair_mix, op4_improbable_features, op5_main_text, op6_simhash_groups,
    op7_toxicity, op8_line_quality, op9_bloom_lm, op10_best_fit, op11_block_whitening, op12_token_alignment,
    op13_jaccard_classes)}

#: The other operators have no SQL counterpart and are tested against brute force.
ORACLE = {"op2_license_digests": licenses.ORACLE, "op8_line_quality": quality.ORACLE}


@on_workers
def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@on_workers
def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@on_workers
def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@on_workers
def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@on_workers
def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary(), CAPACITY)
