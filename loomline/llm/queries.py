"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, common, decontaminate, html_extract, licenses, minhash, neighbours, oracle, quality, secrets, token_counts, token_files

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(common.table(spark, sf_dir, "documents"), common.work_dir(spark) + "/ledger")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), common.work_dir(spark))[0]


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), common.work_dir(spark))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.table(spark, sf_dir, "documents"), common.work_dir(spark))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(common.table(spark, sf_dir, "pages"), common.work_dir(spark))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), common.work_dir(spark))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_dir(spark)
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), folder)
    return token_files.read_token_files(spark, folder, keep_ids=False)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), keep=())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter("vec_id % 20 = 0"), common.work_dir(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_quality, op4_decontamination, op5_license_scan, op6_html_text, op7_minhash, op8_token_files, op9_bpe, op10_neighbours)}
ORACLE: dict[str, str] = oracle.ORACLE
