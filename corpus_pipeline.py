"""A corpus from raw documents: five stages, each one an operator of loomline.llm on all that the stage before kept.

Every stage gets a DataFrame with the columns of documents and returns one; all but the last return these columns. The
result of each stage is written as Parquet and read again before the next one. All stages stand a null in any column,
empty and very long texts, repeated rows, empty tables and further columns; what each does is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, common, decontaminate, minhash, quality, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Without labels nothing is dropped."""
    return quality.of_good_quality(docs, common.table(spark, sf_dir, "labels"), common.work_dir(spark))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates; rows without id stay, and so do
    repeated rows of the document that is kept. Rows of one id are one document: they go together."""
    found = minhash.near_duplicates(docs, common.work_dir(spark))
    return docs.join(found.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row whose text holds a benchmark item, rows without id too: the search goes by the text's 64-bit hash."""
    key = common.free_name(docs, "text_hash")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    hits = decontaminate.contaminated(keyed, common.table(spark, sf_dir, "benchmark"), common.work_dir(spark), id_col=key)
    return keyed.join(hits.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret with its kind in angle brackets and sets n_chars anew where a text changes; keeps all rows."""
    return secrets.redacted(docs, common.work_dir(spark) + "/ledger", length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and of what they decode to."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each_group),
    ("benchmark decontamination", keep_clean_of_benchmark),
    ("secret scan", redact_secrets),
    ("byte-pair encoding", encode),
]
#: SQL can't express the classifier, the retrieval or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each one's rows are written before the next reads them."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"{folder}/{k}")
    return docs
