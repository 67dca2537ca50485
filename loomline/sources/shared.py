"""Folders that driver and executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a master of one machine gets a temporary one; on
    executors of other machines it would be another folder for each, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="loomline-"))
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """rows, written to path and read from there."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
