"""What the operators of this subpackage share: reading tables and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Lets the executors import this package, wherever they run; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="loomline-")) / "loomline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a master of one machine gets a temporary one; on
    executors of other machines it would be another folder for each, so there it is an error."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="loomline-"))
    return f"{base}/loomline-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options) -> DataFrame:
    """The rows of df, written to path and read from there: a lost executor doesn't bring them back to compute."""
    spark = df.sparkSession
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this library's own below spark.checkpoint.dir that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int | None, size: int = 1 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most rows rows and, in the column of texts, size bytes (unless one row alone has more)."""
    if column is None:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
        n = min(max(n, at + 1), at + rows)
        yield batch.slice(at, n - at)
        at = n


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A column of lists from all their values one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))
