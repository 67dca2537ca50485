"""Ledgers, metrics and traces: filters, sequences, counters, percentiles, histograms, rates and segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import ordered


def ledger_filter(ledger: DataFrame, equal: dict | None = None, between: dict | None = None) -> DataFrame:
    """Rows that equal every given value (blank or null: no filter) and lie in every given range, ends included."""
    conditions = [F.col(k) == v for k, v in (equal or {}).items() if v is not None and str(v).strip()]
    for k, (low, high) in (between or {}).items():
        conditions += [F.col(k) >= low] * (low is not None) + [F.col(k) <= high] * (high is not None)
    return reduce(DataFrame.filter, conditions, ledger)


def sequenced(ledger: DataFrame) -> DataFrame:
    """Entries of an execution numbered from 1 in the order of time and id."""
    return ledger.withColumn("sequence", F.row_number().over(Window.partitionBy("execution_id").orderBy("ts", "entry_id")).cast("long"))


def segments(points: DataFrame, key: str, overlap_ms: int) -> DataFrame:
    """From points (key, at_ms, id): each lasts until the next one, the last for overlap_ms (a second at least)."""
    nxt = F.lead("at_ms").over(Window.partitionBy(key).orderBy("at_ms", "id"))
    end = F.coalesce(nxt, F.col("at_ms") + max(overlap_ms, 1000))
    return points.withColumn("end_ms", end).withColumn("visual_end_ms", F.greatest(end, F.col("at_ms") + max(overlap_ms, 0)))


def rates(samples: DataFrame, key: str) -> DataFrame:
    """From samples (key, at_ms, completed): change for each second since the sample before; unchanged ones are dropped."""
    w = Window.partitionBy(key).orderBy("at_ms", "completed")
    rows = samples.withColumn("p_at", F.lag("at_ms").over(w)).withColumn("p_done", F.lag("completed").over(w))
    rows = rows.filter(F.col("p_done").isNull() | (F.col("completed") != F.col("p_done")))
    rate = F.when(F.col("at_ms") > F.col("p_at"), (F.col("completed") - F.col("p_done")) * 1000.0 / (F.col("at_ms") - F.col("p_at")))
    return rows.select(key, "at_ms", "completed", rate.alias("rate"))


def counters(rows: DataFrame, dimensions: list[str], names: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*dimensions).agg(*(F.count_if(c).alias(n) for n, c in names.items()))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: values that occur. Nulls don't count; keys with nothing else have null.

    Values are counted before they are dealt out, and no key's values must fit into one task.
    """
    totals = rows.groupBy(*keys).agg(F.count(value).alias("__n"))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__same"))
    upto = ordered.running(counts, keys, [F.col(value)], "__upto", "__same")
    same = reduce(lambda a, b: a & b, (upto[k].eqNullSafe(totals[k]) for k in keys))
    at = {n: F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(p))) for n, p in shares.items()}
    return totals.join(upto, same, "left").groupBy(*(totals[k] for k in keys)).agg(*(F.min(F.when(F.col("__upto") >= at[n], upto[value])).alias(n) for n in shares))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Counts of buckets with their upper bound included, a last one without bound; empty buckets stay."""
    spark = rows.sparkSession
    buckets = spark.createDataFrame([(k, b) for k, b in enumerate([*bounds, float("inf")])], "bucket int, upto double")
    own = reduce(lambda rest, kb: F.when(F.col(value) <= kb[1], kb[0]).otherwise(rest), reversed(list(enumerate(bounds))), F.lit(len(bounds)))
    counts = rows.groupBy(own.alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def http_class(status: Column) -> Column:
    return F.when(status == 401, "unauthorized").when(status == 403, "forbidden").when(status == 429, "rejected").otherwise("other")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; earlier ones are cut in each task before rows are dealt out."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("place = 1").drop("place")


def last_n(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def storage_operations(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Operations on payloads by keys, from (op, bytes): negative and unknown sizes count as 0, and only what is stored counts."""
    names = {"stored": "stored", "loaded": "loaded", "hits": "hit", "misses": "miss", "failures": "failed"}
    size = F.when(F.col("op") == "stored", F.greatest(F.lit(0), F.coalesce("bytes", F.lit(0)))).otherwise(0)
    return ops.groupBy(*keys).agg(*(F.count_if(F.col("op") == op).alias(n) for n, op in names.items()), F.sum(size).cast("long").alias("bytes_stored"))


def failures(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Failed operations by keys and exception; a blank or missing name is "unknown"."""
    name = F.coalesce(F.nullif(F.trim("exception"), F.lit("")), F.lit("unknown"))
    return ops.filter("op = 'failed'").groupBy(*keys, name.alias("exception")).agg(F.count("*").alias("n"))


def hot_states(samples: DataFrame, key: str) -> DataFrame:
    """Of each key from (at, id, before, after): samples, the last size seen, and what went, where growth counts as 0."""
    gone = F.greatest(F.lit(0), F.col("before") - F.col("after"))
    return samples.groupBy(key).agg(F.count("*").alias("samples"), F.max_by("after", F.struct("at", "id")).alias("last_size"), F.sum(gone).cast("long").alias("removed"))


def retention_savings(passes: DataFrame, keys: list[str]) -> DataFrame:
    """Passes by keys with bytes before, after and saved (never below 0 in a pass)."""
    known = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    saved = F.greatest(F.lit(0), known("before") - known("after"))
    return passes.groupBy(*keys).agg(F.count("*").alias("passes"), F.sum(known("before")).cast("long").alias("bytes_before"), F.sum(known("after")).cast("long").alias("bytes_after"), F.sum(saved).cast("long").alias("bytes_saved"))
