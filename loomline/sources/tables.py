"""Scans: keyed reads, definitions from JSON, and the domain's relations as the star-schema tables stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The moment at which states are evaluated; data carry their own time, the wall clock is never read.
AS_OF = "1998-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_scan(rows: DataFrame, key: str, value) -> DataFrame:
    """Rows whose key has the value; the predicate reaches the scan."""
    return rows.filter(F.col(key) == value)


def ordered_columns(rows: DataFrame) -> DataFrame:
    """Columns in ordinal order of their names."""
    return rows.select(*sorted(rows.columns))


PIPELINES = """pipelines array<struct<name:string,version:string,executionMode:string,
  steps:array<struct<name:string,stepKey:string,`order`:int,dependsOn:array<string>>>>>"""


def pipeline_definitions(files: DataFrame, text: str = "value") -> DataFrame:
    """Steps of pipeline definitions in JSON texts whose root is {"pipelines": [...]} or an array; another root fails."""
    body = F.trim(F.col(text))
    wrapped = F.when(F.startswith(body, F.lit("[")), F.concat(F.lit('{"pipelines":'), body, F.lit("}"))).otherwise(body)
    parsed = files.select(F.from_json(wrapped, PIPELINES, {"mode": "FAILFAST"}).alias("p"), body.alias("body"))
    known = F.when(F.col("p.pipelines").isNull(), F.raise_error(F.concat(F.lit("no pipelines in "), F.substring("body", 1, 80)))).otherwise(F.col("p.pipelines"))
    rows = parsed.select(F.explode(known).alias("d")).select("d.name", "d.version", "d.executionMode", F.explode_outer("d.steps").alias("s"))
    return rows.select(F.col("name").alias("pipeline"), "version", F.col("executionMode").alias("mode"), F.col("s.name").alias("step_name"), F.col("s.stepKey").alias("step_key"), F.col("s.order").alias("step_order"), F.coalesce("s.dependsOn", F.array().cast("array<string>")).alias("depends_on"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each step of an execution. Line items have no unique number, so steps are numbered anew by all
    columns."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").withColumn("step_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    waiting = F.element_at(F.array(F.lit("Running"), F.lit("WaitingForRetry"), F.lit("Ready")), (F.col("l_partkey") % 3 + 1).cast("int"))
    status = F.when(F.col("l_linestatus") == "F", "Completed").when(F.col("l_returnflag") == "R", "Failed").when(F.col("l_returnflag") == "A", waiting).otherwise("None")
    day = F.expr("interval 1 day")
    return rows.select(
        F.col("l_orderkey").alias("execution_id"),
        "step_no",
        F.concat(F.lit("step-"), "step_no").alias("step_name"),
        status.alias("status"),
        (F.col("l_partkey") % 4).cast("int").alias("retry_count"),
        (F.col("l_suppkey") % 3).cast("int").alias("recovery_count"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate") + day * (F.col("l_suppkey") % 7).cast("int")).alias("lease_expires_at"),
        (F.col("l_partkey") % 7 != 0).alias("has_retry_state"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_shipdate") + day * (F.col("l_partkey") % 5).cast("int")).alias("next_retry_at"),
        F.when(status == "Completed", F.col("l_shipdate")).alias("completed_at"),
        F.floor("l_extendedprice").cast("long").alias("inline_bytes"),
        (F.col("l_tax") >= 0.08).alias("is_evicted"),
    )


STEPS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS step_no FROM lineitem),
  steps AS (SELECT l_orderkey AS execution_id, step_no, 'step-' || step_no AS step_name,
    CASE WHEN l_linestatus = 'F' THEN 'Completed' WHEN l_returnflag = 'R' THEN 'Failed'
      WHEN l_returnflag = 'A' THEN CASE l_partkey % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'WaitingForRetry' ELSE 'Ready' END
      ELSE 'None' END AS status,
    (l_partkey % 4)::INT AS retry_count, (l_suppkey % 3)::INT AS recovery_count,
    CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate + to_days((l_suppkey % 7)::INT) END AS lease_expires_at,
    l_partkey % 7 <> 0 AS has_retry_state,
    CASE WHEN l_suppkey % 4 <> 0 THEN l_shipdate + to_days((l_partkey % 5)::INT) END AS next_retry_at,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS completed_at,
    floor(l_extendedprice)::BIGINT AS inline_bytes, l_tax >= 0.08 AS is_evicted FROM numbered),
  edges AS (SELECT execution_id, step_no AS child_no, step_no - 1 AS parent_no FROM steps WHERE step_no > 1
    UNION ALL SELECT execution_id, step_no, step_no - 2 FROM steps WHERE step_no > 2 AND step_no % 2 = 0)"""


def edges(steps: DataFrame) -> DataFrame:
    """execution_id, child_no, parent_no: a step depends on the one before, and every second one on two."""
    before = F.when((F.col("step_no") > 2) & (F.col("step_no") % 2 == 0), F.array(F.col("step_no") - 1, F.col("step_no") - 2)).when(F.col("step_no") > 1, F.array(F.col("step_no") - 1)).otherwise(F.array().cast("array<int>"))
    return steps.select("execution_id", F.col("step_no").alias("child_no"), F.explode(before).alias("parent_no"))


def rag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two providers in one schema: documents scored by their label, benchmark items without score."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    a = docs.select(F.col("source").alias("provider"), F.lit(2).alias("source_type"), F.col("doc_id").cast("string").alias("id"), F.lit("Relational").alias("provider_kind"), F.col("lang").alias("content_type"), F.col("text").alias("content"), "score")
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("provider"), F.lit(1000).alias("source_type"), F.col("item_id").cast("string").alias("id"), F.lit("Runtime").alias("provider_kind"), F.lit("text/summary").alias("content_type"), F.col("text").alias("content"), F.lit(None).cast("double").alias("score"))
    return a.unionByName(b)


ITEMS = """items AS (SELECT d.source AS provider, 2 AS source_type, d.doc_id::VARCHAR AS id, 'Relational' AS provider_kind,
    d.lang AS content_type, d.text AS content, l.quality::DOUBLE AS score FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'benchmark', 1000, item_id::VARCHAR, 'Runtime', 'text/summary', text, NULL FROM benchmark)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("execution_id"), "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


LEDGER = """ledger AS (SELECT event_id AS entry_id, user_id AS execution_id, event_type, ts, value,
  (props->>'$.k')::BIGINT AS k, props FROM events)"""
