"""Queries of an execution's context: paths, payloads, parsing and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import context as c
from loomline.registry import query
from loomline.sources import tables
from loomline.sources.tables import STEPS


@query("expr_parse", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN ' ' || props ELSE json(props)::VARCHAR END AS parsed FROM events""")
def parse(spark, sf_dir):
    """JSON where the format says so in any case, else the raw text."""
    e = tables.table(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("json"), F.lit("JSON"), F.lit("text")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", c.parse_result(F.concat(F.lit(" "), "props"), kind).alias("parsed"))


def _artifacts(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("a-"), "n_nationkey").alias("artifact_id"), F.concat(F.lit('{"name":"'), "n_name", F.lit('","key":'), "n_nationkey", F.lit("}")).alias("value"))


@query("dag_artifact_values", f"""WITH {STEPS}, a AS (SELECT 'a-' || n_nationkey AS artifact_id, '{{"name":"' || n_name || '","key":' || n_nationkey || '}}' AS value FROM nation)
  SELECT execution_id, step_no, 'a-' || (inline_bytes % 40) AS artifact_id, value FROM steps LEFT JOIN a ON a.artifact_id = 'a-' || (inline_bytes % 40)""")
def artifact_values(spark, sf_dir):
    """Payloads by artifact id; one that the store doesn't have is null."""
    steps = tables.steps(spark, sf_dir).select("execution_id", "step_no", F.concat(F.lit("a-"), F.col("inline_bytes") % 40).alias("artifact_id"))
    return steps.join(_artifacts(spark, sf_dir), "artifact_id", "left").select("execution_id", "step_no", "artifact_id", "value")


def _context(spark, sf_dir):
    """One row for each execution: its steps as JSON by name, and the artifacts that they name."""
    steps = tables.steps(spark, sf_dir).withColumn("artifact_id", F.concat(F.lit("a-"), F.col("inline_bytes") % 40)).join(_artifacts(spark, sf_dir), "artifact_id", "left")
    result = F.struct(F.col("retry_count").alias("value"), F.struct(F.col("inline_bytes").alias("bytes"), F.lit("inline").alias("big")).alias("data"), F.when(F.col("step_no") % 2 == 1, F.struct(F.struct(F.col("artifact_id").alias("artifactId")).alias("big"))).alias("dataPayloads"))
    body = F.to_json(F.struct("status", F.when(F.col("status") != "None", result).alias("result")))
    known = F.when(F.col("value").isNotNull(), F.struct("artifact_id", "value"))
    both = steps.groupBy("execution_id").agg(F.map_from_entries(F.collect_list(F.struct("step_name", body))).alias("steps"), F.map_from_entries(F.collect_set(known)).alias("artifacts"), F.max("inline_bytes").alias("most"))
    roots = F.concat(F.lit('{"n":{"most":'), "most", F.lit('},"payloads":{"first":{"artifactId":"a-'), F.col("most") % 40, F.lit('"}}}'))
    return both, c.Context({k: roots for k in ("inputs", "config", "state", "metadata")}, F.col("steps"), F.col("artifacts"), F.col("execution_id"), F.lit("step-1"), F.lit("key-1"), F.lit("demo"))


_S = "max(CASE WHEN step_name = '{s}' AND status <> 'None' THEN {x} END)"


def _step(name: str, expression: str) -> str:
    return _S.format(s=name, x=expression)


@query("expr_step_path", f"""WITH {STEPS}, a AS (SELECT 'a-' || n_nationkey AS artifact_id, n_name FROM nation), j AS (SELECT steps.*, n_name, '{{"name":"' || n_name || '","key":' || (inline_bytes % 40) || '}}' AS whole FROM steps LEFT JOIN a ON a.artifact_id = 'a-' || (inline_bytes % 40))
  SELECT execution_id, {_step('step-1', 'retry_count::VARCHAR')} AS value, {_step('step-2', 'inline_bytes::VARCHAR')} AS bytes, {_step('step-1', 'whole')} AS big_1, {_step('step-2', "'inline'")} AS big_2,
    {_step('step-1', 'n_name')} AS name_1, {_step('step-1', 'status')} AS status_1, NULL::VARCHAR AS none FROM j GROUP BY execution_id""")
def step_path(spark, sf_dir):
    """Values, data and artifacts of other steps' results. An artifact goes before an inline value."""
    rows, context = _context(spark, sf_dir)
    paths = {"value": "steps.step-1.result.value", "bytes": "steps.step-2.result.data.bytes", "big_1": "steps.step-1.result.data.big", "big_2": "steps.step-2.result.data.big", "name_1": "steps.step-1.result.dataPayloads.big.name", "status_1": "steps.step-1.status", "none": "steps.step-99.result.value"}
    return rows.select("execution_id", *(c.resolve(p, context).alias(n) for n, p in paths.items()))


@query("expr_root_path", f"""WITH {STEPS}, m AS (SELECT execution_id, max(inline_bytes) AS most FROM steps GROUP BY 1)
  SELECT execution_id, most::VARCHAR AS by_input, most::VARCHAR AS by_data, n_name AS by_payload, execution_id::VARCHAR AS id, 'step-1' AS step, 'key-1' AS step_key, 'demo' AS pipeline, NULL::VARCHAR AS none
  FROM m LEFT JOIN nation ON n_nationkey = most % 40""")
def root_path(spark, sf_dir):
    """The root of a path says where it leads, to JSON, to an artifact or to the execution's own fields."""
    rows, context = _context(spark, sf_dir)
    paths = {"by_input": "input.n.most", "by_data": "data.n.most", "by_payload": "metadataPayloads.first.name", "id": "execution.id", "step": "execution.currentStep", "step_key": "execution.stepKey", "pipeline": "execution.pipelineName", "none": "execution.other"}
    return rows.select("execution_id", *(c.resolve(p, context).alias(n) for n, p in paths.items()))


@query("dag_correlation", f"""WITH {STEPS} SELECT execution_id, step_no, 'demo:2' AS pipeline_key, CASE WHEN step_no % 2 = 0 THEN 'key' ELSE step_name END AS step_key, execution_id || ':' || step_name || ':i-' || (execution_id % 5) AS lease_id,
  'p' || retry_count AS provider, NULL::VARCHAR AS model, CASE WHEN step_no % 3 = 0 THEN 'op' ELSE 'chat' END AS operation FROM steps""")
def step_correlation(spark, sf_dir):
    """What ties a claimed step to the ledger, to traces and to its lease."""
    steps = tables.steps(spark, sf_dir).withColumn("key", F.when(F.col("step_no") % 2 == 0, "key").otherwise(" "))
    config = F.to_json(F.struct(F.concat(F.lit("p"), "retry_count").alias("provider"), F.when(F.col("step_no") % 3 == 0, "op").alias("operation"), F.lit("chat").alias("type")))
    instance = F.concat(F.lit("i-"), F.col("execution_id") % 5)
    return steps.select("execution_id", "step_no", *c.correlation(F.lit("demo"), F.lit("2"), F.col("execution_id"), "step_name", "key", instance, config))
