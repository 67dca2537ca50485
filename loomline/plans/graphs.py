"""Queries of step graphs and their state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import dag
from loomline.registry import query
from loomline.sources import shared, tables
from loomline.sources.tables import AS_OF, STEPS

_NOW = f"TIMESTAMP '{AS_OF}'"


def _now():
    return F.expr(f"timestamp_ntz '{AS_OF}'")


def _state(spark, sf_dir):
    steps = tables.steps(spark, sf_dir)
    return steps, tables.edges(steps)


_CLAIMABLE = f"""(status IN ('Ready', 'None') OR status = 'WaitingForRetry' AND has_retry_state AND (next_retry_at IS NULL OR next_retry_at <= {_NOW}))"""
_READY = f"""ready AS (SELECT s.* FROM steps s WHERE {_CLAIMABLE} AND NOT EXISTS (SELECT 1 FROM edges e LEFT JOIN steps p
    ON p.execution_id = e.execution_id AND p.step_no = e.parent_no WHERE e.execution_id = s.execution_id AND e.child_no = s.step_no
    AND (p.status IS NULL OR p.status <> 'Completed')))"""
_PENDING = """pending AS (SELECT s.execution_id, s.step_no, NOT EXISTS (SELECT 1 FROM edges e LEFT JOIN steps p ON p.execution_id = e.execution_id
    AND p.step_no = e.parent_no WHERE e.execution_id = s.execution_id AND e.child_no = s.step_no AND (p.status IS NULL OR p.status = 'Failed'
    OR p.status = 'Running' AND p.lease_expires_at IS NULL)) AS can_progress FROM steps s WHERE status = 'None')"""


@query("dag_claim_candidates", f"WITH {STEPS} SELECT execution_id, step_no, status FROM steps WHERE {_CLAIMABLE}")
def claim_candidates(spark, sf_dir):
    return tables.steps(spark, sf_dir).filter(dag.claimable(_now())).select("execution_id", "step_no", "status")


@query("dag_ready_set", f"WITH {STEPS}, {_READY} SELECT execution_id, step_name, row_number() OVER (PARTITION BY execution_id ORDER BY step_name)::INT AS claim_order FROM ready")
def ready_set(spark, sf_dir):
    ready = dag.ready_steps(*_state(spark, sf_dir), _now())
    return ready.select("execution_id", "step_name", F.row_number().over(Window.partitionBy("execution_id").orderBy("step_name")).alias("claim_order"))


@query("dag_progress", f"WITH {STEPS}, {_PENDING} SELECT * FROM pending")
def progress(spark, sf_dir):
    return dag.progress_of_pending(*_state(spark, sf_dir))


@query("dag_convergence", f"""WITH {STEPS}, {_READY}, {_PENDING},
  executions AS (SELECT o_orderkey AS execution_id FROM orders),
  flags AS (SELECT execution_id, count(*) AS n, bool_and(status = 'Completed') AS c,
    bool_or(status = 'WaitingForRetry' AND has_retry_state AND coalesce(next_retry_at <= {_NOW}, false)) AS due,
    bool_or(status = 'Running' AND coalesce(lease_expires_at > {_NOW}, false)) AS leased,
    bool_or(status = 'WaitingForRetry' AND has_retry_state AND coalesce(next_retry_at > {_NOW}, false)) AS future,
    bool_or(status = 'Running' AND coalesce(lease_expires_at <= {_NOW}, false)) AS expired, bool_or(status = 'Failed') AS failed FROM steps GROUP BY execution_id)
  SELECT x.execution_id, CASE WHEN n IS NULL THEN 'Waiting' WHEN c THEN 'Completed'
    WHEN due OR leased OR x.execution_id IN (SELECT execution_id FROM ready WHERE status IN ('Ready', 'None')) THEN 'Running'
    WHEN future OR expired OR x.execution_id IN (SELECT execution_id FROM pending WHERE can_progress) THEN 'Waiting'
    WHEN failed THEN 'Failed' ELSE 'Waiting' END AS convergence, coalesce(n, 0) AS steps
  FROM executions x LEFT JOIN flags USING (execution_id)""")
def convergence(spark, sf_dir):
    executions = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"))
    return dag.convergence(executions, *_state(spark, sf_dir), _now())


@query("dag_graph", f"""WITH {STEPS} SELECT e.execution_id, 'step-' || parent_no AS from_step, 'step-' || child_no AS to_step, s.status AS to_status FROM edges e
  JOIN steps s ON s.execution_id = e.execution_id AND s.step_no = e.child_no""")
def graph(spark, sf_dir):
    steps, edges = _state(spark, sf_dir)
    named = edges.join(steps.select("execution_id", F.col("step_no").alias("child_no"), "status"), ["execution_id", "child_no"])
    return named.select("execution_id", F.concat(F.lit("step-"), "parent_no").alias("from_step"), F.concat(F.lit("step-"), "child_no").alias("to_step"), F.col("status").alias("to_status"))


@query("dag_roots", f"WITH {STEPS} SELECT s.execution_id, count(*) AS roots FROM steps s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.execution_id = s.execution_id AND e.child_no = s.step_no) GROUP BY 1")
def roots(spark, sf_dir):
    steps, edges = _state(spark, sf_dir)
    return steps.join(edges.select("execution_id", F.col("child_no").alias("step_no")), ["execution_id", "step_no"], "left_anti").groupBy("execution_id").agg(F.count("*").alias("roots"))


_DEFINITIONS = """defs AS (SELECT o_custkey AS pipeline, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 's' || (o_orderkey % 9) END AS step_name,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS step_key, (o_orderkey % 6 - 1)::INT AS retries,
    CASE o_orderkey % 4 WHEN 0 THEN ['s' || (o_orderkey % 7)] WHEN 1 THEN [''] WHEN 2 THEN ['s' || (o_orderkey % 9), 's1'] ELSE []::VARCHAR[] END AS depends_on FROM orders)"""


@query("dag_validation", f"""WITH {_DEFINITIONS}, needs AS (SELECT pipeline, step_name, unnest(depends_on) AS parent FROM defs)
  SELECT pipeline, step_name, 'BlankName' AS issue FROM defs WHERE trim(step_name) = ''
  UNION ALL SELECT pipeline, step_name, 'BlankKey' FROM defs WHERE coalesce(trim(step_key), '') = ''
  UNION ALL SELECT pipeline, step_name, 'NegativeRetries' FROM defs WHERE retries < 0
  UNION ALL SELECT pipeline, step_name, 'DuplicateName' FROM defs WHERE trim(step_name) <> '' GROUP BY pipeline, step_name HAVING count(*) > 1
  UNION ALL SELECT pipeline, step_name, 'BlankDependency' FROM needs WHERE trim(parent) = ''
  UNION ALL SELECT pipeline, step_name, 'SelfDependency' FROM needs WHERE parent = step_name
  UNION ALL SELECT pipeline, step_name, 'MissingDependency' FROM needs n WHERE trim(parent) <> '' AND NOT EXISTS (SELECT 1 FROM defs d WHERE d.pipeline = n.pipeline AND d.step_name = n.parent)""")
def validation(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    name = lambda m: F.concat(F.lit("s"), (key % m).cast("string"))
    needs = F.when(key % 4 == 0, F.array(name(7))).when(key % 4 == 1, F.array(F.lit(""))).when(key % 4 == 2, F.array(name(9), F.lit("s1"))).otherwise(F.array().cast("array<string>"))
    defs = o.select(F.col("o_custkey").alias("pipeline"), F.when(key % 11 == 0, " ").otherwise(name(9)).alias("step_name"), F.when(key % 13 != 0, F.col("o_orderpriority")).alias("step_key"), (key % 6 - 1).cast("int").alias("retries"), needs.alias("depends_on"))
    return dag.validate_definitions(defs)


@query("dag_cycles", f"""WITH RECURSIVE links AS (SELECT DISTINCT l_orderkey AS execution_id, (l_partkey % 5)::INT AS parent, (l_suppkey % 5)::INT AS child FROM lineitem WHERE l_partkey % 5 <> l_suppkey % 5),
  reach AS (SELECT execution_id, parent AS a, child AS b FROM links UNION SELECT r.execution_id, r.a, l.child FROM reach r JOIN links l ON l.execution_id = r.execution_id AND l.parent = r.b)
  SELECT DISTINCT x.execution_id, l.child AS node FROM (SELECT execution_id, a FROM reach WHERE a = b) x JOIN
    (SELECT execution_id, a, b AS child FROM reach) l ON l.execution_id = x.execution_id AND l.a = x.a""")
def cycles(spark, sf_dir):
    """Executions whose made-up links between five nodes have cycles: the nodes on one or behind one."""
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("execution_id"), (F.col("l_partkey") % 5).cast("int").alias("parent"), (F.col("l_suppkey") % 5).cast("int").alias("child")).filter("parent <> child")
    return dag.cyclic(rows, "execution_id", shared.folder(spark, "cycles"))


@query("dag_replay_dependencies", f"""WITH {STEPS} SELECT e.execution_id, e.child_no, e.parent_no, CASE WHEN p.status IS NULL THEN 'missing' ELSE 'parent_not_completed' END AS issue
  FROM edges e JOIN steps c ON c.execution_id = e.execution_id AND c.step_no = e.child_no LEFT JOIN steps p ON p.execution_id = e.execution_id AND p.step_no = e.parent_no
  WHERE p.status IS NULL OR p.status <> 'Completed' AND c.status IN ('Completed', 'Running')""")
def replay_dependencies(spark, sf_dir):
    steps, edges = _state(spark, sf_dir)
    child = steps.select("execution_id", F.col("step_no").alias("child_no"), F.col("status").alias("c"))
    parent = steps.select("execution_id", F.col("step_no").alias("parent_no"), F.col("status").alias("p"))
    rows = edges.join(child, ["execution_id", "child_no"]).join(parent, ["execution_id", "parent_no"], "left")
    bad = rows.filter("p is null or p <> 'Completed' and c in ('Completed', 'Running')")
    return bad.select("execution_id", "child_no", "parent_no", F.when(F.col("p").isNull(), "missing").otherwise("parent_not_completed").alias("issue"))


@query("dag_replay_states", f"""WITH {STEPS} SELECT execution_id, step_no, 'retry_state_missing' AS issue FROM steps WHERE status = 'WaitingForRetry' AND NOT has_retry_state
  UNION ALL SELECT execution_id, step_no, 'retry_budget_exceeded' FROM steps WHERE has_retry_state AND retry_count > 2
  UNION ALL SELECT execution_id, step_no, 'claim_token_missing' FROM steps WHERE status = 'Running' AND lease_expires_at IS NULL
  UNION ALL SELECT execution_id, step_no, 'completed_at_missing' FROM steps WHERE status = 'Completed' AND completed_at IS NULL""")
def replay_states(spark, sf_dir):
    """Each step with the issues that it has, found in one pass."""
    found = F.array_compact(F.array(
        F.when((F.col("status") == "WaitingForRetry") & ~F.col("has_retry_state"), "retry_state_missing"),
        F.when(F.col("has_retry_state") & (F.col("retry_count") > 2), "retry_budget_exceeded"),
        F.when((F.col("status") == "Running") & F.col("lease_expires_at").isNull(), "claim_token_missing"),
        F.when((F.col("status") == "Completed") & F.col("completed_at").isNull(), "completed_at_missing"),
    ))
    return tables.steps(spark, sf_dir).select("execution_id", "step_no", F.explode(found).alias("issue"))


@query("dag_replay_payloads", f"WITH {STEPS} SELECT execution_id, step_no, 'artifact_id_missing' AS issue FROM steps WHERE inline_bytes > 50000 AND step_no % 3 = 0")
def replay_payloads(spark, sf_dir):
    """External payloads (over 50,000 bytes) whose artifact id, here that of every third step, is missing."""
    steps = tables.steps(spark, sf_dir).withColumn("payloads", F.create_map(F.lit("value"), F.struct(F.col("inline_bytes").alias("bytes"), F.when(F.col("step_no") % 3 != 0, F.col("step_name")).alias("artifact"))))
    rows = steps.select("execution_id", "step_no", F.explode("payloads").alias("name", "p"))
    return rows.filter("p.bytes > 50000 and p.artifact is null").select("execution_id", "step_no", F.lit("artifact_id_missing").alias("issue"))


_PRINTS = """prints AS (SELECT execution_id, upper(sha256(string_agg(step_name || '|' || status || '|' || retry_count || '|' || recovery_count, ',' ORDER BY step_name))) AS fingerprint FROM steps GROUP BY execution_id)"""


@query("dag_fingerprint", f"WITH {STEPS}, {_PRINTS} SELECT * FROM prints")
def fingerprint(spark, sf_dir):
    return dag.fingerprints(tables.steps(spark, sf_dir))


@query("dag_fingerprint_compare", f"""WITH {STEPS}, {_PRINTS}, later AS (SELECT execution_id, CASE WHEN execution_id % 5 = 0 THEN 'X' ELSE fingerprint END AS again FROM prints WHERE execution_id % 7 <> 0)
  SELECT execution_id, CASE WHEN again IS NULL THEN 'missing' WHEN again = fingerprint THEN 'valid' ELSE 'mismatch' END AS outcome FROM prints LEFT JOIN later USING (execution_id)""")
def fingerprint_compare(spark, sf_dir):
    now = dag.fingerprints(tables.steps(spark, sf_dir))
    later = now.filter("execution_id % 7 <> 0").select("execution_id", F.when(F.col("execution_id") % 5 == 0, "X").otherwise(F.col("fingerprint")).alias("again"))
    outcome = F.when(F.col("again").isNull(), "missing").when(F.col("again") == F.col("fingerprint"), "valid").otherwise("mismatch")
    return now.join(later, "execution_id", "left").select("execution_id", outcome.alias("outcome"))


@query("dag_resolve_steps", f"""WITH {STEPS} SELECT execution_id, step_no, status, 'hot' AS place FROM steps WHERE NOT is_evicted
  UNION ALL SELECT execution_id, step_no, status, 'archive' FROM steps a WHERE (is_evicted OR step_no % 2 = 0) AND NOT EXISTS (SELECT 1 FROM steps h WHERE NOT h.is_evicted AND h.execution_id = a.execution_id AND h.step_no = a.step_no)""")
def resolve_steps(spark, sf_dir):
    steps = tables.steps(spark, sf_dir)
    part = lambda condition, place: steps.filter(condition).select("execution_id", "step_no", "status", F.lit(place).alias("place"))
    return dag.resolve_steps(part("not is_evicted", "hot"), part("is_evicted or step_no % 2 = 0", "archive"), ["execution_id", "step_no"])


@query("dag_reconstruct", f"""WITH {STEPS}, b AS (SELECT execution_id, step_no, CASE WHEN step_no % 2 = 0 THEN 'Completed' ELSE status END AS b FROM steps WHERE step_no % 3 <> 0), r AS (SELECT execution_id, step_no, status AS r FROM steps WHERE step_no % 5 <> 0)
  SELECT execution_id, step_no, CASE WHEN b IN ('Completed', 'Failed') AND (r IS NULL OR r NOT IN ('Completed', 'Failed')) THEN b ELSE coalesce(r, b) END AS status FROM b FULL JOIN r USING (execution_id, step_no)""")
def reconstruct(spark, sf_dir):
    steps = tables.steps(spark, sf_dir)
    blob = steps.filter("step_no % 3 <> 0").withColumn("status", F.when(F.col("step_no") % 2 == 0, "Completed").otherwise(F.col("status")))
    return dag.reconstruct(blob, steps.filter("step_no % 5 <> 0"), ["execution_id", "step_no"])


_TOLD = "told AS (SELECT l_orderkey AS execution_id, 'step-' || l_linenumber AS step_name FROM lineitem WHERE l_quantity >= 20)"


@query("dag_stale_rows", f"""WITH {STEPS}, {_TOLD}, r AS (SELECT *, CASE WHEN status <> 'None' OR step_no % 4 = 0 THEN inline_bytes END AS result FROM steps)
  SELECT execution_id, step_no FROM r WHERE status = 'None' AND result IS NULL AND completed_at IS NULL AND (execution_id, step_name) IN (SELECT execution_id, step_name FROM told)""")
def stale_rows(spark, sf_dir):
    """rows without state, result and time whose name the execution's completed set has."""
    steps = tables.steps(spark, sf_dir)
    rows = steps.withColumn("result", F.when((F.col("status") != "None") | (F.col("step_no") % 4 == 0), F.col("inline_bytes")))
    told = tables.table(spark, sf_dir, "lineitem").filter("l_quantity >= 20").select(F.col("l_orderkey").alias("execution_id"), F.concat(F.lit("step-"), "l_linenumber").alias("step_name"))
    return dag.stale(rows, told).select("execution_id", "step_no")


@query("dag_completed_union", f"""WITH {STEPS} SELECT execution_id, step_name FROM steps WHERE status = 'Completed' UNION SELECT l_orderkey, 'step-' || l_linenumber FROM lineitem WHERE l_linestatus = 'F'""")
def completed_union(spark, sf_dir):
    hot = tables.steps(spark, sf_dir).filter("status = 'Completed'").select("execution_id", "step_name")
    told = tables.table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("execution_id"), F.concat(F.lit("step-"), "l_linenumber").alias("step_name"))
    return hot.unionByName(told).distinct()


@query("dag_sequential_next", f"WITH {STEPS} SELECT execution_id, min(step_no)::INT AS next_step, count(*) FILTER (status = 'Completed') AS completed FROM (SELECT *, CASE WHEN status = 'Completed' THEN NULL ELSE step_no END AS o FROM steps) WHERE o IS NOT NULL GROUP BY execution_id".replace("count(*) FILTER (status = 'Completed') AS completed", "count(*) AS open"))
def sequential_next(spark, sf_dir):
    """The first step in order that isn't completed, of executions that aren't past the end."""
    return tables.steps(spark, sf_dir).filter("status <> 'Completed'").groupBy("execution_id").agg(F.min("step_no").alias("next_step"), F.count("*").alias("open"))


@query("dag_lease_recovery", f"WITH {STEPS} SELECT execution_id, step_no, 'Ready' AS status, recovery_count + 1 AS recovery_count FROM steps WHERE status = 'Running' AND lease_expires_at <= {_NOW}")
def lease_recovery(spark, sf_dir):
    steps = tables.steps(spark, sf_dir).filter(dag.lease_expired(_now()))
    return steps.select("execution_id", "step_no", F.lit("Ready").alias("status"), (F.col("recovery_count") + 1).alias("recovery_count"))


@query("dag_replay_preparation", f"""WITH {STEPS}, done AS (SELECT execution_id, bool_and(status IN ('Completed', 'Failed')) AS t FROM steps GROUP BY 1)
  SELECT s.execution_id, step_no, CASE WHEN NOT t AND status = 'Running' THEN 'Ready' ELSE status END AS status, CASE WHEN t OR status <> 'Running' THEN lease_expires_at END AS lease_expires_at FROM steps s JOIN done USING (execution_id)""")
def replay_preparation(spark, sf_dir):
    steps = tables.steps(spark, sf_dir)
    done = steps.groupBy("execution_id").agg(F.bool_and(F.col("status").isin(*dag.TERMINAL)).alias("t"))
    again = ~F.col("t") & (F.col("status") == "Running")
    return steps.join(done, "execution_id").select("execution_id", "step_no", F.when(again, "Ready").otherwise(F.col("status")).alias("status"), F.when(~again, F.col("lease_expires_at")).alias("lease_expires_at"))


@query("dag_step_subset", f"WITH {STEPS} SELECT execution_id, step_name FROM steps WHERE step_name IN ('step-1', 'step-3')")
def step_subset(spark, sf_dir):
    wanted = spark.createDataFrame([("step-1",), ("step-3",)], "step_name string")
    return tables.steps(spark, sf_dir).select("execution_id", "step_name").join(wanted, "step_name", "left_semi").select("execution_id", "step_name")


@query("dag_replay_totals", f"WITH {STEPS} SELECT execution_id, sum(retry_count)::BIGINT AS retries, sum(recovery_count)::BIGINT AS recoveries, count(*) AS steps, sum(CASE WHEN retry_count > 0 THEN 1 ELSE 0 END)::BIGINT AS retried, min(retry_count) AS least, max(retry_count) AS most, bool_and(retry_count > 0) AS all_retried FROM steps GROUP BY 1")
def replay_totals(spark, sf_dir):
    """A17 and A18."""
    r = F.col("retry_count")
    return tables.steps(spark, sf_dir).groupBy("execution_id").agg(F.sum(r).alias("retries"), F.sum("recovery_count").alias("recoveries"), F.count("*").alias("steps"), F.count_if(r > 0).alias("retried"), F.min(r).alias("least"), F.max(r).alias("most"), F.bool_and(r > 0).alias("all_retried"))


@query("dag_recovery_change", f"""WITH {STEPS}, a AS (SELECT execution_id, step_no, recovery_count + CASE WHEN status = 'Running' AND lease_expires_at <= {_NOW} THEN 1 ELSE 0 END AS after FROM steps)
  SELECT execution_id, step_no, recovery_count AS before, after::INT AS after FROM steps JOIN a USING (execution_id, step_no) WHERE after > recovery_count""")
def recovery_change(spark, sf_dir):
    """Steps whose recovery count is higher after leases were recovered than before."""
    before = tables.steps(spark, sf_dir)
    more = F.when(dag.lease_expired(_now()), 1).otherwise(0)
    after = before.select("execution_id", "step_no", (F.col("recovery_count") + more).alias("recovery_count"))
    return dag.recovered(before, after, ["execution_id", "step_no"])


@query("dag_states_by_name", f"""WITH {STEPS}, e AS (SELECT DISTINCT execution_id FROM steps), d AS (SELECT execution_id, 'step-' || unnest([1, 2, 3, 4, 5, 6, 7]) AS step_name FROM e)
  SELECT execution_id, step_name, coalesce(status, 'None') AS status FROM d LEFT JOIN steps USING (execution_id, step_name)""")
def states_by_name(spark, sf_dir):
    """Each step of a definition with its state; one without state counts as None."""
    steps = tables.steps(spark, sf_dir)
    names = F.array(*(F.lit(f"step-{k}") for k in range(1, 8)))
    defined = steps.select("execution_id").distinct().select("execution_id", F.explode(names).alias("step_name"))
    return dag.states_by_name(defined, steps)
